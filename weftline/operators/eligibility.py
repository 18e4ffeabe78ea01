"""Scope, eligibility and boundary rules over pairs of a case and a candidate, and their confusion with gold labels.

Pairs are rows with the candidate's columns (document_type, scope_type, primary_solution, applicable, excluded, industries,
tags, status, effective_from, effective_until) and the case's (scope, ask_types, ask_industries, ask_tags, effective_on,
forbidden), forbidden_document as a boolean, and relevant where gold is compared. Arrays must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable

# Scope types, modes and filters by name.
SPECIFIC, MULTI, GLOBAL, CROSS = "solution_specific", "multi_solution", "global_policy", "cross_cutting_requirement"
MODES = ["primary_in_scope", "full_applicable_scope", "global_reusable"]
FILTER_KEYS = ["document_types", "industries", "solution_ids", "tags", "statuses", "effective_on"]
STRATEGIES = ["S0", "S1", "S2", "S3", "S4"]
RULES = ["R0", "R1", "R2", "R3", "R4", "R5"]


def _reasons(**named: Column) -> Column:
    """Names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def _asked(list_name: str) -> Column:
    return F.size(list_name) > 0


def _meet(a: str, b: str) -> Column:
    return F.arrays_overlap(a, b)


def _inside(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _is(kind: str) -> Column:
    return F.col("scope_type") == kind


def _primary_in_scope() -> Column:
    return F.coalesce(F.array_contains("scope", F.col("primary_solution")), F.lit(False))


def passes(values: Column, allowed: Column) -> Column:
    """Any overlap; a null list allows everything, an empty one nothing."""
    return F.when(allowed.isNull(), F.lit(True)).otherwise(F.arrays_overlap(values, allowed))


def active() -> Column:
    """Neither deprecated nor expired, and effective_on within both dates (inclusive; null is open)."""
    on = F.col("effective_on")
    return ~F.col("status").isin("deprecated", "expired") & F.coalesce(on >= F.col("effective_from"), F.lit(True)) & F.coalesce(on <= F.col("effective_until"), F.lit(True))


def operational_filter(pairs: DataFrame, filters: dict[str, Column]) -> Column:
    """Whether a candidate passes the first-generation filters; a filter is a Column per pair.

    Without statuses only approved ones pass. Expiry looks at effective_until alone. A null list filters nothing, an empty one
    lets nothing through. A filter of another name is an error."""
    unknown = set(filters) - set(FILTER_KEYS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    ok = F.array_contains(F.coalesce(filters.get("statuses", F.lit(None)), F.array(F.lit("approved"))), F.col("status"))
    if "effective_on" in filters:
        ok &= F.coalesce(filters["effective_on"] <= F.col("effective_until"), F.lit(True))
    if "document_types" in filters:
        ok &= passes(F.array("document_type"), filters["document_types"])
    for name, values in (("industries", "industries"), ("solution_ids", "applicable"), ("tags", "tags")):
        if name in filters:
            ok &= passes(F.col(values), filters[name])
    return ok


def _taxonomy() -> dict[str, Column]:
    """Conditions against a candidate's type, industries and tags; what is empty on either side is no mismatch."""
    type_ = _asked("ask_types") & ~F.array_contains("ask_types", F.col("document_type"))
    industry = _asked("ask_industries") & _asked("industries") & ~_meet("industries", "ask_industries")
    tag = _asked("ask_tags") & _asked("tags") & ~_meet("tags", "ask_tags")
    return {"type": type_, "industry": industry, "tag": tag}


def runtime_reasons() -> Column:
    """Ordered reasons against a candidate at run time; an empty scope on either side is no mismatch."""
    t = _taxonomy()
    beyond = ~_is(GLOBAL) & _asked("applicable") & _asked("scope") & ~_inside("applicable", "scope")
    return _reasons(not_effective=~active(), document_type_not_allowed=t["type"], industry_mismatch=t["industry"], tag_mismatch=t["tag"], excluded_solution_conflict=_meet("excluded", "scope"), solution_scope_mismatch=beyond)


def boundary_reasons(forbidden: Column | None = None) -> Column:
    """Ordered reasons why a candidate lies beyond the gold boundary; an overlap with the scope is enough here.

    forbidden: whether the document is forbidden, in place of the column."""
    bound = ~_is(GLOBAL)
    return _reasons(
        forbidden_document_id=F.col("forbidden_document") if forbidden is None else forbidden, candidate_excludes_operational_scope=_meet("excluded", "scope"),
        candidate_outside_operational_scope=bound & _asked("scope") & ~_meet("applicable", "scope"), candidate_overlaps_forbidden_solution_scope=bound & _meet("applicable", "forbidden"),
    )


def document_filters() -> dict[str, Column]:
    """The evaluation's filters (true: passes). Unlike at run time, a document without industries or tags fails a case that asks."""
    return {
        "document_type": ~_asked("ask_types") | F.array_contains("ask_types", F.col("document_type")), "industry": ~_asked("ask_industries") | _meet("industries", "ask_industries"),
        "tags": ~_asked("ask_tags") | _meet("tags", "ask_tags"), "effective_on": active(), "excluded_solution": ~_meet("excluded", "scope"),
    }


def passes_document_filters() -> Column:
    f = document_filters()
    return f["document_type"] & f["industry"] & f["tags"] & f["effective_on"]


def status_class() -> Column:
    """A status by what the filters ask of it: approved, neither deprecated nor expired, or one of these."""
    return F.when(F.col("status").isin("deprecated", "expired"), "expired").when(F.col("status") == "approved", F.col("status")).when(F.col("status").isNotNull(), "other")


def chunk_eligible() -> Column:
    """Whether a chunk may be indexed for a case: filters, no excluded solution, applicable within the scope unless global."""
    t = _taxonomy()
    return active() & ~t["type"] & ~t["industry"] & ~t["tag"] & ~_meet("excluded", "scope") & (_is(GLOBAL) | _inside("applicable", "scope"))


def strategy_reasons(strategy: str) -> Column:
    """Reasons of one of the five scope strategies; a candidate is allowed if there is none."""
    excluded = {"candidate_excludes_operational_scope": _meet("excluded", "scope")}
    beyond = _asked("scope") & ~_inside("applicable", "scope")
    primary = ~_primary_in_scope()
    subset, t = "candidate_applicable_scope_not_subset_of_operational_scope", _taxonomy()
    if strategy == "S0":
        return _reasons(**excluded, candidate_outside_operational_scope=~_is(GLOBAL) & _asked("scope") & ~_meet("applicable", "scope"))
    if strategy == "S1":
        return _reasons(**excluded, **{subset: ~_is(GLOBAL) & beyond})
    if strategy == "S2":
        return _reasons(**excluded, primary_solution_not_in_operational_scope=(_is(SPECIFIC) | _is(MULTI)) & primary, **{subset: (_is(MULTI) | _is(CROSS)) & beyond})
    if strategy == "S3":
        return _reasons(**excluded, **{subset: ~_is(GLOBAL) & beyond}, document_type_not_allowed=t["type"], industry_not_allowed=t["industry"], tag_not_allowed=t["tag"], document_not_active=~active())
    if strategy == "S4":
        return boundary_reasons()
    raise ValueError(f"unknown strategy: {strategy}")


def runtime_rule(rule: str) -> Column:
    """struct<reasons, priority, channel> of one of the six runtime rules; a candidate is allowed if there is no reason."""
    t = _taxonomy()
    base = {"inactive_document": ~active(), "document_type_not_allowed": t["type"], "industry_not_allowed": t["industry"], "tag_not_allowed": t["tag"], "candidate_excludes_operational_scope": _meet("excluded", "scope")}
    own, meets = _primary_in_scope(), _meet("applicable", "scope")
    specific, multi, cross, everywhere = _is(SPECIFIC) & own, _is(MULTI) & own, _is(CROSS) & meets, _is(GLOBAL)
    last, channel = F.lit(99), F.lit(None).cast("string")
    ranked = F.when(specific, 0).when(multi, 2).when(cross, 3).when(everywhere, 4).otherwise(99)
    if rule in ("R0", "R5"):
        reasons, priority = F.concat(_reasons(**base), boundary_reasons()), last
    elif rule == "R1":
        reasons, priority = _reasons(**base, strict_subset_mismatch=~everywhere & ~_inside("applicable", "scope")), F.when(everywhere, 4).otherwise(99)
    elif rule == "R2":
        reasons, priority = _reasons(**base, primary_solution_not_in_operational_scope=(_is(SPECIFIC) | _is(MULTI)) & ~own, cross_cutting_without_scope_overlap=_is(CROSS) & ~meets), ranked
    elif rule == "R3":
        channel = F.when(specific, "solution_evidence").when(cross | everywhere, "cross_cutting_evidence")
        reasons, priority = _reasons(**base, no_runtime_safe_channel=~(specific | cross | everywhere)), F.when(specific, 0).when(cross, 3).when(everywhere, 4).otherwise(99)
    elif rule == "R4":
        reasons, priority = _reasons(**base, no_scope_specific_priority_match=~(specific | multi | cross | everywhere)), ranked
    else:
        raise ValueError(f"unknown rule: {rule}")
    return F.struct(reasons.alias("reasons"), priority.alias("priority"), channel.alias("channel"))


def mode_allows(mode: Column, deny_excluded: bool = False) -> Column:
    """Whether a label mode lets the candidate through; in the earlier contract an excluded overlap denies first."""
    by_mode = F.when(mode == "primary_in_scope", _primary_in_scope()).when(mode == "full_applicable_scope", _asked("applicable") & _inside("applicable", "scope")).when(mode == "global_reusable", F.lit(True)).when(mode == "any_applicable_scope", _meet("applicable", "scope"))
    return ~_meet("excluded", "scope") & by_mode if deny_excluded else by_mode


def effective_labels(labels: DataFrame, document: str, chunk: str) -> DataFrame:
    """A chunk's mode is its override or its document's default; `source` tells which.

    labels: the document, default_mode, chunk_overrides array<struct<chunk, mode>>."""
    x = labels.select(document, "default_mode", F.explode("chunk_overrides").alias("o"))
    label = effective_label("o.mode")
    return x.select(document, F.col("o.chunk").alias(chunk), "default_mode", label["mode"].alias("mode"), label["source"].alias("source"))


def effective_label(override: str) -> dict[str, Column]:
    """mode and source of rows that have a chunk's override beside default_mode."""
    return {"mode": F.coalesce(override, "default_mode"), "source": F.when(F.col(override).isNull(), "document_default").otherwise("chunk_override")}


def pairwise(pairs: DataFrame, mode: Column) -> DataFrame:
    """pairs with every filter by itself, scope_allowed, full_allowed, violating, false_exclusion, false_inclusion and conflict."""
    f = document_filters()
    out = pairs.withColumns({f"pass_{n}": c for n, c in f.items()}).withColumn("scope_allowed", mode_allows(mode)).withColumn("violating", F.size(boundary_reasons()) > 0)
    full = F.col("scope_allowed")
    for n in f:
        full &= F.col(f"pass_{n}")
    rel, bad = F.col("relevant"), F.col("violating")
    return out.withColumn("full_allowed", full).withColumn("false_exclusion", rel & ~F.col("full_allowed")).withColumn("false_inclusion", bad & F.col("full_allowed")).withColumn("conflict", rel & bad)


def _rate(a, b) -> Column:
    return F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)


def tally(pairs: DataFrame, groups: list[str], allowed: list[str]) -> DataFrame:
    """What confusion() reads of pairs, each distinct row once with its number of pairs, n; several of the `allowed` columns at once."""
    return pairs.groupBy(*groups, "relevant", "violating", "conflict", *allowed).agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame, allowed: str, groups: list[str]) -> DataFrame:
    """Counts, retention of relevant and removal of violating pairs, for all pairs and by each group column alone.

    pairs: a tally(), with booleans relevant, violating, conflict and the one named `allowed`. Empty denominators give null."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rel, bad, ok = F.col("relevant"), F.col("violating"), F.col(allowed)
    g = pairs.groupingSets([[F.col(x)] for x in groups] + [[]], *groups)
    got = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), n(rel).alias("n_relevant"), n(rel & ok).alias("n_kept"), n(bad).alias("n_violating"), n(bad & ~ok).alias("n_removed"), n(F.col("conflict")).alias("n_conflict"))
    got = got.withColumn("n_false_exclusion", F.col("n_relevant") - F.col("n_kept")).withColumn("n_false_inclusion", F.col("n_violating") - F.col("n_removed"))
    return got.withColumn("retention", _rate("n_kept", "n_relevant")).withColumn("removal", _rate("n_removed", "n_violating")).drop("n_kept", "n_removed")


def confusion_of_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """The table of confusion() from counts that were taken apart: rows of the group columns with n_pairs, n_within (pairs that do not
    violate), n_allowed_violating, n_relevant, n_kept (relevant and allowed) and n_conflict, to be added up."""
    names = ["n_pairs", "n_within", "n_allowed_violating", "n_relevant", "n_kept", "n_conflict"]
    fine = counts.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in names])
    got = fine.groupingSets([[F.col(x)] for x in groups] + [[]], *groups).agg(*[F.sum(c).alias(c) for c in names])
    got = got.withColumn("n_violating", F.col("n_pairs") - F.col("n_within")).withColumn("n_removed", F.col("n_violating") - F.col("n_allowed_violating"))
    got = got.withColumn("n_false_exclusion", F.col("n_relevant") - F.col("n_kept")).withColumn("n_false_inclusion", F.col("n_allowed_violating"))
    got = got.withColumn("retention", _rate("n_kept", "n_relevant")).withColumn("removal", _rate("n_removed", "n_violating"))
    return got.select(*groups, "n_pairs", "n_relevant", "n_violating", "n_conflict", "n_false_exclusion", "n_false_inclusion", "retention", "removal")


def rejection_counts(pairs: DataFrame, by: str, reasons: Column) -> DataFrame:
    return pairs.select(by, F.explode(reasons).alias("reason")).groupBy(by, "reason").agg(F.count("*").alias("n_rejected"))


def scope_violations(universe: list[int]) -> Column:
    """Ordered reasons against a candidate's scope columns."""
    known = F.array(*[F.lit(u).cast("long") for u in universe])
    n, primary = F.size("applicable"), F.col("primary_solution")
    size = F.when(_is(SPECIFIC), n == 1).when(_is(MULTI), n >= 2).when(_is(GLOBAL), n == len(universe)).otherwise(n >= 1)
    return _reasons(
        primary_not_applicable=primary.isNotNull() & ~F.array_contains("applicable", primary), sides_overlap=_meet("applicable", "excluded"),
        unknown_applicable=F.size(F.array_except("applicable", known)) > 0, unknown_excluded=F.size(F.array_except("excluded", known)) > 0, wrong_size=~size, primary_missing=~_is(GLOBAL) & primary.isNull(),
    )


def filter_attribution(pairs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Pairs that a filter denies (filters: name -> boolean column that is true if it passes), split by relevant and violating."""
    named = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(n)) for n, c in filters.items()]))
    each = pairs.select("relevant", "violating", F.explode(named).alias("filter"))
    return each.groupBy("filter").agg(F.count("*").alias("n_denied"), F.count_if("relevant").alias("n_relevant"), F.count_if("violating").alias("n_violating"))


def mode_satisfiability(pairs: DataFrame, key: list[str], frozen: str, modes: list[str] = MODES, filtered: bool = False) -> DataFrame:
    """Per candidate: for each mode the relevant pairs it denies (out_) and the violating ones it allows (in_); the modes with neither.

    filtered: the document filters have to pass as well."""
    rel, bad = F.col("relevant"), F.col("violating")
    out = []
    for m in modes:
        ok = mode_allows(F.lit(m), deny_excluded=True)
        ok = ok & passes_document_filters() if filtered else ok
        out += [F.count_if(rel & ~ok).alias(f"out_{m}"), F.count_if(bad & ok).alias(f"in_{m}")]
    got = pairs.groupBy(*key).agg(F.first(frozen).alias("frozen_mode"), *out)
    perfect = F.array_compact(F.array(*[F.when((F.col(f"out_{m}") == 0) & (F.col(f"in_{m}") == 0), F.lit(m)) for m in modes]))
    got = got.withColumn("perfect_modes", perfect)
    return got.withColumn("frozen_is_perfect", F.array_contains("perfect_modes", F.col("frozen_mode"))).withColumn("other_is_perfect", F.exists("perfect_modes", lambda m: m != F.col("frozen_mode"))).withColumn("none_is_perfect", F.size("perfect_modes") == 0)


def error_candidates(pairs: DataFrame, satisfiability: DataFrame, key: str, case: str) -> DataFrame:
    """Candidates with a false pair: how many of either kind, in how many cases (the pairs themselves say which), and what causes them."""
    wrong = pairs.where(F.col("false_exclusion") | F.col("false_inclusion"))
    got = wrong.groupBy(key).agg(F.count_if("false_exclusion").alias("n_false_exclusion"), F.count_if(~F.col("false_exclusion")).alias("n_false_inclusion"), F.count_distinct(case).alias("n_error_cases"))
    cause = F.when(F.col("none_is_perfect"), "C_three_mode_schema_unsatisfiable").otherwise("A_blind_authoring_misclassification")
    return got.join(satisfiability.select(key, "none_is_perfect"), key).withColumn("root_cause", cause).drop("none_is_perfect")


def observable_conflicts(pairs: DataFrame, case: str, chunk: str, samples: int = 3) -> DataFrame:
    """Signatures of what can be seen at run time that hold both allowed and denied pairs, with counts and the first pairs of either."""
    overlap = F.when(~_asked("applicable"), "none").when(_inside("applicable", "scope"), "full_subset").when(_meet("applicable", "scope"), "partial_overlap").otherwise("empty_overlap")
    seen = pairs.select(F.col("scope_type"), _primary_in_scope().alias("primary_in_scope"), overlap.alias("overlap"), _meet("excluded", "scope").alias("excluded_conflict"), passes_document_filters().alias("eligible"), (F.size(boundary_reasons()) == 0).alias("ok"), case, chunk)
    sign = ["scope_type", "primary_in_scope", "overlap", "excluded_conflict", "eligible"]
    seen = durable(seen, "signatures")  # narrow, and read twice
    # the first pairs of either kind without gathering a signature's pairs: a signature is a hot key
    n = seen.groupBy(*sign).agg(F.count_if("ok").alias("n_allow"), F.count_if(~F.col("ok")).alias("n_deny")).where("n_allow > 0 and n_deny > 0")
    part = F.pmod(F.xxhash64(case, chunk), F.lit(64))
    local = seen.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy(*sign, "ok", "part").orderBy(case, chunk))).where(F.col("n") <= samples)
    firsts = local.withColumn("n", F.row_number().over(Window.partitionBy(*sign, "ok").orderBy(case, chunk))).where(F.col("n") <= samples)
    name = F.concat_ws(":", F.col(case).cast("string"), F.col(chunk).cast("string"))
    of = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("n", name.alias("name"))))), lambda x: x["name"]), ",")
    return n.join(firsts.groupBy(*sign).agg(of(F.col("ok")).alias("allow_samples"), of(~F.col("ok")).alias("deny_samples")), sign)


def heterogeneous_documents(satisfiability: DataFrame, document: str) -> DataFrame:
    """Documents whose chunks have different sets of perfect modes (empty sets aside)."""
    sets = satisfiability.where(F.size("perfect_modes") > 0).groupBy(document).agg(F.count_distinct(F.array_join("perfect_modes", ",")).alias("n_sets"))
    return sets.where("n_sets > 1")


def schema_variants(satisfiability: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Per variant of modes: a candidate takes the first perfect one in the variant's order, else the first of all.

    Counts of perfect, unsatisfiable and ambiguous candidates and of false pairs; place 1 is the variant with fewest unsatisfiable
    candidates, then fewest modes, then the first by name."""
    out = []
    for name, modes in variants.items():
        perfect = F.array_compact(F.array(*[F.when((F.col(f"out_{m}") == 0) & (F.col(f"in_{m}") == 0), F.lit(m)) for m in modes]))
        chosen = F.coalesce(F.get(perfect, F.lit(0)), F.lit(modes[0]))
        errors = lambda side: F.element_at(F.create_map(*[x for m in modes for x in (F.lit(m), F.col(f"{side}_{m}"))]), chosen)  # noqa: B023, E731
        out.append(F.struct(F.lit(name).alias("variant"), F.lit(len(modes)).cast("long").alias("n_modes"), F.size(perfect).alias("n"), errors("out").alias("x"), errors("in").alias("y")))
    each = satisfiability.select(F.explode(F.array(*out)).alias("v")).select("v.*")
    got = each.groupBy("variant", "n_modes").agg(F.count_if(F.col("n") > 0).alias("n_perfect"), F.count_if(F.col("n") == 0).alias("n_unsatisfiable"), F.count_if(F.col("n") > 1).alias("n_ambiguous"), F.sum("x").alias("n_false_exclusion"), F.sum("y").alias("n_false_inclusion"))
    return got.withColumn("place", F.row_number().over(Window.orderBy("n_unsatisfiable", "n_modes", "variant")).cast("long"))  # a row a variant


def attempt_comparison(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Two confusion tables side by side: rates of both and the differences of their counts."""
    pick = lambda df, tag: df.select(*by, *[F.col(c).alias(f"{tag}_{c}") for c in ("retention", "removal", "n_false_exclusion", "n_false_inclusion")])
    a, b = pick(old, "old"), pick(new, "new")
    on = [a[c].eqNullSafe(b[c]) for c in by]
    j = a.join(b, on, "full").select(*[F.coalesce(a[c], b[c]).alias(c) for c in by], "old_retention", "new_retention", "old_removal", "new_removal", (F.col("new_n_false_exclusion") - F.col("old_n_false_exclusion")).alias("false_exclusion_delta"), (F.col("new_n_false_inclusion") - F.col("old_n_false_inclusion")).alias("false_inclusion_delta"))
    return j
