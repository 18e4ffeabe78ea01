"""Queries of scopes, eligibility, boundaries and label confusion, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eligibility as e
from ..operators import joins
from ..shared import durable
from . import roles
from .roles import ACTIVE_SQL, BOUNDARY_SQL, RUNTIME_SQL, SQL, told_sql

_PAIRS = f"{SQL}, {told_sql('met')}"


def _pairs(spark, d):
    return roles.pairs(spark, d)


def _labelled(spark, d):
    """Pairs with the effective label of their chunk."""
    return _pairs(spark, d).withColumns(e.effective_label("override_mode"))


_MODE = "coalesce(override_mode, default_mode)"
_OWN = "coalesce(list_contains(scope, primary_solution), false)"
_BAD = f"({BOUNDARY_SQL}) <> ''"


def _allows(mode: str, deny: bool = False) -> str:
    by = f"CASE {mode} WHEN 'primary_in_scope' THEN {_OWN} WHEN 'full_applicable_scope' THEN len(applicable) > 0 AND list_has_all(scope, applicable) WHEN 'any_applicable_scope' THEN list_has_any(applicable, scope) ELSE true END"
    return f"(NOT list_has_any(excluded, scope) AND {by})" if deny else f"({by})"


_FILTERS = {
    "document_type": "(len(ask_types) = 0 OR list_contains(ask_types, document_type))", "industry": "(len(ask_industries) = 0 OR list_has_any(industries, ask_industries))",
    "tags": "(len(ask_tags) = 0 OR list_has_any(tags, ask_tags))", "effective_on": ACTIVE_SQL, "excluded_solution": "(NOT list_has_any(excluded, scope))",
}
_PAIRWISE = f"""{_PAIRS}, pw AS (SELECT *, {_MODE} AS mode, CASE WHEN override_mode IS NULL THEN 'document_default' ELSE 'chunk_override' END AS source, {_BAD} AS violating, {_allows(_MODE)} AS scope_allowed, {_allows(_MODE)} AND {" AND ".join(_FILTERS.values())} AS full_allowed FROM told)"""


def _pairwise(spark, d):
    return e.pairwise(_labelled(spark, d), F.col("mode"))


def operational_filter(spark, d):
    """Per case how many chunks pass with all filters, with an empty list (none) and with null lists (no filter)."""
    p = _pairs(spark, d)
    every = e.operational_filter(p, {"effective_on": F.col("effective_on"), "document_types": F.col("ask_types"), "industries": F.col("ask_industries"), "solution_ids": F.when(F.size("scope") > 0, F.col("scope")), "tags": F.when(F.size("ask_tags") > 0, F.col("ask_tags"))})
    loose = e.operational_filter(p, {"statuses": F.array(F.lit("approved"), F.lit("draft")), "tags": F.lit(None).cast("array<string>")})
    return p.groupBy("q").agg(F.count_if(every).alias("n_all"), F.count_if(loose).alias("n_loose"))


def runtime_eligibility(spark, d):
    return _pairs(spark, d).groupBy("q", F.array_join(e.runtime_reasons(), ",").alias("reasons")).agg(F.count("*").alias("n_candidates"))


def rejection_counts(spark, d):
    return e.rejection_counts(_pairs(spark, d), "q", e.runtime_reasons())


def boundary_decision(spark, d):
    return _pairs(spark, d).groupBy("q", F.array_join(e.boundary_reasons(), ",").alias("reasons")).agg(F.count("*").alias("n_candidates"))


def scope_strategy(spark, d):
    p = _pairs(spark, d)
    x = F.array(*[F.struct(F.lit(s).alias("strategy"), F.array_join(e.strategy_reasons(s), ",").alias("reasons")) for s in e.STRATEGIES])
    return p.select(F.explode(x).alias("x")).groupBy("x.strategy", "x.reasons").agg(F.count("*").alias("n"))


def runtime_rule(spark, d):
    p = _pairs(spark, d)
    x = F.array(*[F.struct(F.lit(r).alias("rule"), e.runtime_rule(r).alias("y")) for r in e.RULES])
    y = p.select(F.explode(x).alias("x")).select("x.rule", "x.y.*").where(F.size("reasons") == 0)
    return y.groupBy("rule", F.col("priority").cast("long").alias("priority"), "channel").agg(F.count("*").alias("n_allowed"))


def scope_checks(spark, d):
    """Violations of chunk scopes; every tenth chunk's scope is spoiled for the purpose, by its key."""
    c = roles.chunks(spark, d).withColumn("applicable", F.when(F.col("chunk") % 10 == 4, F.array_union("applicable", F.array(F.col("doc") % 7))).otherwise(F.col("applicable")))
    c = c.withColumn("primary_solution", F.when(F.col("chunk") % 10 == 7, F.lit(None).cast("long")).otherwise(F.col("primary_solution"))).withColumn("v", e.scope_violations(roles.SOLUTIONS))
    return c.select("chunk", F.array_join("v", ",").alias("violations")).where("violations <> ''")


def scope_cardinality(spark, d):
    """Documents by number of solutions, and whether all chunks have their document's scope."""
    docs = roles.chunks(spark, d).groupBy("doc", "document_type", F.size("document_applicable").cast("long").alias("n_solutions")).agg(F.every(F.array_sort("applicable") == F.array_sort("document_applicable")).alias("inherited"))
    return docs.groupBy("document_type", "n_solutions").agg(F.count("*").alias("n_documents"), F.count_if("inherited").alias("n_inherited"))


def effective_labels(spark, d):
    x = roles.chunks(spark, d).groupBy("doc").agg(F.first("default_mode").alias("default_mode"), F.collect_list(F.struct("chunk", F.col("override_mode").alias("mode"))).alias("chunk_overrides"))
    return e.effective_labels(x, "doc", "chunk").groupBy("mode", "source").agg(F.count("*").alias("n_chunks"))


def mode_allows(spark, d):
    """Allowed pairs by mode, as the later contract has it and as the earlier."""
    p = _pairs(spark, d)
    x = F.array(*[F.struct(F.lit(m).alias("mode"), e.mode_allows(F.lit(m)).alias("new"), e.mode_allows(F.lit(m), True).alias("old")) for m in e.MODES])
    return p.select(F.explode(x).alias("x")).groupBy("x.mode").agg(F.count_if("x.new").alias("n_allowed"), F.count_if("x.old").alias("n_allowed_before"))


def pairwise_confusion(spark, d):
    """Every pair of all cases by all chunks that is wrong or conflicting, with its filters.

    False inclusions pass all filters, so classes and days tell them as they tell eligible pairs; what gold or a forbidden document decides
    is told of these few pairs one by one."""
    cases, q, labels, c, few = _label_sides(spark, d)
    by = ["scope_type", "mode", "source"]
    pairs = _wrongly_allowed(q, c)
    few = durable(few, "gold-pairs")
    of_classes = joins.dated_pairs(q, c, pairs, "effective_on", "effective_from", "effective_until", "q", "chunk", by, few)
    yes, no, passed = F.lit(True), F.lit(False), [f"pass_{n}" for n in _FILTERS]
    told = {"relevant": no, "violating": yes, "scope_allowed": yes, "full_allowed": yes} | dict.fromkeys(passed, yes) | {"false_exclusion": no, "false_inclusion": yes, "conflict": no}
    columns = ["q", "chunk", *by, *told]
    w = e.pairwise(few.join(labels, "chunk").join(cases, "q"), F.col("mode")).where("false_exclusion or false_inclusion or conflict")
    return of_classes.withColumns(told).select(columns).unionByName(w.select(columns))


def confusion_metrics(spark, d):
    by = ["q", "mode", "scope_type", "source"]
    p = durable(e.tally(_pairwise(spark, d), by, ["scope_allowed", "full_allowed"]), "tally")
    return e.confusion(p, "scope_allowed", by).withColumn("allowed_by", F.lit("scope")).unionByName(e.confusion(p, "full_allowed", by).withColumn("allowed_by", F.lit("full")))


def filter_attribution(spark, d):
    return e.filter_attribution(_pairwise(spark, d), {n: f"pass_{n}" for n in _FILTERS} | {"solution_scope": "scope_allowed"})


def _satisfiable(spark, d):
    return e.mode_satisfiability(_labelled(spark, d).withColumn("violating", F.size(e.boundary_reasons()) > 0), ["doc", "chunk"], "mode")


def mode_satisfiability(spark, d):
    return _satisfiable(spark, d).withColumn("perfect_modes", F.array_join("perfect_modes", ","))


def error_candidates(spark, d):
    return e.error_candidates(_pairwise(spark, d), _satisfiable(spark, d), "chunk", "q")


def observable_conflicts(spark, d):
    return e.observable_conflicts(_pairs(spark, d), "q", "chunk")


def heterogeneous_documents(spark, d):
    return e.heterogeneous_documents(_satisfiable(spark, d), "doc")


VARIANTS = {"D0": list(e.MODES), "D1": [*e.MODES, "any_applicable_scope"], "D2": ["primary_in_scope", "any_applicable_scope", "full_applicable_scope", "global_reusable"]}
_ALL_MODES = VARIANTS["D1"]


def schema_variants(spark, d):
    pairs = _labelled(spark, d).withColumn("violating", F.size(e.boundary_reasons()) > 0)
    return e.schema_variants(e.mode_satisfiability(pairs, ["doc", "chunk"], "mode", _ALL_MODES, filtered=True), VARIANTS)


def attempt_comparison(spark, d):
    """Two label rounds: document defaults alone, and with overrides."""
    first = e.pairwise(_labelled(spark, d), F.col("default_mode")).withColumnRenamed("full_allowed", "old_allowed").drop("scope_allowed")
    p = durable(e.tally(e.pairwise(first, F.col("mode")), ["scope_type"], ["old_allowed", "full_allowed"]), "tally")
    return e.attempt_comparison(e.confusion(p, "old_allowed", ["scope_type"]), e.confusion(p, "full_allowed", ["scope_type"]), ["scope_type"])


def runtime_filters():
    """What the runtime rules ask of lists; a document without industries, tags or solutions is no mismatch."""
    size = F.size
    return [
        joins.Overlap("type", F.col("ask_types"), F.array("document_type"), size("ask_types") > 0),
        joins.Overlap("industry", F.col("ask_industries"), F.col("industries"), size("ask_industries") > 0, size("industries") == 0),
        joins.Overlap("tag", F.col("ask_tags"), F.col("tags"), size("ask_tags") > 0, size("tags") == 0),
        joins.Overlap("scope", F.col("scope"), F.col("applicable"), size("scope") > 0, (F.col("scope_type") == e.GLOBAL) | (size("applicable") == 0)),
    ]


#: What rules other than those of dates read of a case and of a chunk.
_CASE_LISTS = ["scope", "ask_types", "ask_industries", "ask_tags"]
_CHUNK_LISTS = ["document_type", "scope_type", "primary_solution", "applicable", "excluded", "industries", "tags"]


def _open(chunks, *dates):
    """chunks without these dates."""
    return chunks.withColumns({c: F.lit(None).cast("date") for c in dates or ("effective_from", "effective_until")})


def _dated_pairs(cases, chunks, filters, holds):
    """Pairs (q, chunk) that pass; `holds` is asked of classes with open dates, dates are compared beside it."""
    q = cases.select("q", "effective_on", *_CASE_LISTS).withColumn("qc", joins.class_of(_CASE_LISTS))
    c = chunks.select("chunk", "status", "effective_from", "effective_until", *_CHUNK_LISTS).withColumn("dc", joins.class_of([*_CHUNK_LISTS, e.status_class().alias("status")]))
    pairs = joins.class_pairs(q, _open(c), filters, holds)
    return joins.dated_pairs(q, c, pairs, "effective_on", "effective_from", "effective_until", "q", "chunk").select("q", "chunk")


def eligible_pairs(spark, d):
    """All cases by all chunks: the pairs without a runtime reason."""
    return _dated_pairs(roles.cases(spark, d), roles.chunks(spark, d), runtime_filters(), F.size(e.runtime_reasons()) == 0)


def operational_filters():
    """(filters on lists, condition on pairs) of the first generation: an empty list of types or industries lets nothing through."""
    yes = F.lit(True)
    asked = {"effective_on": F.col("effective_on"), "document_types": F.col("ask_types"), "industries": F.col("ask_industries"), "solution_ids": F.when(F.size("scope") > 0, F.col("scope")), "tags": F.when(F.size("ask_tags") > 0, F.col("ask_tags"))}
    filters = [
        joins.Overlap("document_types", F.col("ask_types"), F.array("document_type"), yes), joins.Overlap("industries", F.col("ask_industries"), F.col("industries"), yes),
        joins.Overlap("solution_ids", F.col("scope"), F.col("applicable"), F.size("scope") > 0), joins.Overlap("tags", F.col("ask_tags"), F.col("tags"), F.size("ask_tags") > 0),
    ]
    return filters, e.operational_filter(None, asked)


def operational_pairs(spark, d):
    """All cases by all chunks under the first-generation filters: an empty list lets nothing through. They read no effective_from."""
    return _dated_pairs(roles.cases(spark, d), _open(roles.chunks(spark, d), "effective_from"), *operational_filters())


def effective_documents(spark, d):
    """Documents with the cases whose date lies within theirs, and the first and last of these dates."""
    docs = roles.chunks(spark, d).groupBy("doc").agg(F.min("effective_from").alias("effective_from"), F.min("effective_until").alias("effective_until"))
    got = joins.interval_totals(docs, "effective_from", "effective_until", roles.cases(spark, d).select("q", "effective_on"), "effective_on", "q")
    return got.select("doc", F.col("n").alias("n_cases"), F.col("first").alias("first_on"), F.col("last").alias("last_on"), F.col("total").alias("sum_q"))


def _label_sides(spark, d):
    """cases, these with their classes, labelled chunks, these with their classes, and the few pairs (q, chunk, relevant, forbidden_document)
    that gold tells of: expected ones, and those of forbidden documents."""
    labels = roles.chunks(spark, d).withColumn("mode", F.coalesce("override_mode", "default_mode")).withColumn("source", F.when(F.col("override_mode").isNull(), "document_default").otherwise("chunk_override"))
    cases, (want, bad) = roles.cases(spark, d), roles.gold(spark, d)
    lists = [*_CASE_LISTS, "forbidden"]
    q = cases.select("q", "effective_on", *lists).withColumn("qc", joins.class_of(lists))
    c = labels.select("chunk", "status", "effective_from", "effective_until", "mode", "source", *_CHUNK_LISTS).withColumn("dc", joins.class_of([*_CHUNK_LISTS, "mode", "source", e.status_class().alias("status")]))
    said = want.where("kind = 'chunk'").select("q", "chunk").unionByName(want.where("kind = 'document'").select("q", "doc").join(labels.select("doc", "chunk"), "doc").select("q", "chunk")).distinct()
    shut = bad.join(labels.select("doc", "chunk"), "doc").select("q", "chunk")
    few = said.withColumn("relevant", F.lit(True)).join(shut.withColumn("forbidden_document", F.lit(True)), ["q", "chunk"], "full").fillna(False, ["relevant", "forbidden_document"])
    return cases, q, labels, c, few


def _full():
    return e.passes_document_filters() & e.mode_allows(F.col("mode"), deny_excluded=True)


def _clear():
    return F.size(e.boundary_reasons(F.lit(False))) == 0  # forbidden documents aside, which stand among the few


def _wrongly_allowed(q, c):
    """Pairs of classes that pass full filters and violate the boundary, dates and forbidden documents aside."""
    size = F.size
    asked = [
        joins.Overlap("type", F.col("ask_types"), F.array("document_type"), size("ask_types") > 0), joins.Overlap("industry", F.col("ask_industries"), F.col("industries"), size("ask_industries") > 0),
        joins.Overlap("tag", F.col("ask_tags"), F.col("tags"), size("ask_tags") > 0),
    ]
    return joins.class_pairs(q, _open(c), asked, _full() & ~_clear())


def all_pairs_confusion(spark, d):
    """Confusion of full filters over all cases by all chunks. Pairs that are allowed, and those that do not violate, are counted by classes
    and days; the rest of the counts follows from the numbers of cases and chunks, and from the few pairs with gold."""
    size = F.size
    cases, q, labels, c, few = _label_sides(spark, d)
    by, full, violating = ["q", "mode", "scope_type", "source"], _full(), size(e.boundary_reasons()) > 0
    clear = _clear()
    allowed = joins.dated_totals(q.select("q", "qc", "effective_on"), c, _wrongly_allowed(q, c), "effective_on", "effective_from", "effective_until", by[1:])
    scope = [joins.Overlap("scope", F.col("scope"), F.col("applicable"), size("scope") > 0, F.col("scope_type") == e.GLOBAL)]
    sizes = c.groupBy("dc", *by[1:]).agg(F.count("*").alias("n"))
    within = joins.class_pairs(q, _open(c), scope, clear).join(sizes, "dc").groupBy("qc", *by[1:]).agg(F.sum("n").alias("n")).join(q.select("q", "qc"), "qc")
    few = few.join(labels, "chunk").join(cases, "q")
    classes = [r.asDict() for r in labels.groupBy(*by[1:]).agg(F.count("*").alias("n")).collect()]  # modes by scope types by sources
    every = cases.select("q", F.explode(F.array(*[F.struct(*[F.lit(c[x]).alias(x) for x in by[1:]], F.lit(c["n"]).cast("long").alias("n")) for c in classes])).alias("c")).select("q", "c.*")
    zero = F.lit(0).cast("long")
    names = ["n_pairs", "n_allowed_violating", "n_within", "n_relevant", "n_kept", "n_conflict"]
    rows = lambda df, **n: df.select(*by, *[n.get(x, zero).alias(x) for x in names])
    counted = [
        rows(every, n_pairs=F.col("n")), rows(allowed, n_allowed_violating=F.col("n")), rows(within, n_within=F.col("n")),
        rows(few.groupBy(*by).agg(F.count_if(F.col("forbidden_document") & clear).alias("n"), F.count_if(F.col("forbidden_document") & clear & full).alias("v")), n_within=-F.col("n"), n_allowed_violating=F.col("v")),
        rows(few.groupBy(*by).agg(F.count_if("relevant").alias("r"), F.count_if(F.col("relevant") & full).alias("k"), F.count_if(F.col("relevant") & violating).alias("c")), n_relevant=F.col("r"), n_kept=F.col("k"), n_conflict=F.col("c")),
    ]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return e.confusion_of_counts(out, by)


_NAMES = "eligible_pairs operational_pairs effective_documents all_pairs_confusion operational_filter runtime_eligibility rejection_counts boundary_decision scope_strategy runtime_rule scope_checks scope_cardinality effective_labels mode_allows pairwise_confusion confusion_metrics filter_attribution mode_satisfiability error_candidates observable_conflicts heterogeneous_documents schema_variants attempt_comparison"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_TYPE = "len(ask_types) > 0 AND NOT list_contains(ask_types, document_type)"
_INDUSTRY = "len(ask_industries) > 0 AND len(industries) > 0 AND NOT list_has_any(industries, ask_industries)"
_TAG = "len(ask_tags) > 0 AND len(tags) > 0 AND NOT list_has_any(tags, ask_tags)"
_EXC = "list_has_any(excluded, scope)"
_BEYOND = "len(scope) > 0 AND NOT list_has_all(scope, applicable)"
_SUBSET = "candidate_applicable_scope_not_subset_of_operational_scope"


def _named(**conditions: str) -> str:
    return "concat_ws(','," + ", ".join(f" CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items()) + ")"


_STRATEGY = {
    "S0": _named(candidate_excludes_operational_scope=_EXC, candidate_outside_operational_scope="scope_type <> 'global_policy' AND len(scope) > 0 AND NOT list_has_any(applicable, scope)"),
    "S1": _named(candidate_excludes_operational_scope=_EXC, **{_SUBSET: f"scope_type <> 'global_policy' AND {_BEYOND}"}),
    "S2": _named(candidate_excludes_operational_scope=_EXC, primary_solution_not_in_operational_scope=f"scope_type IN ('solution_specific', 'multi_solution') AND NOT {_OWN}", **{_SUBSET: f"scope_type IN ('multi_solution', 'cross_cutting_requirement') AND {_BEYOND}"}),
    "S3": _named(candidate_excludes_operational_scope=_EXC, **{_SUBSET: f"scope_type <> 'global_policy' AND {_BEYOND}"}, document_type_not_allowed=_TYPE, industry_not_allowed=_INDUSTRY, tag_not_allowed=_TAG, document_not_active=f"NOT {ACTIVE_SQL}"),
    "S4": BOUNDARY_SQL,
}
OPERATIONAL = "status = 'approved' AND (effective_until IS NULL OR effective_on <= effective_until) AND list_contains(ask_types, document_type) AND list_has_any(industries, ask_industries) AND (len(scope) = 0 OR list_has_any(applicable, scope)) AND (len(ask_tags) = 0 OR list_has_any(tags, ask_tags))"
_BASE_OK = f"({ACTIVE_SQL} AND NOT ({_TYPE}) AND NOT ({_INDUSTRY}) AND NOT ({_TAG}) AND NOT {_EXC})"
_SPECIFIC, _MULTI, _CROSS, _GLOBAL = f"(scope_type = 'solution_specific' AND {_OWN})", f"(scope_type = 'multi_solution' AND {_OWN})", "(scope_type = 'cross_cutting_requirement' AND list_has_any(applicable, scope))", "(scope_type = 'global_policy')"
_RANK = f"CASE WHEN {_SPECIFIC} THEN 0 WHEN {_MULTI} THEN 2 WHEN {_CROSS} THEN 3 WHEN {_GLOBAL} THEN 4 ELSE 99 END"
RULE_SQL = {  # (allowed, priority, channel)
    "R0": (f"{_BASE_OK} AND NOT {_BAD}", "99", "NULL"), "R1": (f"{_BASE_OK} AND ({_GLOBAL} OR list_has_all(scope, applicable))", f"CASE WHEN {_GLOBAL} THEN 4 ELSE 99 END", "NULL"),
    "R2": (f"{_BASE_OK} AND ({_SPECIFIC} OR {_MULTI} OR {_CROSS} OR {_GLOBAL})", _RANK, "NULL"),
    "R3": (f"{_BASE_OK} AND ({_SPECIFIC} OR {_CROSS} OR {_GLOBAL})", f"CASE WHEN {_SPECIFIC} THEN 0 WHEN {_CROSS} THEN 3 ELSE 4 END", f"CASE WHEN {_SPECIFIC} THEN 'solution_evidence' ELSE 'cross_cutting_evidence' END"),
    "R4": (f"{_BASE_OK} AND ({_SPECIFIC} OR {_MULTI} OR {_CROSS} OR {_GLOBAL})", _RANK, "NULL"), "R5": (f"{_BASE_OK} AND NOT {_BAD}", "99", "NULL"),
}


def _metrics(allowed: str) -> str:
    rel, bad = "count(*) FILTER (relevant)", "count(*) FILTER (violating)"
    kept, gone = f"count(*) FILTER (relevant AND {allowed})", f"count(*) FILTER (violating AND NOT {allowed})"
    return f"count(*) AS n_pairs, {rel} AS n_relevant, {bad} AS n_violating, count(*) FILTER (relevant AND violating) AS n_conflict, {rel} - {kept} AS n_false_exclusion, {bad} - {gone} AS n_false_inclusion, round({kept} / nullif({rel}, 0), 6) AS retention, round({gone} / nullif({bad}, 0), 6) AS removal"


_SATISFY = f"""{_PAIRS}, sat AS (SELECT doc, chunk, any_value({_MODE}) AS frozen_mode, """ + ", ".join(f"count(*) FILTER (relevant AND NOT {_allows(repr(m), True)}) AS out_{m}, count(*) FILTER (bad_ AND {_allows(repr(m), True)}) AS in_{m}" for m in e.MODES) + f""" FROM (SELECT *, {_BAD} AS bad_ FROM told) GROUP BY doc, chunk),
    sat2 AS (SELECT *, concat_ws(',', """ + ", ".join(f"CASE WHEN out_{m} = 0 AND in_{m} = 0 THEN '{m}' END" for m in e.MODES) + """) AS perfect_modes FROM sat)"""
_GROUPS = "GROUPING SETS ((q), (mode), (scope_type), (source), ())"
_ALL = f"{SQL}, {told_sql('(SELECT q, doc, chunk FROM cases, chunks)')}"
_ALL_PAIRWISE = _PAIRWISE.replace(_PAIRS, _ALL)
ORACLE = {
    "eligible_pairs": f"WITH {SQL} SELECT q, chunk FROM cases, chunks WHERE {RUNTIME_SQL} = ''",
    "operational_pairs": f"WITH {SQL} SELECT q, chunk FROM cases, chunks WHERE {OPERATIONAL}",
    "effective_documents": f"""WITH {SQL}, x AS (SELECT doc, min(effective_from) AS a, min(effective_until) AS b FROM chunks GROUP BY doc)
        SELECT doc, count(*) AS n_cases, min(effective_on) AS first_on, max(effective_on) AS last_on, CAST(sum(q) AS BIGINT) AS sum_q FROM x JOIN cases ON effective_on BETWEEN coalesce(a, DATE '0001-01-01') AND coalesce(b, DATE '9999-12-31') GROUP BY doc""",
    "all_pairs_confusion": f"""WITH {_ALL}, pw AS (SELECT *, {_MODE} AS mode, CASE WHEN override_mode IS NULL THEN 'document_default' ELSE 'chunk_override' END AS source, {_BAD} AS violating, {_allows(_MODE)} AND {" AND ".join(_FILTERS.values())} AS full_allowed FROM told)
        SELECT q, mode, scope_type, source, {_metrics("full_allowed")} FROM pw GROUP BY {_GROUPS}""",
    "operational_filter": f"""WITH {_PAIRS} SELECT q, count(*) FILTER (status = 'approved' AND (effective_until IS NULL OR effective_on <= effective_until) AND list_contains(ask_types, document_type) AND list_has_any(industries, ask_industries) AND (len(scope) = 0 OR list_has_any(applicable, scope)) AND (len(ask_tags) = 0 OR list_has_any(tags, ask_tags))) AS n_all,
        count(*) FILTER (status IN ('approved', 'draft')) AS n_loose FROM told GROUP BY q""",
    "runtime_eligibility": f"WITH {_PAIRS} SELECT q, {RUNTIME_SQL} AS reasons, count(*) AS n_candidates FROM told GROUP BY ALL",
    "rejection_counts": f"WITH {_PAIRS} SELECT q, reason, count(*) AS n_rejected FROM (SELECT q, unnest(string_split({RUNTIME_SQL}, ',')) AS reason FROM told) WHERE reason <> '' GROUP BY ALL",
    "boundary_decision": f"WITH {_PAIRS} SELECT q, {BOUNDARY_SQL} AS reasons, count(*) AS n_candidates FROM told GROUP BY ALL",
    "scope_strategy": f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, {x} AS reasons, count(*) AS n FROM told GROUP BY ALL" for s, x in _STRATEGY.items()),
    "runtime_rule": f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST({p} AS BIGINT) AS priority, CAST({c} AS VARCHAR) AS channel, count(*) AS n_allowed FROM told WHERE {ok} GROUP BY ALL" for r, (ok, p, c) in RULE_SQL.items()),
    "scope_checks": f"""WITH {SQL}, x AS (SELECT chunk, scope_type, excluded, CASE WHEN chunk % 10 = 4 AND NOT list_contains(applicable, doc % 7) THEN list_append(applicable, doc % 7) ELSE applicable END AS app, CASE WHEN chunk % 10 = 7 THEN NULL ELSE primary_solution END AS prim FROM chunks),
        v AS (SELECT chunk, concat_ws(',', CASE WHEN prim IS NOT NULL AND NOT list_contains(app, prim) THEN 'primary_not_applicable' END, CASE WHEN list_has_any(app, excluded) THEN 'sides_overlap' END, CASE WHEN list_max(app) > 4 THEN 'unknown_applicable' END, CASE WHEN list_max(excluded) > 4 THEN 'unknown_excluded' END,
            CASE WHEN NOT CASE scope_type WHEN 'solution_specific' THEN len(app) = 1 WHEN 'multi_solution' THEN len(app) >= 2 WHEN 'global_policy' THEN len(app) = 5 ELSE len(app) >= 1 END THEN 'wrong_size' END, CASE WHEN scope_type <> 'global_policy' AND prim IS NULL THEN 'primary_missing' END) AS violations FROM x) SELECT * FROM v WHERE violations <> ''""",
    "scope_cardinality": f"WITH {SQL}, x AS (SELECT doc, document_type, len(document_applicable) AS n_solutions, bool_and(list_sort(applicable) = list_sort(document_applicable)) AS inherited FROM chunks GROUP BY ALL) SELECT document_type, CAST(n_solutions AS BIGINT) AS n_solutions, count(*) AS n_documents, count(*) FILTER (inherited) AS n_inherited FROM x GROUP BY ALL",
    "effective_labels": f"WITH {SQL} SELECT {_MODE} AS mode, CASE WHEN override_mode IS NULL THEN 'document_default' ELSE 'chunk_override' END AS source, count(*) AS n_chunks FROM chunks GROUP BY ALL",
    "mode_allows": f"WITH {_PAIRS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) FILTER ({_allows(repr(m))}) AS n_allowed, count(*) FILTER ({_allows(repr(m), True)}) AS n_allowed_before FROM told" for m in e.MODES),
    "pairwise_confusion": f"WITH {_ALL_PAIRWISE} SELECT q, chunk, scope_type, mode, source, relevant, violating, scope_allowed, full_allowed, " + ", ".join(f"{c} AS pass_{n}" for n, c in _FILTERS.items()) + ", relevant AND NOT full_allowed AS false_exclusion, violating AND full_allowed AS false_inclusion, relevant AND violating AS conflict FROM pw WHERE (relevant AND NOT full_allowed) OR (violating AND full_allowed) OR (relevant AND violating)",
    "confusion_metrics": f"WITH {_PAIRWISE} " + " UNION ALL ".join(f"SELECT q, mode, scope_type, source, {_metrics(a + '_allowed')}, '{a}' AS allowed_by FROM pw GROUP BY {_GROUPS}" for a in ("scope", "full")),
    "filter_attribution": f"WITH {_PAIRWISE} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n_denied, count(*) FILTER (relevant) AS n_relevant, count(*) FILTER (violating) AS n_violating FROM pw WHERE NOT {c}" for n, c in (_FILTERS | {"solution_scope": "scope_allowed"}).items()) + ") WHERE n_denied > 0",
    "mode_satisfiability": f"WITH {_SATISFY} SELECT *, perfect_modes <> '' AND list_contains(string_split(perfect_modes, ','), frozen_mode) AS frozen_is_perfect, len(list_filter(string_split(perfect_modes, ','), lambda x: x <> '' AND x <> frozen_mode)) > 0 AS other_is_perfect, perfect_modes = '' AS none_is_perfect FROM sat2",
    "error_candidates": f"WITH {_PAIRWISE}, " + _SATISFY.replace(_PAIRS + ", ", "") + """, w AS (SELECT chunk, relevant AND NOT full_allowed AS fe, q FROM pw WHERE (relevant AND NOT full_allowed) OR (violating AND full_allowed))
        SELECT chunk, count(*) FILTER (fe) AS n_false_exclusion, count(*) FILTER (NOT fe) AS n_false_inclusion, count(DISTINCT q) AS n_error_cases, CASE WHEN any_value(perfect_modes) = '' THEN 'C_three_mode_schema_unsatisfiable' ELSE 'A_blind_authoring_misclassification' END AS root_cause FROM w JOIN sat2 USING (chunk) GROUP BY chunk""",
    "observable_conflicts": f"""WITH {_PAIRS}, s AS (SELECT scope_type, {_OWN} AS primary_in_scope, CASE WHEN len(applicable) = 0 THEN 'none' WHEN list_has_all(scope, applicable) THEN 'full_subset' WHEN list_has_any(scope, applicable) THEN 'partial_overlap' ELSE 'empty_overlap' END AS overlap, {_EXC} AS excluded_conflict, {_FILTERS["document_type"]} AND {_FILTERS["industry"]} AND {_FILTERS["tags"]} AND {ACTIVE_SQL} AS eligible, NOT {_BAD} AS ok, q, chunk FROM told),
        r AS (SELECT *, row_number() OVER (PARTITION BY scope_type, primary_in_scope, overlap, excluded_conflict, eligible, ok ORDER BY q, chunk) AS n FROM s)
        SELECT scope_type, primary_in_scope, overlap, excluded_conflict, eligible, count(*) FILTER (ok) AS n_allow, count(*) FILTER (NOT ok) AS n_deny, string_agg(q || ':' || chunk, ',' ORDER BY n) FILTER (ok AND n <= 3) AS allow_samples, string_agg(q || ':' || chunk, ',' ORDER BY n) FILTER (NOT ok AND n <= 3) AS deny_samples FROM r GROUP BY ALL HAVING n_allow > 0 AND n_deny > 0""",
    "heterogeneous_documents": f"WITH {_SATISFY} SELECT doc, count(DISTINCT perfect_modes) AS n_sets FROM sat2 WHERE perfect_modes <> '' GROUP BY doc HAVING count(DISTINCT perfect_modes) > 1",
    "schema_variants": f"WITH {_PAIRS}, z AS (SELECT *, {_BAD} AS bad_, {' AND '.join(_FILTERS[n] for n in ('document_type', 'industry', 'tags', 'effective_on'))} AS f FROM told), sat AS (SELECT chunk, " + ", ".join(f"count(*) FILTER (relevant AND NOT (f AND {_allows(repr(m), True)})) AS out_{m}, count(*) FILTER (bad_ AND f AND {_allows(repr(m), True)}) AS in_{m}" for m in _ALL_MODES) + " FROM z GROUP BY chunk), v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, CAST({len(ms)} AS BIGINT) AS n_modes, {' + '.join(f'CAST(out_{m} = 0 AND in_{m} = 0 AS INT)' for m in ms)} AS n, CASE {' '.join(f'WHEN out_{m} = 0 AND in_{m} = 0 THEN 0' for m in ms)} ELSE out_{ms[0]} END AS x, CASE {' '.join(f'WHEN out_{m} = 0 AND in_{m} = 0 THEN 0' for m in ms)} ELSE in_{ms[0]} END AS y FROM sat" for n, ms in VARIANTS.items()) + "), g AS (SELECT variant, n_modes, count(*) FILTER (n > 0) AS n_perfect, count(*) FILTER (n = 0) AS n_unsatisfiable, count(*) FILTER (n > 1) AS n_ambiguous, CAST(sum(x) AS BIGINT) AS n_false_exclusion, CAST(sum(y) AS BIGINT) AS n_false_inclusion FROM v GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n_unsatisfiable, n_modes, variant) AS place FROM g",
    "attempt_comparison": f"""WITH {_PAIRS}, y AS (SELECT *, {_BAD} AS violating, {" AND ".join(_FILTERS.values())} AS f FROM told), a AS (SELECT *, f AND {_allows("default_mode")} AS old_ok, f AND {_allows(_MODE)} AS new_ok FROM y),
        o AS (SELECT scope_type, {_metrics("old_ok")} FROM a GROUP BY GROUPING SETS ((scope_type), ())), n AS (SELECT scope_type, {_metrics("new_ok")} FROM a GROUP BY GROUPING SETS ((scope_type), ()))
        SELECT o.scope_type, o.retention AS old_retention, n.retention AS new_retention, o.removal AS old_removal, n.removal AS new_removal, n.n_false_exclusion - o.n_false_exclusion AS false_exclusion_delta, n.n_false_inclusion - o.n_false_inclusion AS false_inclusion_delta FROM o JOIN n ON o.scope_type IS NOT DISTINCT FROM n.scope_type""",
}
