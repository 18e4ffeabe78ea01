"""Why retrieval misses or oversteps: causes of missing items and violations, what-if matrices and their summaries.

Ranked rows are those of a pool of 20 a case and method, with the pair columns of `eligibility` (see there), item, relevant, rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import eligibility as e

# Pool sizes, most chunks of a document, and orders of the what-if matrix.
POOLS = [5, 10, 20]
DIVERSITY = {"no_diversity": None, "max_2_chunks_per_document": 2, "max_1_chunk_per_document": 1}
RERANK = ["original_rank", "runtime_scope_fit"]
ORACLE_STRATEGY = "S4"
SPECIFICITY = {"solution_specific": 0, "multi_solution": 1, "cross_cutting_requirement": 2, "global_policy": 3}


def _one(c, zero=1.0) -> Column:
    """a / b with 1 where b is 0."""
    a, b = c
    return F.when(b == 0, F.lit(zero)).otherwise(F.round(a / b, 6))


# Debug fields that a run of each method has to give.
_ANY_FIELDS = ["candidate_count", "normalized_query_present", "raw_query_present", "retrieval_method"]
DEBUG_FIELDS = {
    "lexical_v1": [*_ANY_FIELDS, "lexical_query_tokens"], "vector_v1": [*_ANY_FIELDS, "query_embedding_generated", "embedding_dimension"],
    "hybrid_v1": [*_ANY_FIELDS, "lexical_candidate_count", "vector_candidate_count", "fused_candidate_count"],
}


def failure_reasons() -> Column:
    """Ordered reasons why a case fails, from query, method, debug (map, null or absent values are missing), request_error, filtered_all,
    recall_5, relevant_hits, minimum_hits, forbidden_hit, boundary_violation."""
    missing = F.lit(False)
    for method, fields in DEBUG_FIELDS.items():
        lacks = F.exists(F.array(*map(F.lit, fields)), lambda f: F.element_at("debug", f).isNull())
        missing = missing | ((F.col("method") == method) & lacks)
    empty = F.regexp_replace(F.coalesce("query", F.lit("")), r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", "") == ""
    named = {"empty_query": empty, "missing_required_debug": missing, "retrieval_error": F.col("request_error"), "operational_filter_excluded_all": F.col("filtered_all"), "no_relevant_hit_at_5": F.col("recall_5") == 0}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (named | _late_reasons()).items()]))


def _late_reasons() -> dict[str, Column]:
    return {"insufficient_relevant_hits": F.col("relevant_hits") < F.col("minimum_hits"), "forbidden_document_hit": F.col("forbidden_hit"), "solution_boundary_violation": F.col("boundary_violation")}


def failure_reasons_v1() -> Column:
    """The first generation's reasons: of rows hit rather than recall, and an empty token list (debug query_tokens = 0) instead of an empty query."""
    no_tokens = F.coalesce(F.element_at("debug", F.lit("query_tokens")) == "0", F.lit(False))
    named = {"retrieval_error": F.col("request_error"), "empty_query_tokens": no_tokens, "operational_filter_excluded_all": ~no_tokens & F.col("filtered_all"), "no_relevant_hit_at_5": F.col("relevant_hits") == 0}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (named | _late_reasons()).items()]))


def case_feasibility(cases: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """Every case with its expected items that pass the filters and those that are safe as well, and the ordered reasons why it cannot be met.

    items: the expected items with pair columns, chunk null where the item is not in the corpus, and kind; cases: minimum_hits."""
    known = F.col("chunk").isNotNull()
    passes = known & F.coalesce(e.passes_document_filters(), F.lit(False))
    safe = F.coalesce(F.size(e.boundary_reasons()) == 0, F.lit(False))
    g = items.withColumn("_p", passes).withColumn("_s", safe).groupBy(query).agg(F.count_if("_p").alias("n_filtered"), F.count_if(F.col("_p") & F.col("_s")).alias("n_safe"), F.count_if(F.col("_p") & ~F.col("_s")).alias("_c"), F.bool_or(~known & (F.col("kind") == "document")).alias("_md"), F.bool_or(~known & (F.col("kind") == "chunk")).alias("_mc"))
    j = cases.select(query, "minimum_hits").join(g, query, "left").na.fill(0, ["n_filtered", "n_safe", "_c"]).na.fill(False, ["_md", "_mc"])
    named = {"missing_expected_document": F.col("_md"), "missing_expected_chunk": F.col("_mc"), "operational_filters_exclude_all_expected_items": F.col("n_filtered") == 0, "expected_relevant_items_conflict_with_boundary": F.col("_c") > 0, "minimum_relevant_hits_exceeds_safe_expected_items": F.col("n_safe") < F.col("minimum_hits")}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return j.select(query, "n_filtered", "n_safe", reasons.alias("reasons"), (F.size(reasons) == 0).alias("feasible"))


def missing_items(gold: DataFrame, ranked: DataFrame, methods: list[str], query: str, has_tokens: Column | None = None) -> DataFrame:
    """method, query, item, kind, rank, cause for every expected item that is not among a method's first five."""
    want = gold.select(query, "item", "kind", F.col("doc").alias("_doc")).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    first = ranked.groupBy("method", query, "item").agg(F.min_by(F.struct("rank", "lexical_rank", "vector_rank"), "rank").alias("_r"))
    crowd = ranked.where("rank <= 5").select("method", query, F.col("doc").alias("_doc"), F.lit(True).alias("_crowd")).distinct()
    j = want.join(first, ["method", query, "item"], "left").join(crowd, ["method", query, "_doc"], "left").withColumn("rank", F.col("_r.rank")).where("rank is null or rank > 5")
    rank, m = F.col("rank"), F.col("method")
    near = F.coalesce(F.col("_r.lexical_rank") <= 5, F.lit(False)) | F.coalesce(F.col("_r.vector_rank") <= 5, F.lit(False))
    cause = (
        F.when(F.col("_crowd") & rank.isNotNull(), F.when(F.col("kind") == "chunk", "same_document_chunk_crowding").otherwise("duplicate_document_competition"))
        .when(rank.between(6, 10), "rank_6_to_10").when(rank.between(11, 20), "rank_11_to_20")
        .when((m == "lexical_v1") & (F.lit(True) if has_tokens is None else has_tokens), "lexical_term_mismatch").when(m == "vector_v1", "vector_semantic_mismatch")
        .when((m == "hybrid_v1") & near, "fusion_rank_suppression").otherwise("not_in_top_20")
    )
    return j.select("method", query, "item", "kind", "rank", cause.alias("cause"))


def boundary_causes(ranked: DataFrame, query: str) -> DataFrame:
    """method, query, rank, cause, preventable (at run time) for every violating row of the first five. Rows are chunks."""
    out = e.boundary_reasons()
    excl, beyond = F.arrays_overlap("excluded", "scope"), (F.col("scope_type") != e.GLOBAL) & (F.size("scope") > 0) & ~F.arrays_overlap("applicable", "scope")
    own, has = F.arrays_overlap("forbidden", "applicable"), F.size("forbidden") > 0
    cause = (
        F.when(excl, "candidate_excluded_solution_match").when(beyond, "chunk_scope_not_applied").when(F.col("forbidden_document"), "evaluation_only_boundary_rule")
        .when((F.col("scope_type") == e.GLOBAL) & has, "global_policy_misclassification").when((F.col("scope_type") == e.CROSS) & own, "cross_cutting_scope_overlap")
        .when(~F.array_contains("ask_types", F.col("document_type")), "document_type_filter_gap").when(own, "evaluation_only_boundary_rule").otherwise("ranking_intrusion_after_valid_filter")
    )
    return ranked.where("rank <= 5").where(F.size(out) > 0).select("method", query, "rank", cause.alias("cause"), (excl | beyond).alias("preventable"))


def boundary_distribution(causes: DataFrame, query: str) -> DataFrame:
    """Per case: methods that violate, and causes with their counts, the most frequent first (ties by name)."""
    n = causes.groupBy(query, "cause").agg(F.count("*").alias("n"), F.collect_set("method").alias("m"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cause"))), lambda x: F.concat_ws(":", x["cause"], (-x["n"]).cast("string")))
    return n.groupBy(query).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))), ",").alias("methods"), F.array_join(listed, ",").alias("causes"))


def boundary_tags(ranked: DataFrame, known: list[int], query: str) -> DataFrame:
    """First generation: method, query, rank, tags of every row of the first five that is not within the scope or overlaps what is forbidden."""
    s = F.col("applicable")
    required = F.size("scope") > 0
    bad = (required & (F.size(F.array_except(s, F.col("scope"))) > 0)) | F.arrays_overlap(s, F.col("forbidden"))
    all_known = F.array(*[F.lit(k).cast("long") for k in known])
    tags = {
        "out_of_scope_solution_reference": F.size(F.array_except(s, all_known)) > 0, "expected_document_contains_forbidden_solution": F.col("relevant"), "multi_solution_document_overlap": F.size(s) > 1,
        "cross_solution_retrieval": required & (F.size(F.array_except(F.array_intersect(s, all_known), F.col("scope"))) > 0), "operational_filter_gap": F.size("ask_types") == 0, "gold_boundary_overconstraint": F.col("relevant") & (F.size(s) > 1),
    }
    said = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tags.items()]))
    return ranked.where("rank <= 5").where(bad).select("method", query, "rank", F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("unknown_boundary_cause"))).alias("tags"))


def tag_counts(tagged: DataFrame, query: str) -> DataFrame:
    """Per method and tag: candidates, cases, and the first rank at which it is seen."""
    return tagged.select("method", query, "rank", F.explode("tags").alias("tag")).groupBy("method", "tag").agg(F.count("*").alias("n_candidates"), F.count_distinct(query).alias("n_cases"), F.min("rank").alias("first_rank"))


def topk_depth(recalls: DataFrame, ranked: DataFrame, missing: DataFrame, query: str) -> DataFrame:
    """Per method: cases at recall 1 at 5, 10 and 20, cases crowded by one document, missing items by cause, failed cases."""
    five = ranked.where("rank <= 5").groupBy("method", query).agg((F.count("doc") - F.count_distinct("doc")).alias("crowd"))
    j = recalls.join(five, ["method", query], "left")
    one = lambda k: F.count_if(F.col(f"recall_{k}") == 1).alias(f"n_full_{k}")
    got = j.groupBy("method").agg(one(5), one(10), one(20), F.count_if(F.col("crowd") > 0).alias("n_crowded"), F.count_if(F.col("recall_5") < 1).alias("n_failed"))
    n = missing.groupBy("method", "cause").agg(F.count("*").alias("n")).groupBy("method").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cause", "n"))), lambda x: F.concat_ws(":", x["cause"], x["n"].cast("string"))), ",").alias("causes"))
    return got.join(n, "method", "left").withColumn("causes", F.coalesce("causes", F.lit("")))


def cross_method(recalls: DataFrame, causes: DataFrame, missing: DataFrame, query: str) -> DataFrame:
    """Failed cases over all methods: preventable at run time, dominated by ranking, or with a candidate gap."""
    depth = recalls.groupBy("method").agg((F.count_if(F.col("recall_20") == 1) >= F.count_if(F.col("recall_5") == 1)).alias("deeper"))
    gap = missing.groupBy("method").agg(F.bool_or(F.col("cause") == "not_in_top_20").alias("gap"))
    failed = recalls.where("recall_5 < 1").select("method", query).join(depth, "method").join(gap, "method", "left")
    stopped = causes.where("preventable").select(query, F.lit(True).alias("p")).distinct()
    j = failed.groupBy(query).agg(F.bool_or("deeper").alias("d"), F.bool_or(F.coalesce("gap", F.lit(False))).alias("candidate_gap")).join(stopped, query, "full")
    p = F.coalesce("p", F.lit(False))
    return j.select(query, p.alias("preventable"), (F.coalesce("d", F.lit(False)) & ~p).alias("ranking_dominated"), F.coalesce("candidate_gap", F.lit(False)).alias("candidate_gap"))


def root_cause(items: DataFrame) -> Column:
    """Why an item is missing, from rows with method, current_rank, prefilter_rank, enriched_rank, dual_rank, n_ineligible_ahead,
    sibling_ahead, overlap_content, overlap_title, overlap_summary."""
    better = lambda c: F.col(c).isNotNull() & (F.col("current_rank").isNull() | (F.col(c) < F.col("current_rank")))
    content, title, summary, m = F.col("overlap_content"), F.col("overlap_title"), F.col("overlap_summary"), F.col("method")
    return (
        F.when((F.col("n_ineligible_ahead") > 0) & better("prefilter_rank"), "runtime_ineligible_crowding").when(F.col("sibling_ahead"), "expected_sibling_chunk_substitution")
        .when(better("dual_rank") & (F.col("dual_rank") <= 20), "parent_document_signal_missing")
        .when(better("enriched_rank") & (F.col("enriched_rank") <= 20), F.when(title & ~content, "title_not_indexed").when(summary & ~content, "summary_not_indexed").otherwise("chunk_context_insufficient"))
        .when((m == "lexical_v1") & ~content & ~title & ~summary, "lexical_term_mismatch").when(m == "vector_v1", "vector_semantic_mismatch").when(m == "hybrid_v1", "hybrid_candidate_union_gap").otherwise("unknown_candidate_generation_cause")
    )


def ineligible_ahead(ranked: DataFrame, by: list[str]) -> DataFrame:
    """ranked with n_ineligible_ahead: rows before it in its list that may not be indexed for the case, and sibling_ahead: a row of its document before it."""
    w = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*by, "doc").orderBy("rank")
    n = F.coalesce(F.sum((~e.chunk_eligible()).cast("int")).over(w), F.lit(0)).cast("long")
    return ranked.withColumn("n_ineligible_ahead", n).withColumn("sibling_ahead", F.row_number().over(own) > 1)


def rule_matrix(ranked: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Per rule and method over the pools: retention of relevant and removal of violating rows (1 where there are none), and both errors."""
    x = F.array(*[F.struct(F.lit(r).alias("rule"), (F.size(e.runtime_rule(r)["reasons"]) == 0).alias("ok")) for r in rules or e.RULES])
    each = ranked.select("method", "relevant", (F.size(e.boundary_reasons()) > 0).alias("bad"), F.explode(x).alias("x")).select("method", "relevant", "bad", "x.*")
    n = each.groupBy("rule", "method").agg(F.count_if("relevant").alias("r"), F.count_if(F.col("relevant") & ~F.col("ok")).alias("n_false_positive"), F.count_if("bad").alias("b"), F.count_if(F.col("bad") & F.col("ok")).alias("n_false_negative"))
    return n.select("rule", "method", _one((F.col("r") - F.col("n_false_positive"), F.col("r"))).alias("retention"), _one((F.col("b") - F.col("n_false_negative"), F.col("b"))).alias("removal"), "n_false_positive", "n_false_negative")


def false_exclusions(ranked: DataFrame, rules: list[str]) -> DataFrame:
    """Per rule: what it filters, by class (relevant first, then violating, else harmless), with precision and rates."""
    bad = F.size(e.boundary_reasons()) > 0
    kind = F.when(F.col("relevant"), "relevant").when(bad, "boundary").otherwise("harmless")
    x = F.array(*[F.struct(F.lit(r).alias("rule"), (F.size(e.runtime_rule(r)["reasons"]) > 0).alias("gone")) for r in rules])
    each = ranked.select("relevant", bad.alias("bad"), kind.alias("kind"), F.explode(x).alias("x")).select("relevant", "bad", "kind", "x.*")
    of = lambda k: F.count_if(F.col("gone") & (F.col("kind") == k))
    n = each.groupBy("rule").agg(F.count_if("gone").alias("n_filtered"), of("boundary").alias("n_boundary"), of("relevant").alias("n_relevant"), F.count_if("relevant").alias("r"), F.count_if("bad").alias("b"))
    return n.select("rule", "n_filtered", "n_boundary", "n_relevant", _one((F.col("n_boundary"), F.col("n_filtered"))).alias("precision"), _one((F.col("r") - F.col("n_relevant"), F.col("r"))).alias("retention"), _one((F.col("n_boundary"), F.col("b"))).alias("removal"), (F.col("n_relevant") == 0).alias("separable"))


def filtered_by(ranked: DataFrame, rules: list[str], query: str) -> DataFrame:
    """Every row that one of the rules filters and that is not harmless: rule, method, query, doc, chunk, scope_type, relevant."""
    bad = F.size(e.boundary_reasons()) > 0
    gone = F.array_compact(F.array(*[F.when(F.size(e.runtime_rule(r)["reasons"]) > 0, F.lit(r)) for r in rules]))
    return ranked.where(F.col("relevant") | bad).select("method", query, "doc", "chunk", "scope_type", "relevant", F.explode(gone).alias("rule"))


def conflict_clusters(filtered: DataFrame, keys: list[str], query: str) -> DataFrame:
    """Candidates (or scope types) that are relevant in one case and violating in another: how many rows and cases of either side."""
    rel = F.col("relevant")
    n = filtered.groupBy(*keys).agg(F.count_if(rel).alias("n_relevant"), F.count_if(~rel).alias("n_boundary"), F.count_distinct(F.when(rel, F.col(query))).alias("relevant_cases"), F.count_distinct(F.when(~rel, F.col(query))).alias("boundary_cases"))
    return n.where("n_relevant > 0 and n_boundary > 0")


#: Document types whose chunks need their whole scope, unless the caller names others.
WHOLE_SCOPE = ["case_study", "commercial_rule"]


def match_mode(whole_scope: list[str] = WHOLE_SCOPE) -> Column:
    """The mode that a chunk's scope and document type suggest; documents of a type in whole_scope need all of theirs."""
    return F.when(F.col("scope_type") == e.GLOBAL, "global_reusable").when(F.col("scope_type") == e.SPECIFIC, "primary_in_scope").when(F.col("document_type").isin(*whole_scope), "full_applicable_scope").otherwise("primary_in_scope")


def contract_variants(ranked: DataFrame, whole_scope: list[str] = WHOLE_SCOPE) -> DataFrame:
    """Five allow rules over the pools, per method: retention, removal, both errors; `best` marks the method that serves a contract best."""
    t = e._taxonomy()
    base = e.active() & ~t["type"] & ~t["industry"] & ~t["tag"] & ~F.arrays_overlap("excluded", "scope")
    primary = F.coalesce(F.array_contains("scope", F.col("primary_solution")), F.lit(False))
    current, mode = base & ((F.col("scope_type") == e.GLOBAL) | primary), match_mode(whole_scope)
    by_mode = base & F.when(mode == "global_reusable", F.lit(True)).when(mode == "primary_in_scope", primary).otherwise(F.size(F.array_except("applicable", "scope")) == 0)
    bad = F.size(e.boundary_reasons()) > 0
    rules = {"current": current, "runtime_only": current, "candidate_only": by_mode, "paired": by_mode, "oracle": ~bad}
    x = F.array(*[F.struct(F.lit(n).alias("contract"), c.alias("ok")) for n, c in rules.items()])
    each = ranked.select("method", "relevant", bad.alias("bad"), F.explode(x).alias("x")).select("method", "relevant", "bad", "x.*")
    n = each.groupBy("contract", "method").agg(F.count_if("relevant").alias("r"), F.count_if(F.col("relevant") & ~F.col("ok")).alias("n_false_positive"), F.count_if("bad").alias("b"), F.count_if(F.col("bad") & F.col("ok")).alias("n_false_negative"))
    got = n.select("contract", "method", _one((F.col("r") - F.col("n_false_positive"), F.col("r"))).alias("retention"), _one((F.col("b") - F.col("n_false_negative"), F.col("b"))).alias("removal"), "n_false_positive", "n_false_negative")
    return got.withColumn("best", F.row_number().over(Window.partitionBy("contract").orderBy(F.desc("retention"), F.desc("removal"), "method")) == 1)


def separability(overlaps: DataFrame, query: str) -> DataFrame:
    """Class of each case, from rows (query, title, summary, content: whether they share a token; found: ranked by any method; asked: a scope is given)."""
    t, c = F.col("title") | F.col("summary"), F.col("content")
    n = overlaps.groupBy(query).agg(F.bool_and(~c & ~t).alias("none"), F.bool_or(t).alias("some"), F.bool_and(~c).alias("no_content"), F.bool_and(~F.col("found")).alias("unfound"), F.bool_or("asked").alias("asked"))
    return n.select(query, F.when(F.col("none"), "query_under_specified").when(F.col("some") & F.col("no_content"), "field_representation_gap").when(F.col("asked") & F.col("unfound"), "runtime_context_not_used").otherwise("unknown").alias("class"))


def counterfactuals(ranked: DataFrame, gold: DataFrame, query: str, strategies: list[str] | None = None, rerank: list[str] = RERANK, k: int = 5) -> DataFrame:
    """The whole what-if grid over one ranking: method, query, strategy, pool, diversity, rerank, with counts, recall at k and violation.

    The pool of each case is gathered once, as an array of at most 20; a cell of the grid sorts it and folds it once, taking a candidate if
    it is allowed and its document has not given all it may. So the ranking is read once and shuffled once, whatever the size of the grid."""
    strategies = strategies or e.STRATEGIES
    fit = F.coalesce(F.array_contains("scope", F.col("primary_solution")), F.lit(False))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv]), F.col("scope_type"))
    allowed = F.array(*[F.size(e.strategy_reasons(n)) == 0 for n in strategies])
    row = F.struct("rank", "chunk", "doc", "item", "relevant", (F.size(e.boundary_reasons()) > 0).alias("bad"), F.col("forbidden_document").alias("forbidden"), (~fit).alias("far"), level.alias("level"), allowed.alias("allowed"))
    size = gold.select(query, "item").distinct().groupBy(query).agg(F.count("*").alias("gold"))
    pools = ranked.where(F.col("rank") <= max(POOLS)).groupBy("method", query).agg(F.collect_list(row).alias("rows")).join(size, query, "left")
    cells = [F.struct(F.lit(n).alias("strategy"), F.lit(i).alias("s"), F.lit(p).alias("pool"), F.lit(d).alias("diversity"), F.lit(m if m else max(POOLS)).alias("most"), F.lit(r).alias("rerank"), F.lit(r != RERANK[0]).alias("fits")) for i, n in enumerate(strategies) for p in POOLS for d, m in DIVERSITY.items() for r in rerank]
    each = pools.withColumn("c", F.explode(F.array(*cells))).select("method", query, "gold", "rows", "c.*")

    def keyed(x: Column) -> Column:
        ok = F.get(x["allowed"], F.col("s"))
        turn = lambda c: F.when(F.col("fits"), c.cast("int")).otherwise(0)
        return F.struct(turn(~ok).alias("a"), turn(x["far"]).alias("b"), turn(x["level"]).alias("c"), x["rank"].alias("rank"), x["chunk"].alias("chunk"), ok.alias("ok"), *[x[n].alias(n) for n in ("doc", "item", "relevant", "bad", "forbidden")])

    def step(z: Column, x: Column) -> Column:
        full = F.size(z["picks"]) >= k
        again = F.size(F.filter(z["picks"], lambda y: y["doc"] == x["doc"])) >= F.col("most")
        take, one = ~full & x["ok"] & ~again, lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(take, F.concat(z["picks"], F.array(F.struct(*[x[n].alias(n) for n in ("doc", "chunk", "item", "relevant", "bad", "forbidden", "rank")])))).otherwise(z["picks"]).alias("picks"),
            (z["n_filtered"] + one(~full & ~x["ok"])).alias("n_filtered"), (z["n_skipped"] + one(~full & x["ok"] & again)).alias("n_skipped"),
        )

    kinds = dict(ranked.dtypes)
    none = F.expr(f"cast(array() as array<struct<doc: {kinds['doc']}, chunk: {kinds['chunk']}, item: string, relevant: boolean, bad: boolean, forbidden: boolean, rank: {kinds['rank']}>>)")
    start = F.struct(none.alias("picks"), F.lit(0).alias("n_filtered"), F.lit(0).alias("n_skipped"))
    sorted_rows = F.array_sort(F.transform(F.filter("rows", lambda x: x["rank"] <= F.col("pool")), keyed))
    told = each.withColumn("z", F.aggregate(sorted_rows, start, step)).select("method", query, "strategy", "pool", "diversity", "rerank", "gold", "z.*")
    hits = F.size(F.array_distinct(F.transform(F.filter("picks", lambda y: y["relevant"]), lambda y: y["item"])))
    recall = F.when(F.coalesce("gold", F.lit(0)) > 0, hits / F.col("gold")).otherwise(F.lit(0.0))
    return told.select(
        "method", query, "strategy", "pool", "diversity", "rerank", "n_filtered", F.size(F.filter("picks", lambda y: y["rank"] > k)).alias("n_backfilled"), "n_skipped", F.size("picks").alias("n_picked"),
        recall.alias("recall_5"), F.exists("picks", lambda y: y["bad"]).alias("violation"), F.exists("picks", lambda y: y["forbidden"]).alias("forbidden"),
    )


def counterfactual_matrix(cells: DataFrame, query: str) -> DataFrame:
    """The grid's summary: recall, rates, failed cases, the gates that an entry misses, and its place.

    diversity_helps: whether an entry is better than the one without diversity in its like (of the strategies that do not need gold)."""
    by = ["method", "strategy", "pool", "diversity", "rerank"]
    failed = (F.col("recall_5") < 1) | F.col("violation")
    g = cells.groupBy(*by).agg(F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg(F.col("violation").cast("int")), 6).alias("violation_rate"), F.round(F.avg(F.col("forbidden").cast("int")), 6).alias("forbidden_rate"), F.count_if(failed).alias("n_failed"), F.count_if(~F.col("violation")).alias("n_clean"), F.sum("n_filtered").alias("n_filtered"), F.sum("n_backfilled").alias("n_backfilled"), F.sum("n_skipped").alias("n_skipped"))
    gates = {"summary_recall_at_5": F.col("recall_5") < 1, "forbidden_hit_rate": F.col("forbidden_rate") > 0, "solution_boundary_violation_rate": F.col("violation_rate") > 0, "all_cases_pass_blocking_gate": F.col("n_failed") > 0}
    g = g.withColumn("failed_gates", F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in gates.items()]))
    rank = F.struct((F.col("n_failed") == 0).cast("int").alias("a"), F.col("recall_5").alias("b"), (-F.col("violation_rate")).alias("c"), (-F.col("n_failed")).alias("d"), F.col("n_clean").alias("e"))
    none, like = F.lit(next(iter(DIVERSITY))), Window.partitionBy("method", "strategy", "pool", "rerank")
    plain = F.max(F.when(F.col("diversity") == none, rank)).over(like)
    g = g.withColumn("diversity_helps", F.when((F.col("diversity") != none) & (F.col("strategy") != ORACLE_STRATEGY), rank > plain))
    turn = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(DIVERSITY) for x in (n, i)]), F.col("diversity"))
    order = [F.desc((F.col("n_failed") == 0).cast("int")), F.desc("recall_5"), "violation_rate", "n_failed", F.desc("n_clean"), (F.col("rerank") == RERANK[1]).cast("int"), turn, "pool", "strategy", "method"]
    return g.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # some hundreds of entries, whatever the input
