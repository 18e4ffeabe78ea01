"""Retrieval metrics per query and per method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_scores(cases: DataFrame, ranked: DataFrame, gold: DataFrame, by: list[str], query: str, item: str, ks=(1, 3, 5)) -> DataFrame:
    """One row a case (of a method): recall, precision, reciprocal rank, hits, forbidden hit, boundary violation and ordered reasons.

    cases: the columns of `by`, and where there are any minimum_hits (else 1), request_error and latency. ranked: by, rank, item, and
    where there are any forbidden and violating (booleans). gold: query, item. Recall is 0 without gold; precision divides by the rows
    returned, not by k; hits count rows, not items, so a repeated row is a second hit."""
    top = max(ks)
    flag = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False)) if c in ranked.columns else F.lit(False)
    marked = ranked.join(gold.select(query, item, F.lit(1).alias("rel")).distinct(), [query, item], "left")
    rel = F.col("rel").isNotNull()
    found = [F.count_distinct(F.when(rel & (F.col("rank") <= k), F.col(item))).alias(f"h{k}") for k in ks]
    seen = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"r{k}") for k in ks]
    got = marked.groupBy(*by).agg(*found, *seen, F.min(F.when(rel, F.col("rank"))).alias("first"), F.count_if(rel & (F.col("rank") <= top)).alias("hits"), flag("forbidden").alias("bad"), flag("violating").alias("beyond"))
    size = gold.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("gold"))
    own = [c for c in ("minimum_hits", "request_error", "latency") if c in cases.columns]
    j = cases.select(*by, *own).join(got, by, "left").join(size, query, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    share = lambda a, b: F.when(zero(b) > 0, zero(a) / zero(b)).otherwise(F.lit(0.0))
    failed = no("request_error") if "request_error" in own else F.lit(False)
    least = F.col("minimum_hits") if "minimum_hits" in own else F.lit(1)
    reasons = F.array_compact(F.array(F.when(failed, F.lit("retrieval_error")), F.when(share(f"h{top}", "gold") < 1, F.lit("recall_at_5_below_pilot_gate")), F.when(no("bad"), F.lit("forbidden_hit_detected")), F.when(no("beyond"), F.lit("solution_boundary_violation")), F.when(zero("hits") < least, F.lit("minimum_relevant_hits_not_met"))))
    return j.select(*by, *[share(f"h{k}", "gold").alias(f"recall_{k}") for k in ks], *[share(f"h{k}", f"r{k}").alias(f"precision_{k}") for k in ks if k > 1], F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), zero("hits").cast("long").alias("relevant_hits"), no("bad").alias("forbidden_hit"), no("beyond").alias("boundary_violation"), failed.alias("request_error"), *([F.col("latency")] if "latency" in own else []), reasons.alias("reasons"))


def first_seen(df: DataFrame, by: list[str], array: str, order: list[str], name: str) -> DataFrame:
    """by and the distinct entries of an array column in the order of their first place (`order`, then place in the array)."""
    each = df.select(*by, F.struct(*order).alias("_o"), F.posexplode(array).alias("_i", "_x"))
    once = each.groupBy(*by, "_x").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    return once.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda x: x["_x"]).alias(name))


def method_summary(scores: DataFrame, order: list[str], method: str = "method") -> DataFrame:
    """Macro averages a method, rates of forbidden hits and violations, errors, mean latency, and all reasons as first seen by `order`."""
    means = [c for c in scores.columns if c.startswith(("recall_", "precision_"))] + ["reciprocal_rank"] + [c for c in ("latency",) if c in scores.columns]
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    got = scores.groupBy(method).agg(F.count("*").alias("n_cases"), *[F.round(F.avg(c), 6).alias(c) for c in means], rate("forbidden_hit").alias("forbidden_rate"), rate("boundary_violation").alias("violation_rate"), F.count_if("request_error").alias("n_errors"), F.count_if(F.size("reasons") == 0).alias("n_passed"))
    said = first_seen(scores, [method], "reasons", order, "reasons")
    return got.join(said, method, "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def blocking_gate(summary: DataFrame) -> Column:
    """Names of the gates that a method's summary fails, in order; none means that it passes."""
    failed = {"summary_recall_at_5": F.col("recall_5") != 1, "forbidden_hit_rate": F.col("forbidden_rate") != 0, "solution_boundary_violation_rate": F.col("violation_rate") != 0, "request_error_count": F.col("n_errors") != 0, "all_cases_pass_blocking_gate": F.col("n_passed") < F.col("n_cases")}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]))


def reason_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """Queries a reason, each once."""
    return scores.select(*by, F.explode(F.array_distinct("reasons")).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n_cases"))


def select_method(summary: DataFrame, eligible, method: str = "method") -> DataFrame:
    """All methods with a place; the first eligible one is selected: recall, forbidden and violation rate, reciprocal rank, latency, name."""
    latency = [F.col("latency")] if "latency" in summary.columns else []
    w = Window.orderBy(F.desc("ok"), F.desc("recall_5"), "forbidden_rate", "violation_rate", F.desc("reciprocal_rank"), *latency, method)  # a row a method
    ranked = summary.withColumn("ok", eligible).withColumn("place", F.row_number().over(w))
    return ranked.withColumn("selected", F.col("ok") & (F.col("place") == 1)).withColumn("status", F.when(F.max("ok").over(Window.partitionBy()), "eligible_method_selected").otherwise("no_eligible_method"))


def boundary_rate(ranked: DataFrame, by: list[str], solutions: str, required: str, forbidden: str) -> DataFrame:
    """Share of a case's candidates that are not within the required solutions (if any) or overlap the forbidden ones."""
    bad = ((F.size(required) > 0) & (F.size(F.array_except(solutions, required)) > 0)) | F.arrays_overlap(solutions, forbidden)
    return ranked.groupBy(*by).agg(F.round(F.avg(bad.cast("int")), 6).alias("boundary_rate"))


def recall_ceiling(gold: DataFrame, cases: DataFrame, query: str, item: str, k: int = 5) -> DataFrame:
    """Highest recall that k rows can reach, and whether the recall and the minimum-hits gates can be met at all. cases: query, minimum_hits."""
    n = gold.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("n_gold"))
    j = n.join(cases.select(query, "minimum_hits"), query)
    least = F.col("minimum_hits")
    return j.select(query, "n_gold", (F.least(F.col("n_gold"), F.lit(k)) / F.col("n_gold")).alias("ceiling"), (F.col("n_gold") <= k).alias("recall_feasible"), ((least <= k) & (least <= F.col("n_gold"))).alias("hits_feasible"))


def expected_ranks(gold: DataFrame, ranked: DataFrame, by: list[str], query: str, item: str) -> DataFrame:
    """First rank of each expected item in each list; null if absent. by: the columns of a list beside the query."""
    first = ranked.groupBy(*by, query, item).agg(F.min("rank").alias("rank"))
    want = gold.select(query, item).distinct()
    if by:
        names = ranked.select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("_all"))  # a row a method
        want = want.join(F.broadcast(names)).select(query, item, F.explode("_all").alias("_m")).select(query, item, "_m.*")
    return want.join(first, [*by, query, item], "left")


def rank_quality(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Mean of 1 / rank over expected items (absent: 0) and how many are missing at 20."""
    far = F.col("rank").isNull() | (F.col("rank") > 20)
    return ranks.groupBy(*by).agg(F.count("*").alias("n_items"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mean_reciprocal_rank"), F.count_if(far).alias("n_missing"))


def rank_movement(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Of every expected item its old and new rank, by how many places it rose, and whether it is newly recalled."""
    j = old.select(*keys, F.col("rank").alias("old_rank")).join(new.select(*keys, F.col("rank").alias("new_rank")), keys, "full")
    return j.withColumn("moved", F.col("old_rank") - F.col("new_rank")).withColumn("newly_recalled", F.col("old_rank").isNull() & F.col("new_rank").isNotNull())


def regressions(movement: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """Cases whose items were all within the first k before and are not now."""
    within = lambda c: F.bool_and(F.coalesce(F.col(c) <= k, F.lit(False)))
    return movement.groupBy(*by).agg(within("old_rank").alias("before"), within("new_rank").alias("now")).where("before and not now").select(*by)


def candidate_recall(runs: DataFrame, ranked: DataFrame, gold: DataFrame, by: list[str], query: str, item: str, ks=(5, 10, 20)) -> DataFrame:
    """Recall of each case's list at several depths and in full, and whether the first 20 hold a violating or forbidden row."""
    size = gold.select(query, item).distinct().groupBy(query).agg(F.count("*").alias("gold"))
    rel = ranked.join(gold.select(query, item, F.lit(1).alias("rel")).distinct(), [query, item], "left")
    hit = lambda c: F.count_distinct(F.when(F.col("rel").isNotNull() & c, F.col(item)))
    deep = F.col("rank") <= 20
    got = rel.groupBy(*by).agg(*[hit(F.col("rank") <= k).alias(f"h{k}") for k in ks], hit(F.lit(True)).alias("hall"), F.bool_or(deep & F.col("violating")).alias("v"), F.bool_or(deep & F.col("forbidden")).alias("f"))
    j = runs.select(*by).join(got, by, "left").join(size, query, "left")
    share = lambda c: F.when(F.coalesce("gold", F.lit(0)) > 0, F.coalesce(c, F.lit(0)) / F.col("gold")).otherwise(F.lit(0.0))
    return j.select(*by, *[share(f"h{k}").alias(f"recall_{k}") for k in ks], share("hall").alias("recall_full"), F.coalesce("v", F.lit(False)).alias("violation_20"), F.coalesce("f", F.lit(False)).alias("forbidden_20"))


def variant_summary(recalls: DataFrame, by: list[str]) -> DataFrame:
    """Averages of candidate_recall a variant, its unresolved and failed cases, and its place: recall at 20, fewer violations, fewer
    forbidden hits, recall at 5, fewer failed cases, then the names."""
    bad = (F.col("recall_20") < 1) | F.col("violation_20") | F.col("forbidden_20")
    means = [F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in (5, 10, 20)]
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    got = recalls.groupBy(*by).agg(*means, F.count_if(F.col("recall_20") == 1).alias("n_full"), rate("violation_20").alias("violation_rate"), rate("forbidden_20").alias("forbidden_rate"), F.count_if(F.col("recall_20") < 1).alias("n_unresolved"), F.count_if(bad).alias("n_failed"))
    w = Window.orderBy(F.desc("recall_20"), "violation_rate", "forbidden_rate", F.desc("recall_5"), "n_failed", *by)  # a row a variant
    return got.withColumn("place", F.row_number().over(w).cast("long"))


def next_step(summary: DataFrame) -> Column:
    """What to do after the best variant's summary."""
    ready = (F.col("recall_20") == 1) & (F.col("violation_rate") == 0) & (F.col("forbidden_rate") == 0)
    return F.when(ready & (F.col("recall_5") == 1), "candidate_generation_can_directly_promote_to_retriever_v2").when(ready, "design_deterministic_rerank_v2").otherwise("improve_candidate_generation_before_rerank")


def case_method_report(scores: DataFrame, case: str, methods: list[str], method: str = "method") -> DataFrame:
    """One row a case: recall at 5, reciprocal rank and reasons of every method side by side, and the methods below recall 1."""
    pick = lambda m, c: F.max(F.when(F.col(method) == m, F.col(c)))
    side = [x for m in methods for x in (pick(m, "recall_5").alias(f"{m}_recall"), pick(m, "reciprocal_rank").alias(f"{m}_rr"), F.array_join(pick(m, "reasons"), ",").alias(f"{m}_reasons"))]
    below = F.array_sort(F.collect_set(F.when(F.col("recall_5") < 1, F.col(method))))
    return scores.groupBy(case).agg(*side, F.array_join(below, ",").alias("below_one"), F.count_if(F.col("reciprocal_rank") == 1).alias("n_first"))


def what_if_without(scores: DataFrame, reasons: list[str], order: list[str], method: str = "method") -> DataFrame:
    """Per method, were these reasons no reasons: failed and passed cases, and the remaining reasons as first seen."""
    left = scores.withColumn("reasons", F.filter("reasons", lambda r: ~r.isin(reasons)))
    n = left.groupBy(method).agg(F.count_if(F.size("reasons") > 0).alias("n_failed"), F.count_if(F.size("reasons") == 0).alias("n_passed"))
    said = first_seen(left, [method], "reasons", order, "remaining")
    return n.join(said, method, "left").withColumn("remaining", F.coalesce("remaining", F.array().cast("array<string>")))


def first_generation_reasons() -> Column:
    """Ordered reasons against a case's run as the first generation has them, without a minimum of hits; eligible if there is none.

    From request_error, recall_5, forbidden_hit and boundary_violation."""
    named = {"request_error": F.col("request_error"), "recall_at_5_below_pilot_gate": F.col("recall_5") < 1, "forbidden_hit_detected": F.col("forbidden_hit"), "solution_boundary_violation": F.col("boundary_violation")}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
