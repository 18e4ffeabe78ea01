"""Responses and their reviews: rubric scores, averages, annotations, packets, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of claims and wordings, scores of a human review.
ROI = r"(?i)(roi|回报|收益|提升)\s*[:：]?\s*\d+%?"
GUARANTEE = r"(?i)(保证|确保|100%|一定会|必然)"
BUZZWORDS = "(赋能|抓手|闭环|全链路)"
HUMAN_SCORES = ["business_relevance_score", "evidence_grounding_score", "risk_fallback_score", "actionability_score", "communication_quality_score", "product_thinking_score"]


def response_scores() -> dict[str, Column]:
    """The six rubric scores and their sum, from the columns of a response and its case:

    n_present, n_required, valid (schema); filled (array of filled sections), required_sections; evidence_titles, debug_count, shadow
    (a debug is there), solution (proposed text), fallback, confirmation, fallback_reasons, expected_fallback; forbidden_claims; pains,
    opportunities (arrays), note, summary. Fractions are rounded half to even."""
    filled = F.size(F.array_intersect("required_sections", "filled"))
    titles = F.size(F.filter("evidence_titles", lambda t: (t != "") & F.col("solution").contains(t)))
    n = F.size("evidence_titles")
    claims = F.concat_ws("\n", F.nullif(F.trim("solution"), F.lit("")), F.nullif(F.trim("note"), F.lit("")), F.array_join("pains", "\n"), F.array_join("opportunities", "\n"))
    text = F.concat_ws("\n", "summary", claims, F.array_join("fallback_reasons", "\n"))
    risky = F.exists("forbidden_claims", lambda c: F.lower(claims).contains(F.lower(c))) | claims.rlike(ROI) | claims.rlike(GUARANTEE)
    quiet = ~F.col("shadow") | ~F.lower("solution").contains("shadow")
    expected = F.when(F.col("fallback"), 10).otherwise(0) + F.when(F.col("confirmation"), 3).otherwise(0) + F.when(F.size("fallback_reasons") > 0, 2).otherwise(0)
    out = {
        "schema_validity": F.when(F.col("valid") & (F.col("n_present") == F.col("n_required")), 20).otherwise(F.bround(20 * F.col("n_present") / F.col("n_required"), 0)),
        "section_completeness": F.bround(15 * filled / F.greatest(F.lit(1), F.size("required_sections")), 0),
        "evidence_grounding": F.when(n == 0, F.when(F.col("fallback"), 20).otherwise(0)).otherwise(F.when(titles > 0, 10).otherwise(0) + F.when(n == F.col("debug_count"), 5).otherwise(0) + F.when(quiet, 5).otherwise(0)),
        "hallucination_risk": F.when(risky, 0).otherwise(20),
        "fallback_alignment": F.when(F.col("expected_fallback"), expected).otherwise(F.when(F.col("fallback"), 0).otherwise(15)),
        "business_clarity": F.when(text.rlike("[一-鿿]"), 3).otherwise(0) + F.when((F.size("pains") > 0) & (F.size("opportunities") > 0), 4).otherwise(0) + F.when(F.length("solution").between(20, 240), 2).otherwise(0) + F.when(F.regexp_count(text, F.lit(BUZZWORDS)) <= 2, 1).otherwise(0),
    }
    out = {k: v.cast("long") for k, v in out.items()}
    return out | {"overall": sum(out.values(), F.lit(0).cast("long"))}


PROBLEMS = {"failed": "overall < 70", "risky": "hallucination_risk = 0", "mismatched": "fallback_alignment < 15", "invalid": "not valid"}


def score_averages(scored: DataFrame, by: str, dimensions: list[str]) -> DataFrame:
    """Per provider the mean of each dimension (4 places) and how many cases have each problem. Which cases they are: see problem_cases.

    scored: by, the dimensions, overall, hallucination_risk, fallback_alignment, valid."""
    return scored.groupBy(by).agg(*[F.round(F.avg(d), 4).alias(d) for d in dimensions], *[F.count_if(F.expr(c)).alias(f"n_{n}") for n, c in PROBLEMS.items()])


def problem_cases(scored: DataFrame, by: str, case: str) -> DataFrame:
    """by, problem, case: the lists of cases with a problem, a row an entry, so a provider may have any number of them."""
    return scored.select(by, case, F.explode(F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in PROBLEMS.items()]))).alias("problem"))


def overall_human() -> Column:
    """Mean of the six human scores times 20, two places."""
    return F.round(sum((F.col(c) for c in HUMAN_SCORES[1:]), F.col(HUMAN_SCORES[0])) / 6 * 20, 2)


def annotation_issues() -> Column:
    """Ordered reasons against an annotation: reviewer_id, reviewed_at, the six scores, overall_human_score, pass_fail."""
    n = sum((F.col(c).isNotNull().cast("int") for c in HUMAN_SCORES), F.lit(0))
    out_of_range = F.lit(False)
    for c in HUMAN_SCORES:
        out_of_range |= F.coalesce(~F.col(c).between(1, 5), F.lit(False))
    own = F.col("overall_human_score")
    named = {
        "score_out_of_range": out_of_range, "some_scores_missing": (n > 0) & (n < 6), "reviewed_without_reviewer": F.col("reviewer_id").isNull() & F.col("reviewed_at").isNotNull(), "review_without_scores": F.col("reviewer_id").isNotNull() & (n < 6),
        "overall_mismatch": (n == 6) & own.isNotNull() & (F.round(own, 2) != overall_human()), "overall_too_early": (n < 6) & own.isNotNull(), "verdict_too_early": (n < 6) & F.col("pass_fail").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))


def effective_annotations(template: DataFrame, local: DataFrame, case: str, order: str) -> DataFrame:
    """The template's rows, each replaced by the last local row of its case (by `order`); local cases beyond the template come along."""
    last = local.groupBy(case).agg(F.max_by(F.struct(*[c for c in local.columns if c != case]), order).alias("_l"))
    j = template.join(last, case, "full")
    return j.select(case, *[F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)).alias(c) for c in template.columns if c != case])


def human_summary(annotations: DataFrame, by: str) -> DataFrame:
    """Status of a review round, means (4 places) and pass rate of completed reviews (those with a reviewer)."""
    done = F.col("reviewer_id").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(done, F.col(c))), 4).alias(c)
    got = annotations.groupBy(by).agg(F.count("*").alias("n_annotations"), F.count_if(done).alias("n_completed"), *[mean(c) for c in [*HUMAN_SCORES, "overall_human_score"]], F.round(F.count_if(done & (F.col("pass_fail") == "pass")) / F.nullif(F.count_if(done), F.lit(0)), 4).alias("pass_rate"))
    return got.withColumn("status", F.when(F.col("n_completed") == 0, "not_started").when(F.col("n_completed") == F.col("n_annotations"), "completed").otherwise("in_progress"))


def review_packets(cases: DataFrame, responses: DataFrame, case: str) -> DataFrame:
    """cases (query) joined with their response's solution: previews of 120 and 240 characters, white space folded."""

    def preview(c: str, n: int) -> Column:
        return F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), 1, n)

    return cases.join(responses, case, "left").select(case, preview("query", 120).alias("query_preview"), preview("solution", 240).alias("solution_preview"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def observability(log: DataFrame, request: str) -> DataFrame:
    """Per request: skills run and failed, providers by outcome, candidates, evidence and whether it fell back. log: request, kind, outcome, value."""
    n = lambda kind, outcome=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if outcome is None else F.col("outcome") == outcome))
    return log.groupBy(request).agg(n("skill").alias("n_skills"), n("skill", "failed").alias("n_failed_skills"), n("provider", "success").alias("n_providers_ok"), n("provider", "failed").alias("n_providers_failed"), n("provider", "skipped").alias("n_providers_skipped"), F.coalesce(F.sum(F.when(F.col("kind") == "candidates", F.col("value"))), F.lit(0)).alias("n_candidates"), F.coalesce(F.sum(F.when(F.col("kind") == "evidence", F.col("value"))), F.lit(0)).alias("n_evidence"), F.bool_or((F.col("kind") == "fallback") & (F.col("outcome") == "recommended")).alias("fell_back"))
