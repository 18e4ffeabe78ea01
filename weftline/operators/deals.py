"""Deal analytics: source index, sufficiency, score dimensions, fit, level, limiters, reliability, flags, follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the dimensions, bands, categories, points by intent and stage, caps by fit and suitability.
WEIGHTS = {"business_need": 20, "business_value": 15, "budget": 15, "authority": 15, "timeline": 10, "solution_fit": 15, "delivery_readiness": 10}
BANDS = {"high": 80, "medium_high": 65, "medium": 45, "low": 25}
CATEGORIES = ["business_goal", "budget", "current_process", "data", "pain_or_problem", "security", "stakeholders", "success_metrics", "systems", "timeline"]
CORE = ["business_goal", "pain_or_problem", "stakeholders"]
INTENT_POINTS = {"high": 12, "medium_high": 12, "medium": 9, "low": 6, "unknown": 6}
STAGE_POINTS = {"procurement": 8, "contracting": 8, "poc_planning": 7, "solution_exploration": 6, "discovery": 5, "unknown": 3}
FIT_POINTS = {"high": 15, "medium": 12, "low": 7, "not_recommended": 3}
SUITABLE = {"suitable_now": 15, "suitable_for_poc": 12, "suitable_after_prerequisites": 10}
DELIVERY_GAPS = ["data", "integration", "security", "compliance", "delivery_readiness"]
DECIDERS = ["decision_maker", "budget_owner"]


def _points(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def source_index(cases: DataFrame, lists: dict[str, DataFrame], case: str) -> DataFrame:
    """Case -> its sources in order: PROFILE-01, MTG-01, then NOTE-nn, CONSTRAINT-nn and SOLUTION-nn by position.

    cases: the case ids. lists: note, constraint, solution -> rows (case, position from 1 on, verified). Numbers of two digits or more,
    never cut, so ids of differing length do not sort as strings: order by place, then position."""
    kinds = {"note": ("NOTE", "salesperson_note"), "constraint": ("CONSTRAINT", "known_constraint"), "solution": ("SOLUTION", "solution_library")}
    fixed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(1).cast("long").alias("position"), F.lit(a).alias("source_id"), F.lit(b).alias("source_type"), F.lit(True).alias("verified")) for i, (a, b) in enumerate([("PROFILE-01", "customer_profile"), ("MTG-01", "meeting_transcript")])])
    out = cases.select(case, F.explode(fixed).alias("x")).select(case, "x.*")
    for i, (name, rows) in enumerate(lists.items()):
        prefix, kind = kinds[name]
        at = F.col("position").cast("long")
        out = out.unionByName(rows.select(case, F.lit(2 + i).alias("place"), at.alias("position"), F.format_string(prefix + "-%02d", at).alias("source_id"), F.lit(kind).alias("source_type"), "verified"))
    return out


def fallback_source(index: DataFrame, case: str) -> DataFrame:
    """The source that stands in where an item has no evidence: a meeting, else a profile, else the first verified one."""
    rank = F.when(F.col("source_type") == "meeting_transcript", 0).when(F.col("source_type") == "customer_profile", 1).when(F.col("verified"), 2)
    return index.where(rank.isNotNull()).groupBy(case).agg(F.min_by("source_id", F.struct(rank.alias("r"), "place", "position")).alias("fallback"))


def sufficiency(available: Column, core: list[str] = CORE, every: list[str] = CATEGORIES) -> tuple[Column, Column, Column]:
    """(missing categories, blocking ones, quality): all core and 6 of any, or 2 core or 4 of any, or insufficient."""
    missing, blocking = F.array_sort(F.array_except(_listed(every), available)), F.array_sort(F.array_except(_listed(core), available))
    n, c = F.size(available), F.size(F.array_intersect(available, _listed(core)))
    return missing, blocking, F.when((c == len(core)) & (n >= 6), "sufficient").when((c >= 2) | (n >= 4), "partially_sufficient").otherwise("insufficient")


def solution_fit(recommendations: DataFrame, opportunities: DataFrame, case: str) -> DataFrame:
    """case, fit: the best recommendation's points, each held to the best cap of the suitable opportunities it is linked with.

    recommendations: case, rec, fit_level, related (array of ids); opportunities: case, opp, suitability."""
    caps = opportunities.select(case, F.col("opp").alias("_id"), _points(SUITABLE, F.col("suitability")).alias("cap")).where("cap is not null")
    linked = recommendations.select(case, "rec", "fit_level", F.explode_outer("related").alias("_id")).join(caps, [case, "_id"], "left")
    each = linked.groupBy(case, "rec", "fit_level").agg(F.max("cap").alias("cap"))
    return each.groupBy(case).agg(F.max(F.when(F.col("cap").isNull(), 0).otherwise(F.least(_points(FIT_POINTS, F.col("fit_level")), F.col("cap")))).alias("fit"))


def dimensions(x: DataFrame) -> dict[str, Column]:
    """Points of the seven dimensions from a case's counts: n_needs, n_pains, n_impacts, n_quantified, n_impact_types, budget_fact,
    timeline_fact, gaps (categories), intent, stage, roles (confirmed), n_stakeholders, n_suitable, n_candidates, n_recommendations, fit,
    rec_prerequisites, rec_risks, opp_prerequisites."""
    gap = lambda *names: F.arrays_overlap("gaps", _listed(list(names)))
    roles = F.col("roles")
    authority = (
        F.when(F.size(F.array_except(_listed(DECIDERS), roles)) == 0, 15).when(F.arrays_overlap(roles, _listed(DECIDERS)), 12).when(F.arrays_overlap(roles, _listed(["business_owner", "champion"])), 9)
        .when(F.size(roles) > 0, 6).when(F.col("n_stakeholders") > 0, 4).otherwise(0)
    )
    delivery = 10 - F.least(2 * F.size(F.array_intersect(F.col("gaps"), _listed(DELIVERY_GAPS))), F.lit(8)) - F.when(F.col("rec_prerequisites"), 2).otherwise(0) - F.when(F.col("rec_risks"), 1).otherwise(0) - F.when(F.col("opp_prerequisites"), 1).otherwise(0)
    return {
        "business_need": F.least(F.lit(20), F.least(4 * F.col("n_needs"), F.lit(8)) + F.least(3 * F.col("n_pains"), F.lit(6)) + F.least(3 * F.col("n_impacts"), F.lit(6))),
        "business_value": F.when(F.col("n_impacts") == 0, 0).otherwise(8 + F.when(F.col("n_quantified") > 0, 4).otherwise(0) + F.when(F.col("n_impact_types") >= 2, 3).otherwise(0)),
        "budget": F.when(F.col("budget_fact"), 15).when(gap("budget"), 3).otherwise(_points(INTENT_POINTS, F.col("intent"))),
        "authority": F.when(gap("authority", "decision_process"), F.least(authority, F.lit(8))).otherwise(authority),
        "timeline": F.when(F.col("timeline_fact"), 10).when(gap("timeline"), 2).otherwise(_points(STAGE_POINTS, F.col("stage"))),
        "solution_fit": F.when(F.col("n_suitable") == 0, 0).when(F.col("n_candidates") == 0, 4).when(F.col("n_recommendations") == 0, 7).otherwise(F.coalesce("fit", F.lit(0))),
        "delivery_readiness": F.greatest(F.lit(0), F.least(F.lit(10), delivery)),
    }


def level(total: Column) -> Column:
    return F.when(total >= 80, "high").when(total >= 65, "medium_high").when(total >= 45, "medium").when(total >= 25, "low").otherwise("very_low")


def confidence(quality: Column, n_high_gaps: Column) -> Column:
    return F.when((quality == "sufficient") & (n_high_gaps <= 1), "high").when(quality.isin("sufficient", "partially_sufficient"), "medium").otherwise("low")


def strongest_and_weakest(points: dict[str, Column]) -> tuple[Column, Column]:
    """Dimensions with the highest and with the lowest points (all that tie), in their order."""
    high, low = F.greatest(*points.values()), F.least(*points.values())
    pick = lambda end: F.array_compact(F.array(*[F.when(c == end, F.lit(n)) for n, c in points.items()]))
    return pick(high), pick(low)


def limiters(points: dict[str, Column], high_gaps: Column, no_candidate: Column, roles: Column, budget_gap: Column) -> Column:
    """What holds the score down, in order, once each: dimensions below 60 % of their weight, high gaps, candidates, deciders, budget.

    high_gaps: array of gap texts (see gap_text)."""
    low = [F.when(c < WEIGHTS[n] * 0.6, F.lit(n + LOW_DIMENSION)) for n, c in points.items()]
    last = [F.when(no_candidate, F.lit(NO_CANDIDATE)), F.when(~F.arrays_overlap(roles, _listed(DECIDERS)), F.lit(NO_DECIDER)), F.when(budget_gap, F.lit(BUDGET_GAP))]
    return F.array_distinct(F.concat(F.array_compact(F.array(*low)), high_gaps, F.array_compact(F.array(*last))))


# What raises the score, by gap category and otherwise, and the wordings of what holds it down.
CONDITIONS = {
    "budget": "确认预算范围、审批状态和资金来源。",
    "authority": "确认最终决策人、预算负责人及其参与方式。",
    "decision_process": "确认决策链、审批节点和最终签署流程。",
    "timeline": "确认采购时间、POC时间和目标上线里程碑。",
    "procurement": "确认采购流程、供应商准入和合同要求。",
    "data": "确认数据来源、质量、权限和可用范围。",
    "integration": "确认系统接口、集成责任和技术边界。",
    "security": "完成安全要求、权限管理和数据保护确认。",
    "compliance": "完成适用法规和内部合规要求确认。",
    "delivery_readiness": "确认客户资源、项目Owner和实施配合能力。",
}
NO_CANDIDATE_CONDITION, NO_DECIDER_CONDITION = "补充方案匹配所需的业务、数据和集成信息。", "确认决策人和预算负责人的角色。"
LOW_DIMENSION, GAP = "得分低于该维度满分的60%。", "信息缺口："
NO_CANDIDATE, NO_DECIDER, BUDGET_GAP = "没有检索候选方案，Solution Fit受到限制。", "尚未确认decision_maker或budget_owner，Authority受到限制。", "预算仍是信息缺口，Budget受到限制。"


def gap_text(category: Column, description: Column) -> Column:
    return F.concat(category, F.lit(GAP), description)


def conditions(gaps: Column, no_candidate: Column, roles: Column) -> Column:
    """What would raise the score, in the order of the gaps, once each."""
    by_gap = F.transform(gaps, lambda g: F.element_at(F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv]), g))
    last = F.array_compact(F.array(F.when(no_candidate, F.lit(NO_CANDIDATE_CONDITION)), F.when(~F.arrays_overlap(roles, _listed(DECIDERS)), F.lit(NO_DECIDER_CONDITION))))
    return F.array_distinct(F.concat(F.array_compact(by_gap), last))


def reliability(x: DataFrame) -> tuple[Column, Column]:
    """(confidence, share of grounded recommendations) from quality, score_confidence, n_critical_gaps, n_unconfirmed, n_recommendations, n_grounded."""
    c = F.when((F.col("quality") == "sufficient") & (F.col("score_confidence") == "high"), "high").when((F.col("quality") == "insufficient") | (F.col("n_critical_gaps") > 0) | (F.col("n_unconfirmed") >= 2), "low").otherwise("medium")
    return c, F.when(F.col("n_recommendations") == 0, 0.0).otherwise(F.round(F.col("n_grounded") / F.col("n_recommendations"), 6))


def evaluation_flags() -> Column:
    """Ordered flag:severity of a case, from gaps, unknown_fields, unconfirmed_decider, quality, n_recommendations, high_risk."""
    gap = lambda n: F.array_contains("gaps", n)
    flags = [
        (F.lit(True), "human_review_required:medium"), (F.array_contains("unknown_fields", "budget") | gap("budget"), "unknown_budget:high"), (F.col("unconfirmed_decider") | gap("authority"), "unknown_decision_maker:high"), (gap("timeline"), "unknown_timeline:medium"),
        (F.col("quality") != "sufficient", "low_context_quality:medium"), (F.col("n_recommendations") == 0, "solution_without_knowledge_reference:medium"), (F.col("high_risk"), "human_review_required:high"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def follow_up(rows: DataFrame, case: str, limits: dict[str, int]) -> DataFrame:
    """case, agenda: the first of each kind (kind -> how many) by position, kinds in the order given, each text once.

    rows: case, kind, position, text. Ties in position go to the smaller text."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(limits) for x in (k, i)]), F.col("kind"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("kind"))
    first = rows.where(most.isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy(case, "kind").orderBy("position", "text"))).where(F.col("n") <= most)
    return first.groupBy(case).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "n", "text"))), lambda x: x["text"])).alias("agenda"))


def company_context(requests: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """requests with their company's columns as one struct, null where it is unknown; repeated companies: the least row."""
    held = companies.groupBy(key).agg(F.min(F.struct(*[c for c in companies.columns if c != key])).alias("context"))
    return requests.join(held, key, "left")


def known_industry(requests: DataFrame, corpus: DataFrame, industry: str, industries: str) -> DataFrame:
    """requests whose industry is kept only if some document has it, whatever its case."""
    known = corpus.select(F.explode(industries).alias("_i")).select(F.lower("_i").alias("_i")).distinct().withColumn("_k", F.lit(True))
    return requests.withColumn("_i", F.lower(industry)).join(known, "_i", "left").withColumn(industry, F.when(F.col("_k"), F.col(industry))).drop("_i", "_k")


def detected_goals(stated: Column, text: Column, triggers: dict[str, str]) -> Column:
    """The stated goal, then goals whose pattern occurs in the case-folded text in the order given; trimmed, not empty, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = F.array_compact(F.array(stated, *[F.when(low.rlike(p), F.lit(g)) for g, p in triggers.items()]))
    return F.array_distinct(F.filter(F.transform(every, lambda g: F.trim(g)), lambda g: g != ""))
