"""Checks of extracted entities against their sources and each other: ordered issue names, by entity or by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUSTOMER = ["customer_profile", "meeting_transcript"]
HIGH = ["high", "critical"]
# Gap categories that a blocking context category asks for, roles of authority, actions, vague wordings.
GAPS_OF_CONTEXT = {"business_goal": ["business_goal"], "current_process": ["delivery_readiness"], "pain_or_problem": ["current_metrics"], "stakeholders": ["authority", "decision_process"], "budget": ["budget"], "timeline": ["timeline"], "data": ["data"], "systems": ["integration"], "security": ["security"], "success_metrics": ["success_metrics"]}
AUTHORITY_ROLES = ["decision_maker", "budget_owner", "business_owner", "champion_candidate"]
KEY_ROLES = ["champion", "decision_maker", "budget_owner", "business_owner"]
EARLY_BLOCKED = ["commercial_proposal", "procurement", "contracting"]
LOW_SCORE_ALLOWED = ["clarification", "qualification", "stakeholder_alignment", "technical_validation"]
VAGUE_QUESTIONS = ["进一步了解", "持续沟通", "后续确认", "请补充信息", "followup", "clarify"]
SUITABLE = ["suitable_now", "suitable_for_poc", "suitable_after_prerequisites"]
LIMITED = ["not_recommended_now", "not_suitable_for_ai", "insufficient_information"]


def issues(named: dict[str, Column]) -> Column:
    """Names whose condition holds, in order; an unknown condition does not."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def resolved(refs: DataFrame, index: DataFrame, case: str) -> DataFrame:
    """refs (case, item, position, source_id, source_type) with what the index says: known_type, verified (null where unknown)."""
    known = index.groupBy(case, "source_id").agg(F.max("source_type").alias("known_type"), F.bool_or("verified").alias("verified"))
    return refs.join(known, [case, "source_id"], "left")


def evidence_issues(refs: DataFrame, index: DataFrame, items: DataFrame, case: str, forbidden: list[str] = (), supports: list[str] | None = None) -> DataFrame:
    """case, item, issues of every item: per reference unknown_source, type_mismatch or forbidden_type with its position, then no_verified_support.

    supports: the types whose verified sources support an item (all, if None); forbidden ones never do."""
    r = resolved(refs, index, case)
    wrong = F.when(F.col("known_type").isNull(), "unknown_source").when(F.col("known_type") != F.col("source_type"), "type_mismatch").when(F.col("known_type").isin(list(forbidden)), "forbidden_type")
    good = wrong.isNull() & F.col("verified") & (F.lit(True) if supports is None else F.col("known_type").isin(supports))
    each = r.withColumn("wrong", wrong).withColumn("good", good)
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("wrong").isNotNull(), F.struct("position", "wrong")))), lambda x: F.concat_ws(":", x["wrong"], x["position"].cast("string")))
    got = each.groupBy(case, "item").agg(found.alias("f"), F.bool_or("good").alias("ok"))
    j = items.select(case, "item").distinct().join(got, [case, "item"], "left")
    none = F.array().cast("array<string>")
    return j.select(case, "item", F.concat(F.coalesce("f", none), F.when(F.coalesce("ok", F.lit(False)), none).otherwise(F.array(F.lit("no_verified_support")))).alias("issues"))


def references_exist(refs: DataFrame, index: DataFrame, items: DataFrame, case: str) -> DataFrame:
    """case, item, valid: there is a reference and all of them are known with their type."""
    r = resolved(refs, index, case).groupBy(case, "item").agg(F.every(F.coalesce(F.col("known_type") == F.col("source_type"), F.lit(False))).alias("ok"))
    return items.select(case, "item").distinct().join(r, [case, "item"], "left").select(case, "item", F.coalesce("ok", F.lit(False)).alias("valid"))


def fact_issues() -> Column:
    """claim_type, n_verified_beyond_notes."""
    return issues({"fact_without_verified_source": (F.col("claim_type") == "fact") & (F.col("n_verified_beyond_notes") == 0)})


def need_issues() -> Column:
    """n_solution_sources, n_verified_customer."""
    return issues({"solution_library_source": F.col("n_solution_sources") > 0, "no_verified_customer_source": F.col("n_verified_customer") == 0})


def pain_issues() -> Column:
    return issues({"pain_is_no_inference": ~F.col("claim_type").isin("inference", "assumption"), "no_evidence": F.col("n_evidence") == 0})


def impact_issues() -> Column:
    """claim_type, quantified, current_value, target_value, measurement_needed."""
    value = F.col("current_value").isNotNull() | F.col("target_value").isNotNull()
    return issues({"unknown_claim": F.col("claim_type") == "unknown", "quantified_without_value": F.col("quantified") & ~value, "no_measurement": ~F.col("quantified") & ~value & (F.coalesce("measurement_needed", F.lit("")) == "")})


def intent_issues() -> Column:
    """quality, intent, positive_signals, negative_signals, unknown_factors (arrays), summary."""
    high = F.col("intent").isin("high", "medium_high")
    positive = F.concat_ws(" ", "positive_signals", "summary")
    every = F.concat_ws(" ", "positive_signals", "negative_signals", "unknown_factors", "summary")
    return issues({
        "insufficient_context": F.col("quality") == "insufficient", "high_intent_on_partial_context": (F.col("quality") == "partially_sufficient") & (F.col("intent") == "high"), "no_positive_signal": high & (F.size("positive_signals") == 0),
        "mentions_solution": every.contains("SOLUTION-"), "mentions_reference": F.upper(every).contains("REFERENCE"), "notes_alone": high & positive.contains("NOTE-") & ~every.contains("MTG-") & ~every.contains("PROFILE-"),
    })


def stakeholder_issues() -> Column:
    """confirmed, role, next_validation, n_verified_customer."""
    return issues({"no_next_step": ~F.col("confirmed") & (F.length(F.trim(F.coalesce("next_validation", F.lit("")))) < 8), "key_role_without_customer_evidence": F.col("confirmed") & F.col("role").isin(KEY_ROLES) & (F.col("n_verified_customer") == 0)})


def question_text(c: str) -> Column:
    """A question without white space, folded, without question marks and full stops at its end."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), "[?？。.]+$", "")


def gap_issues() -> Column:
    """question, priority, business_impact of one gap."""
    q = question_text("question")
    return issues({"question_too_short": F.length(q) < 8, "question_vague": q.isin(VAGUE_QUESTIONS), "impact_not_explained": F.col("priority").isin(HIGH) & (F.length(F.regexp_replace("business_impact", r"\s+", "")) < 10)})


def gap_set_issues() -> Column:
    """Per case: mode, blocking (context categories), gaps (categories), unconfirmed_authority, n_unknown_factors, n_gaps."""
    table = F.create_map(*[x for k, v in GAPS_OF_CONTEXT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    expected = F.flatten(F.transform("blocking", lambda b: F.coalesce(F.element_at(table, b), F.array().cast("array<string>"))))
    return issues({
        "blocking_gap_not_covered": (F.col("mode") == "clarification_only") & (F.size(expected) > 0) & ~F.arrays_overlap("gaps", expected),
        "authority_gap_missing": F.col("unconfirmed_authority") & ~F.arrays_overlap("gaps", F.array(F.lit("authority"), F.lit("decision_process"))), "unknown_factors_without_gap": (F.col("n_unknown_factors") > 0) & (F.col("n_gaps") == 0),
    })


def opportunity_issues() -> Column:
    """quality, suitability, n_unknown_pains, n_pains, n_prerequisites, n_limitations."""
    s = F.col("suitability")
    return issues({"no_related_pain": F.col("n_pains") == 0, "unknown_pain": F.col("n_unknown_pains") > 0, "suitable_now_on_partial_context": (F.col("quality") == "partially_sufficient") & (s == "suitable_now"), "prerequisites_missing": (s == "suitable_after_prerequisites") & (F.col("n_prerequisites") == 0), "limitations_missing": s.isin(LIMITED) & (F.col("n_limitations") == 0)})


def recommendation_issues(recommendations: DataFrame, catalogue: DataFrame, candidates: DataFrame, opportunities: DataFrame, case: str) -> DataFrame:
    """case, rec, issues. recommendations: case, rec, solution, ref_source, ref_type, related (ids).

    catalogue and candidates: case, solution, source_id; opportunities: case, opp, suitability."""
    has = lambda df, name: df.groupBy(case, "solution").agg(F.min("source_id").alias(name))
    r = recommendations.join(has(catalogue, "own_source"), [case, "solution"], "left").join(has(candidates, "found_source"), [case, "solution"], "left")
    known = opportunities.groupBy(case, F.col("opp").alias("_id")).agg(F.bool_or(F.col("suitability").isin(SUITABLE)).alias("fits"))
    links = recommendations.select(case, "rec", F.explode("related").alias("_id")).join(known, [case, "_id"], "left").groupBy(case, "rec").agg(F.count_if(F.col("fits").isNull()).alias("unknown"), F.count("fits").alias("known"), F.bool_or("fits").alias("fits"))
    j = r.join(links, [case, "rec"], "left")
    library = F.coalesce(F.col("ref_type") == "solution_library", F.lit(False))
    return j.select(case, "rec", issues({
        "unknown_opportunity": F.col("unknown") > 0, "solution_not_in_catalogue": F.col("own_source").isNull(), "no_reference": F.col("ref_source").isNull(), "reference_type": F.col("ref_source").isNotNull() & ~library,
        "reference_of_other_solution": library & F.col("own_source").isNotNull() & (F.col("ref_source") != F.col("own_source")), "no_suitable_opportunity": (F.col("known") > 0) & ~F.col("fits"),
        "solution_not_retrieved": F.col("found_source").isNull(), "candidate_source_not_referenced": F.col("found_source").isNotNull() & ~(library & F.coalesce(F.col("ref_source") == F.col("found_source"), F.lit(False))),
    }).alias("issues"))


def trace_issues(traces: DataFrame, owners: DataFrame, related: dict[str, DataFrame], case: str) -> DataFrame:
    """case, trace, issues: orphan (no such owner), then unknown_<kind> for kinds with an id that the case does not have.

    traces: case, trace, owner and an array column a kind; owners and related: case, id. Ids are compared without case and outer spaces."""
    fold = lambda c: F.lower(F.trim(c))
    j = traces.join(owners.select(case, F.col("id").alias("owner"), F.lit(True).alias("_own")).distinct(), [case, "owner"], "left")
    named = {"orphan": F.col("_own").isNull()}
    for kind, ids in related.items():
        bad = traces.select(case, "trace", F.explode(kind).alias("_x")).select(case, "trace", fold(F.col("_x")).alias("_x")).join(ids.select(case, fold(F.col("id")).alias("_x")).distinct(), [case, "_x"], "left_anti").select(case, "trace").distinct()
        j = j.join(bad.withColumn(f"_{kind}", F.lit(True)), [case, "trace"], "left")
        named[f"unknown_{kind}"] = F.col(f"_{kind}").isNotNull()
    return j.select(case, "trace", issues(named).alias("issues"))


def action_issues() -> Column:
    """priority, action_type, action, stage, level, blocking_gap, decider_confirmed, high_gap_linked, high_risk_linked, n_participants, n_criteria, timeframe."""
    p0, t = F.col("priority") == "P0", F.col("action_type")
    return issues({
        "p0_without_high_gap_or_risk": p0 & ~F.col("high_gap_linked") & ~F.col("high_risk_linked"), "too_early": p0 & F.col("stage").isin("discovery", "unknown") & F.col("blocking_gap") & t.isin(EARLY_BLOCKED),
        "no_confirmed_decider": p0 & ~F.col("decider_confirmed") & t.isin(EARLY_BLOCKED), "low_score": p0 & F.col("level").isin("low", "very_low") & ~t.isin(LOW_SCORE_ALLOWED), "no_participants": F.col("n_participants") == 0,
        "no_success_criteria": F.col("n_criteria") == 0, "no_timeframe": F.coalesce("timeframe", F.lit("")) == "", "text_too_short": F.length("action") < 8, "vague": F.lower("action").isin("follow up", "持续跟进", "保持联系"),
    })


def final_checks(found: dict[str, DataFrame], cases: DataFrame, case: str, warnings: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(case, issue_code, blocking, n for every kind of issue; every case with passed and its blocking issues). found: code -> rows with the case."""
    every = None
    for code, rows in found.items():
        part = rows.groupBy(case).agg(F.count("*").alias("n")).select(case, F.lit(code).alias("issue_code"), F.lit(code not in warnings).alias("blocking"), "n")
        every = part if every is None else every.unionByName(part)
    n = every.groupBy(case).agg(F.sum(F.when(F.col("blocking"), F.col("n")).otherwise(0)).alias("n_blocking"))
    return every, cases.select(case).join(n, case, "left").select(case, F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"), (F.coalesce("n_blocking", F.lit(0)) == 0).alias("passed"))


def uniqueness(cases: DataFrame, entities: DataFrame, traces: DataFrame, case: str) -> DataFrame:
    """Every case with the rules it breaks: no_rows, repeated_id, repeated_text (white space folded), trace_mismatch, not_by_priority.

    entities: case, id, text, position, priority; traces: case, id."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    e = entities.groupBy(case).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(text).alias("texts"))
    t = traces.groupBy(case, "id").agg(F.count("*").alias("t"))
    both = entities.select(case, "id").distinct().withColumn("e", F.lit(1)).join(t, [case, "id"], "full").groupBy(case).agg(F.bool_or(F.col("e").isNull() | F.coalesce(F.col("t") != 1, F.lit(True))).alias("mismatch"))
    # in order if no entity stands after one of a later priority: extremes a priority tell, so a large case is not gone through in one task
    ends = entities.groupBy(case, "priority").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    w = Window.partitionBy(case).orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    falls = ends.withColumn("_h", F.max("hi").over(w)).groupBy(case).agg(F.bool_or(F.col("_h") > F.col("lo")).alias("falls"))
    j = cases.select(case).join(e, case, "left").join(both, case, "left").join(falls, case, "left")
    return j.select(case, issues({"no_rows": F.col("n").isNull(), "repeated_id": F.col("ids") < F.col("n"), "repeated_text": F.col("texts") < F.col("n"), "trace_mismatch": F.col("mismatch"), "not_by_priority": F.col("falls")}).alias("issues"))
