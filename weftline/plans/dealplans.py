"""Queries of deal analytics and of the checks of extracted entities, with the SQL that states the same.

Orders are cases, their lines the entities that were extracted; conversations are cases where sources are indexed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deals, validation
from .roles import table as _t

GAPS = ["budget", "authority", "decision_process", "timeline", "procurement", "data", "integration", "security", "compliance", "delivery_readiness", "business_goal", "success_metrics"]
ROLES = ["decision_maker", "budget_owner", "business_owner", "champion", "user", "champion_candidate"]
SUITABILITY = ["suitable_now", "suitable_for_poc", "suitable_after_prerequisites", "not_recommended_now", "not_suitable_for_ai", "insufficient_information"]
FITS = ["high", "medium", "low", "not_recommended"]
STAGES = ["procurement", "contracting", "poc_planning", "solution_exploration", "discovery", "unknown"]
QUALITIES = ["sufficient", "partially_sufficient", "insufficient"]


def _pick(values: list[str], i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({i} % {len(values)} + 1 AS INT)]"


def _lines(spark, d):
    li = _t(spark, d, "lineitem")
    p, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    x = li.select(F.col("l_orderkey").alias("c"), p.alias("p"), n.alias("n"), F.col("l_quantity").alias("qty"), "l_discount", "l_tax", F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), (F.col("l_suppkey") % 3).alias("k"))
    p = F.col("p")
    return x.withColumns({
        "gap": F.when(F.col("l_tax") > 0.045, _pick(GAPS, p)), "priority": F.when(F.col("qty") > 40, "critical").when(F.col("qty") > 25, "high").otherwise("medium"), "role": F.when(F.col("k") == 0, _pick(ROLES, p)), "confirmed": F.col("qty") > 25,
        "fact": F.when(F.col("k") == 1, _pick([" Budget", "timeline ", "data", "other", "systems"], p)), "suitability": F.when(F.col("k") == 2, _pick(SUITABILITY, p)), "fit_level": F.when((F.col("s") == "F") & (F.col("n") % 2 == 0), _pick(FITS, p)),
    })


_LINES = f"""ln AS (SELECT l_orderkey AS c, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS qty, l_discount, l_tax, l_returnflag AS f, l_linestatus AS s, l_suppkey % 3 AS k, CASE WHEN l_tax > 0.045 THEN {_pick_sql(GAPS, 'l_partkey')} END AS gap, CASE WHEN l_quantity > 40 THEN 'critical' WHEN l_quantity > 25 THEN 'high' ELSE 'medium' END AS priority,
    CASE WHEN l_suppkey % 3 = 0 THEN {_pick_sql(ROLES, 'l_partkey')} END AS role, l_quantity > 25 AS confirmed, CASE WHEN l_suppkey % 3 = 1 THEN {_pick_sql([' Budget', 'timeline ', 'data', 'other', 'systems'], 'l_partkey')} END AS fact, CASE WHEN l_suppkey % 3 = 2 THEN {_pick_sql(SUITABILITY, 'l_partkey')} END AS suitability, CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN {_pick_sql(FITS, 'l_partkey')} END AS fit_level FROM lineitem)"""


def _fits(spark, d):
    li = _lines(spark, d)
    name = lambda n: F.concat(F.lit("O"), n.cast("string"))
    recs = li.where("fit_level is not null").select("c", F.concat_ws("-", F.col("n").cast("string"), F.col("p").cast("string")).alias("rec"), "fit_level", F.array(name(F.col("n") - 1), name(F.col("n") + 1)).alias("related"))
    opps = li.where("suitability is not null").select("c", name(F.col("n")).alias("opp"), "suitability")
    return deals.solution_fit(recs, opps, "c")


_FIT = f"""{_LINES}, cap AS (SELECT c, n, max(CASE suitability WHEN 'suitable_now' THEN 15 WHEN 'suitable_for_poc' THEN 12 WHEN 'suitable_after_prerequisites' THEN 10 END) AS cap FROM ln WHERE suitability IS NOT NULL GROUP BY ALL),
    rc AS (SELECT DISTINCT c, n, p, CASE fit_level WHEN 'high' THEN 15 WHEN 'medium' THEN 12 WHEN 'low' THEN 7 ELSE 3 END AS pts FROM ln WHERE fit_level IS NOT NULL), rx AS (SELECT rc.c, rc.n, rc.p, pts, max(cap) AS cap FROM rc LEFT JOIN cap ON cap.c = rc.c AND (cap.n = rc.n - 1 OR cap.n = rc.n + 1) GROUP BY ALL), fit AS (SELECT c, max(CASE WHEN cap IS NULL THEN 0 ELSE least(pts, cap) END) AS fit FROM rx GROUP BY c)"""


def _facts(spark, d):
    """One row a case with all counts that the score needs, from one pass over its lines."""
    li = _lines(spark, d)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    impact, fact, rec = F.col("f") == "A", F.lower(F.trim("fact")), F.col("fit_level").isNotNull()
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("n", "p", "gap", "priority")))), lambda x: F.struct(x["gap"].alias("gap"), x["priority"].alias("priority"), F.concat(F.lit("line "), x["n"].cast("string")).alias("description")))
    x = li.groupBy("c").agg(
        n(F.col("f") == "N").alias("n_needs"), n(F.col("f") == "R").alias("n_pains"), n(impact).alias("n_impacts"), n(impact & (F.col("l_discount") > 0.055)).alias("n_quantified"), F.count_distinct(F.when(impact, F.col("p") % 3)).alias("n_impact_types"), some(fact == "budget").alias("budget_fact"), some(fact == "timeline").alias("timeline_fact"),
        gaps.alias("g"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("role")))).alias("roles"), F.count("role").alias("n_stakeholders"), n(F.col("suitability").isin(list(deals.SUITABLE))).alias("n_suitable"), n(F.col("n") > 4).alias("n_candidates"), n(rec).alias("n_recommendations"), some(rec & (F.col("l_discount") > 0.075)).alias("rec_prerequisites"), some(rec & (F.col("l_tax") > 0.065)).alias("rec_risks"),
        some(F.col("suitability").isNotNull() & (F.col("l_discount") > 0.085)).alias("opp_prerequisites"), n(~F.col("confirmed") & F.col("role").isNotNull()).alias("n_unconfirmed"), some((F.col("role") == "decision_maker") & ~F.col("confirmed")).alias("unconfirmed_decider"), some((F.col("f") == "R") & F.col("priority").isin("critical", "high")).alias("high_risk"), F.min("qty").alias("least"),
    )
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("c"), F.element_at(F.array(*map(F.lit, ["high", "medium_high", "medium", "unknown", "low"])), F.substring("o_orderpriority", 1, 1).cast("int")).alias("intent"), _pick(STAGES, F.col("o_orderkey")).alias("stage"), _pick(QUALITIES, F.col("o_custkey")).alias("quality"))
    x = x.join(o, "c").join(_fits(spark, d), "c", "left")
    return x.withColumn("gaps", F.transform("g", lambda y: y["gap"])).withColumn("n_high_gaps", F.size(F.filter("g", lambda y: y["priority"] == "high"))).withColumn("n_critical_gaps", F.size(F.filter("g", lambda y: y["priority"] == "critical")))


_FACTS = f"""{_FIT}, fx AS (SELECT c, count(*) FILTER (f = 'N') AS n_needs, count(*) FILTER (f = 'R') AS n_pains, count(*) FILTER (f = 'A') AS n_impacts, count(*) FILTER (f = 'A' AND l_discount > 0.055) AS n_quantified, count(DISTINCT p % 3) FILTER (f = 'A') AS n_impact_types, coalesce(bool_or(lower(trim(fact)) = 'budget'), false) AS budget_fact, coalesce(bool_or(lower(trim(fact)) = 'timeline'), false) AS timeline_fact,
    coalesce(list(struct_pack(gap := gap, priority := priority, d := 'line ' || n) ORDER BY n, p, gap, priority) FILTER (gap IS NOT NULL), []) AS g, coalesce(list(DISTINCT role) FILTER (confirmed AND role IS NOT NULL), []) AS roles, count(role) AS n_stakeholders, count(*) FILTER (suitability IN ('suitable_now', 'suitable_for_poc', 'suitable_after_prerequisites')) AS n_suitable, count(*) FILTER (n > 4) AS n_candidates, count(fit_level) AS n_recommendations,
    coalesce(bool_or(fit_level IS NOT NULL AND l_discount > 0.075), false) AS rec_prerequisites, coalesce(bool_or(fit_level IS NOT NULL AND l_tax > 0.065), false) AS rec_risks, coalesce(bool_or(suitability IS NOT NULL AND l_discount > 0.085), false) AS opp_prerequisites, count(*) FILTER (role IS NOT NULL AND NOT confirmed) AS n_unconfirmed, coalesce(bool_or(role = 'decision_maker' AND NOT confirmed), false) AS unconfirmed_decider, coalesce(bool_or(f = 'R' AND priority IN ('critical', 'high')), false) AS high_risk FROM ln GROUP BY c),
    fc AS (SELECT fx.*, list_transform(g, lambda y: y.gap) AS gaps, len(list_filter(g, lambda y: y.priority = 'high')) AS n_high_gaps, len(list_filter(g, lambda y: y.priority = 'critical')) AS n_critical_gaps, fit, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium_high' WHEN '3' THEN 'medium' WHEN '4' THEN 'unknown' ELSE 'low' END AS intent, {_pick_sql(STAGES, 'o_orderkey')} AS stage, {_pick_sql(QUALITIES, 'o_custkey')} AS quality FROM fx JOIN orders ON o_orderkey = c LEFT JOIN fit USING (c)),
    a0 AS (SELECT *, CASE WHEN list_contains(roles, 'decision_maker') AND list_contains(roles, 'budget_owner') THEN 15 WHEN list_has_any(roles, ['decision_maker', 'budget_owner']) THEN 12 WHEN list_has_any(roles, ['business_owner', 'champion']) THEN 9 WHEN len(roles) > 0 THEN 6 WHEN n_stakeholders > 0 THEN 4 ELSE 0 END AS au FROM fc),
    dm AS (SELECT *, least(20, least(4 * n_needs, 8) + least(3 * n_pains, 6) + least(3 * n_impacts, 6)) AS business_need, CASE WHEN n_impacts = 0 THEN 0 ELSE 8 + CASE WHEN n_quantified > 0 THEN 4 ELSE 0 END + CASE WHEN n_impact_types >= 2 THEN 3 ELSE 0 END END AS business_value, CASE WHEN budget_fact THEN 15 WHEN list_contains(gaps, 'budget') THEN 3 ELSE CASE intent WHEN 'high' THEN 12 WHEN 'medium_high' THEN 12 WHEN 'medium' THEN 9 ELSE 6 END END AS budget,
        CASE WHEN list_has_any(gaps, ['authority', 'decision_process']) THEN least(au, 8) ELSE au END AS authority, CASE WHEN timeline_fact THEN 10 WHEN list_contains(gaps, 'timeline') THEN 2 ELSE CASE stage WHEN 'procurement' THEN 8 WHEN 'contracting' THEN 8 WHEN 'poc_planning' THEN 7 WHEN 'solution_exploration' THEN 6 WHEN 'discovery' THEN 5 ELSE 3 END END AS timeline, CASE WHEN n_suitable = 0 THEN 0 WHEN n_candidates = 0 THEN 4 WHEN n_recommendations = 0 THEN 7 ELSE coalesce(fit, 0) END AS solution_fit,
        greatest(0, least(10, 10 - least(2 * len(list_distinct(list_filter(gaps, lambda y: y IN ('data', 'integration', 'security', 'compliance', 'delivery_readiness')))), 8) - rec_prerequisites::INT * 2 - rec_risks::INT - opp_prerequisites::INT)) AS delivery_readiness FROM a0),
    tt AS (SELECT *, business_need + business_value + budget + authority + timeline + solution_fit + delivery_readiness AS total FROM dm)"""
_DIMS = list(deals.WEIGHTS)


def deal_dimensions(spark, d):
    x = _facts(spark, d)
    return x.select(F.col("c").alias("case_id"), *[v.cast("long").alias(n) for n, v in deals.dimensions(x).items()])


def _pointed(spark, d):
    x = _facts(spark, d)
    return x.withColumns({n: v.cast("long") for n, v in deals.dimensions(x).items()})


def deal_totals(spark, d):
    x = _pointed(spark, d)
    total = sum((F.col(n) for n in _DIMS[1:]), F.col(_DIMS[0]))
    return x.select(F.col("c").alias("case_id"), total.alias("total"), deals.level(total).alias("level"), deals.confidence(F.col("quality"), F.col("n_high_gaps")).alias("confidence"))


def deal_limits(spark, d):
    x = _pointed(spark, d)
    points = {n: F.col(n) for n in _DIMS}
    high = F.transform(F.filter("g", lambda y: y["priority"] == "high"), lambda y: deals.gap_text(y["gap"], y["description"]))
    strong, weak = deals.strongest_and_weakest(points)
    none = F.col("n_candidates") == 0
    lim = deals.limiters(points, high, none, F.col("roles"), F.array_contains("gaps", "budget"))
    return x.select(F.col("c").alias("case_id"), F.array_join(lim, ";").alias("limiters"), F.array_join(deals.conditions(F.col("gaps"), none, F.col("roles")), ";").alias("conditions"), F.array_join(strong, ",").alias("strongest"), F.array_join(weak, ",").alias("weakest"))


def solution_fit(spark, d):
    return _fits(spark, d).select(F.col("c").alias("case_id"), F.col("fit").cast("long").alias("fit"))


def reliability_summary(spark, d):
    x = _facts(spark, d).withColumn("score_confidence", deals.confidence(F.col("quality"), F.col("n_high_gaps"))).withColumn("n_grounded", F.least("n_recommendations", "n_candidates"))
    c, rate = deals.reliability(x)
    return x.select(F.col("c").alias("case_id"), c.alias("confidence"), rate.alias("grounded_rate"), (F.col("n_needs") + F.col("n_impacts")).alias("n_facts"), F.col("n_pains").alias("n_inferences"), F.col("n_critical_gaps").cast("long").alias("n_critical_gaps"))


def evaluation_flags(spark, d):
    x = _facts(spark, d).withColumn("unknown_fields", F.when(F.col("c") % 9 == 0, F.array(F.lit("budget"))).otherwise(F.array().cast("array<string>")))
    return x.select(F.col("c").alias("case_id"), F.explode(deals.evaluation_flags()).alias("flag"))


def follow_up_lists(spark, d):
    li = _lines(spark, d)
    q = li.where("gap is not null").select("c", F.lit("question").alias("kind"), (F.col("n") * 1000000 + F.col("p")).alias("position"), F.concat(F.lit("ask "), "gap").alias("text"))
    a = li.where("f = 'R'").select("c", F.lit("action").alias("kind"), (F.col("n") * 1000000 + F.col("p")).alias("position"), F.concat(F.lit("act on "), (F.col("p") % 4).cast("string")).alias("text"))
    return deals.follow_up(q.unionByName(a), "c", {"question": 3, "action": 2}).select(F.col("c").alias("case_id"), F.array_join("agenda", ";").alias("agenda"))


def company_context(spark, d):
    """Orders ask for their customer's context; customers of some numbers are not there."""
    c = _t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return deals.company_context(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "context.c_mktsegment", "context.c_nationkey", F.col("context").isNotNull().alias("known"))


def known_industry(spark, d):
    """Customers' segments that some part's type names, in part."""
    r = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("Economy")).otherwise(F.col("c_mktsegment")).alias("industry"))
    corpus = _t(spark, d, "part").select(F.array("p_type").alias("industries"))
    return deals.known_industry(r, corpus, "industry", "industries")


def _sources(spark, d):
    t = _t(spark, d, "conversations").where("conv_id is not null")
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    at = t.select(F.col("conv_id").alias("c"), "role", F.row_number().over(w).alias("position"), (F.col("turn") % 4 == 0).alias("checked"))
    lists = {"note": at.where("role = 'user'").withColumn("verified", F.col("checked")), "constraint": at.where("role = 'system'").withColumn("verified", F.lit(True)), "solution": at.where("role = 'assistant'").withColumn("verified", F.lit(True))}
    return deals.source_index(t.select(F.col("conv_id").alias("c")).distinct(), lists, "c")


_SRC = "at_ AS (SELECT conv_id AS c, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position, turn % 4 = 0 AS checked FROM conversations), si AS (SELECT DISTINCT conv_id AS c, 0 AS place, 1 AS position, 'PROFILE-01' AS source_id, 'customer_profile' AS source_type, true AS verified FROM conversations UNION ALL SELECT DISTINCT conv_id, 1, 1, 'MTG-01', 'meeting_transcript', true FROM conversations UNION ALL SELECT c, CASE role WHEN 'user' THEN 2 WHEN 'system' THEN 3 ELSE 4 END, position, CASE role WHEN 'user' THEN printf('NOTE-%02d', position) WHEN 'system' THEN printf('CONSTRAINT-%02d', position) ELSE printf('SOLUTION-%02d', position) END, CASE role WHEN 'user' THEN 'salesperson_note' WHEN 'system' THEN 'known_constraint' ELSE 'solution_library' END, CASE role WHEN 'user' THEN checked ELSE true END FROM at_)"


def source_index_full(spark, d):
    return _sources(spark, d).select(F.col("c").alias("case_id"), F.col("place").cast("long").alias("place"), "position", "source_id", "source_type", "verified")


def fallback_source(spark, d):
    """Where meetings, and of every third case profiles too, are left out."""
    s = _sources(spark, d).where("source_type <> 'meeting_transcript' and (c % 3 <> 0 or source_type <> 'customer_profile')")
    return deals.fallback_source(s, "c").select(F.col("c").alias("case_id"), "fallback")


def _refs(spark, d):
    """Each user turn is an item with two references, some of them wrong by the turn."""
    t = _t(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("item"))
    a = t.select("c", "item", F.lit(0).alias("position"), F.when(F.col("item") % 3 == 0, "MTG-01").when(F.col("item") % 3 == 1, "NOTE-02").otherwise("SOLUTION-01").alias("source_id"), F.when(F.col("item") % 3 == 0, "meeting_transcript").when(F.col("item") % 3 == 1, "salesperson_note").otherwise("solution_library").alias("source_type"))
    b = t.where("item % 4 <> 0").select("c", "item", F.lit(1).alias("position"), F.when(F.col("item") % 4 == 1, "NOTE-99").when(F.col("item") % 4 == 2, "NOTE-01").otherwise("PROFILE-01").alias("source_id"), F.when(F.col("item") % 4 == 2, "meeting_transcript").when(F.col("item") % 4 == 1, "salesperson_note").otherwise("customer_profile").alias("source_type"))
    return t, a.unionByName(b)


_REFS = f"{_SRC}, it AS (SELECT conv_id AS c, turn AS item FROM conversations WHERE role = 'user'), rf AS (SELECT c, item, 0 AS position, CASE item % 3 WHEN 0 THEN 'MTG-01' WHEN 1 THEN 'NOTE-02' ELSE 'SOLUTION-01' END AS source_id, CASE item % 3 WHEN 0 THEN 'meeting_transcript' WHEN 1 THEN 'salesperson_note' ELSE 'solution_library' END AS st FROM it UNION ALL SELECT c, item, 1, CASE item % 4 WHEN 1 THEN 'NOTE-99' WHEN 2 THEN 'NOTE-01' ELSE 'PROFILE-01' END, CASE item % 4 WHEN 2 THEN 'meeting_transcript' WHEN 1 THEN 'salesperson_note' ELSE 'customer_profile' END FROM it WHERE item % 4 <> 0), rv AS (SELECT rf.*, si.source_type AS kt, si.verified FROM rf LEFT JOIN si USING (c, source_id))"


def validate_evidence(spark, d):
    items, refs = _refs(spark, d)
    x = validation.evidence_issues(refs, _sources(spark, d), items, "c", forbidden=["solution_library"], supports=["customer_profile", "meeting_transcript", "salesperson_note"])
    return x.select(F.col("c").alias("case_id"), "item", F.array_join("issues", ",").alias("issues"))


def references_exist(spark, d):
    items, refs = _refs(spark, d)
    return validation.references_exist(refs, _sources(spark, d), items, "c").select(F.col("c").alias("case_id"), "item", "valid")


def entity_issues(spark, d):
    """Facts, needs, pains and impacts (lines, by their flag) against the sources that are counted for them."""
    li = _lines(spark, d)
    claim = _pick(["fact", "inference", "assumption", "unknown"], F.col("p"))
    x = li.select("c", "n", "p", "f", claim.alias("claim_type"), (F.col("p") % 3).alias("n_verified_beyond_notes"), (F.col("p") % 4).alias("n_solution_sources"), (F.col("p") % 2).alias("n_verified_customer"), (F.col("p") % 5).alias("n_evidence"), (F.col("l_discount") > 0.055).alias("quantified"), F.when(F.col("p") % 6 == 0, F.lit(1.0)).alias("current_value"), F.lit(None).cast("double").alias("target_value"), F.when(F.col("p") % 7 != 0, F.lit("count")).alias("measurement_needed"))
    found = F.when(F.col("f") == "N", F.concat(validation.fact_issues(), validation.need_issues())).when(F.col("f") == "R", validation.pain_issues()).otherwise(validation.impact_issues())
    y = x.select("f", F.explode(found).alias("issue"))
    return y.groupBy("f", "issue").agg(F.count("*").alias("n"))


def intent_issues(spark, d):
    """Intents of orders with signals made of their lines' numbers."""
    li = _lines(spark, d)
    sig = lambda f: F.array_sort(F.collect_list(F.when(F.col("f") == f, F.concat(F.when(F.col("p") % 9 == 0, F.lit("SOLUTION-")).when(F.col("p") % 3 == 0, F.lit("NOTE-")).when(F.col("p") % 5 == 0, F.lit("MTG-")).otherwise(F.lit("x")), F.col("n").cast("string")))))
    x = li.groupBy("c").agg(sig("N").alias("positive_signals"), sig("R").alias("negative_signals"), sig("A").alias("unknown_factors"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("c"), F.element_at(F.array(*map(F.lit, ["high", "medium_high", "medium", "unknown", "low"])), F.substring("o_orderpriority", 1, 1).cast("int")).alias("intent"), _pick(QUALITIES, F.col("o_custkey")).alias("quality"), F.when(F.col("o_orderkey") % 20 == 0, "see reference").otherwise("fine").alias("summary"))
    return x.join(o, "c").select(F.col("c").alias("case_id"), F.array_join(validation.intent_issues(), ",").alias("issues")).where("issues <> ''")


def stakeholder_issues(spark, d):
    x = _lines(spark, d).where("role is not null").select("role", "confirmed", F.when(F.col("p") % 4 == 0, "  short  ").when(F.col("p") % 4 != 1, "ask them in May").alias("next_validation"), (F.col("p") % 3).alias("n_verified_customer"))
    return x.select("role", F.explode(validation.stakeholder_issues()).alias("issue")).groupBy("role", "issue").agg(F.count("*").alias("n"))


def gap_issues(spark, d):
    x = _lines(spark, d).where("gap is not null").select("gap", "priority", F.when(F.col("p") % 5 == 0, "Follow up ??").when(F.col("p") % 5 == 1, "why ?").otherwise("Which budget is there?").alias("question"), F.when(F.col("p") % 3 == 0, "too little").otherwise("delays the whole project").alias("business_impact"))
    return x.select("gap", F.explode(validation.gap_issues()).alias("issue")).groupBy("gap", "issue").agg(F.count("*").alias("n"))


def gap_set_issues(spark, d):
    x = _facts(spark, d)
    core = F.array(F.lit("business_goal"), F.lit("pain_or_problem"), F.lit("stakeholders"))
    x = x.withColumn("mode", F.when(F.col("quality") == "insufficient", "clarification_only").otherwise("full_analysis")).withColumn("blocking", F.slice(core, 1, F.pmod("c", F.lit(4)).cast("int"))).withColumn("unconfirmed_authority", F.col("n_unconfirmed") > 0).withColumn("n_unknown_factors", F.col("c") % 2).withColumn("n_gaps", F.size("gaps"))
    return x.select(F.col("c").alias("case_id"), F.array_join(validation.gap_set_issues(), ",").alias("issues")).where("issues <> ''")


def opportunity_issues(spark, d):
    x = _lines(spark, d).where("suitability is not null").select("suitability", _pick(QUALITIES, F.col("c")).alias("quality"), (F.col("p") % 3).alias("n_pains"), (F.col("p") % 2).alias("n_unknown_pains"), (F.col("p") % 4).alias("n_prerequisites"), (F.col("p") % 5).alias("n_limitations"))
    return x.select("suitability", F.explode(validation.opportunity_issues()).alias("issue")).groupBy("suitability", "issue").agg(F.count("*").alias("n"))


def recommendation_issues(spark, d):
    """Recommendations (lines) of a case against its catalogue, candidates and opportunities (other lines)."""
    li = _lines(spark, d)
    sol, src = F.concat(F.lit("S"), (F.col("p") % 7).cast("string")), F.concat(F.lit("SOLUTION-"), (F.col("p") % 7).cast("string"))
    recs = li.where("fit_level is not null").groupBy("c", "n").agg(F.max("p").alias("p")).select("c", F.col("n").alias("rec"), sol.alias("solution"), F.when(F.col("p") % 5 != 0, F.when(F.col("p") % 11 == 0, F.lit("SOLUTION-0")).otherwise(src)).alias("ref_source"), F.when(F.col("p") % 5 != 0, F.when(F.col("p") % 13 == 0, "known_constraint").otherwise("solution_library")).alias("ref_type"), F.array(F.col("n") - 1, F.col("n") + 1).alias("related"))
    cat = li.where("k = 0").select("c", sol.alias("solution"), src.alias("source_id"))
    cand = li.where("k <> 2").select("c", sol.alias("solution"), src.alias("source_id"))
    opps = li.where("suitability is not null").select("c", F.col("n").alias("opp"), "suitability")
    x = validation.recommendation_issues(recs, cat, cand, opps, "c")
    return x.select(F.col("c").alias("case_id"), "rec", F.array_join("issues", ",").alias("issues"))


def trace_issues(spark, d):
    """Traces (lines with a gap) of risks (returned lines), naming gaps by their line and opportunities by theirs."""
    li = _lines(spark, d)
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    t = li.where("gap is not null").groupBy("c", "n").agg(F.max("p").alias("p")).select("c", F.col("n").alias("trace"), name("R", F.col("n") % 4).alias("owner"), F.array(F.concat(F.lit(" g"), F.col("n").cast("string")), name("G", F.col("p") % 9)).alias("gaps"), F.array(name("o", F.col("n") + 1)).alias("opportunities"))
    risks = li.where("f = 'R'").select("c", name("R", F.col("n") % 4).alias("id"))
    gaps, opps = li.where("gap is not null").select("c", name("G", F.col("n")).alias("id")), li.where("suitability is not null").select("c", name("O", F.col("n")).alias("id"))
    x = validation.trace_issues(t, risks, {"gaps": gaps, "opportunities": opps}, "c")
    return x.select(F.col("c").alias("case_id"), "trace", F.array_join("issues", ",").alias("issues"))


ACTIONS = ["commercial_proposal", "procurement", "contracting", "clarification", "qualification", "demo"]


def _actions(spark, d):
    x = _lines(spark, d).where("f <> 'N'").select("c", "n", "p", _pick(["P0", "P1", "P2"], F.col("p")).alias("priority"), _pick(ACTIONS, F.col("n")).alias("action_type"), F.when(F.col("p") % 8 == 0, "Follow up").when(F.col("p") % 8 == 1, "call").otherwise("Confirm the budget").alias("action"), _pick(STAGES, F.col("c")).alias("stage"), _pick(["high", "medium", "low", "very_low"], F.col("c")).alias("level"), (F.col("c") % 2 == 0).alias("blocking_gap"), (F.col("c") % 3 == 0).alias("decider_confirmed"), (F.col("p") % 2 == 0).alias("high_gap_linked"), (F.col("p") % 7 == 0).alias("high_risk_linked"), (F.col("p") % 6).alias("n_participants"), (F.col("p") % 10).alias("n_criteria"), F.when(F.col("p") % 4 != 0, "May").alias("timeframe"))
    return x


def action_issues(spark, d):
    x = _actions(spark, d).select("action_type", F.explode(validation.action_issues()).alias("issue"))
    return x.groupBy("action_type", "issue").agg(F.count("*").alias("n"))


def final_checks(spark, d):
    """Report checks of orders: totals that differ, orphan traces and P0 actions without a driver; vague actions only warn."""
    x = _pointed(spark, d)
    total = sum((F.col(n) for n in _DIMS[1:]), F.col(_DIMS[0]))
    bad = x.where(total + F.when(F.col("c") % 50 == 0, 1).otherwise(0) != total).select("c")
    orphan = trace_issues(spark, d).where("issues like 'orphan%'").select(F.col("case_id").alias("c"))
    a = _actions(spark, d).withColumn("i", validation.action_issues())
    p0, vague = a.where(F.array_contains("i", "p0_without_high_gap_or_risk")).select("c"), a.where(F.array_contains("i", "vague")).select("c")
    _, cases = validation.final_checks({"DEAL_SCORE_TOTAL_INVALID": bad, "ORPHAN_RISK_TRACE": orphan, "P0_ACTION_WITHOUT_CRITICAL_DRIVER": p0, "VAGUE_ACTION": vague}, x, "c", warnings=["VAGUE_ACTION"])
    return cases.select(F.col("c").alias("case_id"), "n_blocking", "passed")


def entity_rules(spark, d):
    """Actions of a case (returned lines) with their traces: rules that each case breaks, all cases."""
    li = _lines(spark, d)
    e = li.where("f = 'R'").groupBy("c", "n").agg(F.max("p").alias("p")).select("c", F.col("n").alias("id"), F.concat(F.when(F.col("n") % 2 == 0, " Do  ").otherwise("do "), (F.col("p") % 3).cast("string")).alias("text"), F.col("n").alias("position"), (F.col("p") % 3).alias("priority"))
    t = li.where("f = 'R' and n <> 5").select("c", F.col("n").alias("id")).distinct().unionByName(li.where("n = 7").select("c", F.lit(7).cast("long").alias("id")).distinct())
    return validation.uniqueness(li.select("c").distinct(), e, t, "c").select(F.col("c").alias("case_id"), F.array_join("issues", ",").alias("issues"))


def goals(spark, d):
    """Stated goals of conversations (every fourth has one, with spaces) and those that their texts' words call for."""
    from .registry import GOALS

    stated = F.when(F.col("conv_id") % 4 == 0, F.lit(" ask ")).when(F.col("conv_id") % 4 == 1, F.lit("grow"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(deals.detected_goals(stated, F.col("text"), GOALS), ",").alias("goals"))


def sufficiency_full(spark, d):
    """Context categories of orders, one a fact, need or flag of their lines."""
    li = _lines(spark, d)
    c = _pick(deals.CATEGORIES, F.col("p"))
    x = li.where("n <= 4").groupBy("c").agg(F.collect_set(c).alias("have"))
    missing, blocking, quality = deals.sufficiency(F.col("have"))
    return x.select(F.col("c").alias("case_id"), F.array_join(missing, ",").alias("missing"), F.array_join(blocking, ",").alias("blocking"), quality.alias("quality"))


_NAMES = "deal_dimensions deal_totals deal_limits solution_fit reliability_summary evaluation_flags follow_up_lists company_context known_industry source_index_full fallback_source validate_evidence references_exist entity_issues intent_issues stakeholder_issues gap_issues gap_set_issues opportunity_issues recommendation_issues trace_issues action_issues final_checks entity_rules goals sufficiency_full"
QUERIES = {n: globals()[n] for n in _NAMES.split()}


def _marks(**c: str) -> str:
    return "concat_ws(','," + ", ".join(f" CASE WHEN {v} THEN '{k}' END" for k, v in c.items()) + ")"


def _counted(relation: str, by: str, marks: str) -> str:
    return f"SELECT {by}, issue, count(*) AS n FROM (SELECT {by}, unnest(string_split({marks}, ',')) AS issue FROM {relation}) WHERE issue <> '' GROUP BY ALL"


_ACT = f"{_LINES}, ac AS (SELECT c, n, p, {_pick_sql(['P0', 'P1', 'P2'], 'p')} = 'P0' AS p0, {_pick_sql(ACTIONS, 'n')} AS action_type, CASE p % 8 WHEN 0 THEN 'Follow up' WHEN 1 THEN 'call' ELSE 'Confirm the budget' END AS action, {_pick_sql(STAGES, 'c')} AS stage, {_pick_sql(['high', 'medium', 'low', 'very_low'], 'c')} AS level FROM ln WHERE f <> 'N')"
_ACT_MARKS = _marks(p0_without_high_gap_or_risk="p0 AND p % 2 <> 0 AND p % 7 <> 0", too_early="p0 AND stage IN ('discovery', 'unknown') AND c % 2 = 0 AND action_type IN ('commercial_proposal', 'procurement', 'contracting')", no_confirmed_decider="p0 AND c % 3 <> 0 AND action_type IN ('commercial_proposal', 'procurement', 'contracting')", low_score="p0 AND level IN ('low', 'very_low') AND action_type NOT IN ('clarification', 'qualification', 'stakeholder_alignment', 'technical_validation')", no_participants="p % 6 = 0", no_success_criteria="p % 10 = 0", no_timeframe="p % 4 = 0", text_too_short="length(action) < 8", vague="lower(action) = 'follow up'")
_TRACES = f"{_LINES}, tr AS (SELECT c, n, max(p) AS p FROM ln WHERE gap IS NOT NULL GROUP BY ALL), ti AS (SELECT c AS case_id, n AS trace, concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM ln x WHERE x.c = tr.c AND x.f = 'R' AND x.n % 4 = tr.n % 4) THEN 'orphan' END, CASE WHEN NOT EXISTS (SELECT 1 FROM ln x WHERE x.c = tr.c AND x.gap IS NOT NULL AND x.n = tr.p % 9) THEN 'unknown_gaps' END, CASE WHEN NOT EXISTS (SELECT 1 FROM ln x WHERE x.c = tr.c AND x.suitability IS NOT NULL AND x.n = tr.n + 1) THEN 'unknown_opportunities' END) AS issues FROM tr)"
_SIG = "CASE WHEN p % 9 = 0 THEN 'SOLUTION-' WHEN p % 3 = 0 THEN 'NOTE-' WHEN p % 5 = 0 THEN 'MTG-' ELSE 'x' END"
_LIM = ", ".join(f"CASE WHEN {n} < {w * 0.6} THEN '{n}{deals.LOW_DIMENSION}' END" for n, w in deals.WEIGHTS.items())


def _first(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


ORACLE = {
    "deal_dimensions": f"WITH {_FACTS} SELECT c AS case_id, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in _DIMS)} FROM tt",
    "deal_totals": f"WITH {_FACTS} SELECT c AS case_id, CAST(total AS BIGINT) AS total, CASE WHEN total >= 80 THEN 'high' WHEN total >= 65 THEN 'medium_high' WHEN total >= 45 THEN 'medium' WHEN total >= 25 THEN 'low' ELSE 'very_low' END AS level, CASE WHEN quality = 'sufficient' AND n_high_gaps <= 1 THEN 'high' WHEN quality <> 'insufficient' THEN 'medium' ELSE 'low' END AS confidence FROM tt",
    "deal_limits": f"""WITH {_FACTS}, li AS (SELECT *, list_concat(list_filter([{_LIM}], lambda x: x IS NOT NULL), list_transform(list_filter(g, lambda y: y.priority = 'high'), lambda y: y.gap || '{deals.GAP}' || y.d), list_filter([CASE WHEN n_candidates = 0 THEN '{deals.NO_CANDIDATE}' END, CASE WHEN NOT list_has_any(roles, ['decision_maker', 'budget_owner']) THEN '{deals.NO_DECIDER}' END, CASE WHEN list_contains(gaps, 'budget') THEN '{deals.BUDGET_GAP}' END], lambda x: x IS NOT NULL)) AS lim,
        list_concat(list_filter(list_transform(gaps, lambda y: CASE y {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in deals.CONDITIONS.items())} END), lambda x: x IS NOT NULL), list_filter([CASE WHEN n_candidates = 0 THEN '{deals.NO_CANDIDATE_CONDITION}' END, CASE WHEN NOT list_has_any(roles, ['decision_maker', 'budget_owner']) THEN '{deals.NO_DECIDER_CONDITION}' END], lambda x: x IS NOT NULL)) AS con FROM tt)
        SELECT c AS case_id, array_to_string({_first('lim')}, ';') AS limiters, array_to_string({_first('con')}, ';') AS conditions, concat_ws(',', {', '.join(f"CASE WHEN {n} = greatest({', '.join(_DIMS)}) THEN '{n}' END" for n in _DIMS)}) AS strongest, concat_ws(',', {', '.join(f"CASE WHEN {n} = least({', '.join(_DIMS)}) THEN '{n}' END" for n in _DIMS)}) AS weakest FROM li""",
    "solution_fit": f"WITH {_FIT} SELECT c AS case_id, CAST(fit AS BIGINT) AS fit FROM fit",
    "reliability_summary": f"WITH {_FACTS} SELECT c AS case_id, CASE WHEN quality = 'sufficient' AND n_high_gaps <= 1 THEN 'high' WHEN quality = 'insufficient' OR n_critical_gaps > 0 OR n_unconfirmed >= 2 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN n_recommendations = 0 THEN 0 ELSE round(least(n_recommendations, n_candidates) / n_recommendations, 6) END AS grounded_rate, n_needs + n_impacts AS n_facts, n_pains AS n_inferences, CAST(n_critical_gaps AS BIGINT) AS n_critical_gaps FROM tt",
    "evaluation_flags": f"WITH {_FACTS} SELECT c AS case_id, unnest(list_filter(['human_review_required:medium', CASE WHEN c % 9 = 0 OR list_contains(gaps, 'budget') THEN 'unknown_budget:high' END, CASE WHEN unconfirmed_decider OR list_contains(gaps, 'authority') THEN 'unknown_decision_maker:high' END, CASE WHEN list_contains(gaps, 'timeline') THEN 'unknown_timeline:medium' END, CASE WHEN quality <> 'sufficient' THEN 'low_context_quality:medium' END, CASE WHEN n_recommendations = 0 THEN 'solution_without_knowledge_reference:medium' END, CASE WHEN high_risk THEN 'human_review_required:high' END], lambda x: x IS NOT NULL)) AS flag FROM tt",
    "follow_up_lists": f"WITH {_LINES}, e AS (SELECT c, 0 AS o, n, p, 'ask ' || gap AS t FROM ln WHERE gap IS NOT NULL UNION ALL SELECT c, 1, n, p, 'act on ' || (p % 4) FROM ln WHERE f = 'R'), r AS (SELECT *, row_number() OVER (PARTITION BY c, o ORDER BY n * 1000000 + p, t) AS i FROM e), g AS (SELECT c, list(t ORDER BY o, i) AS a FROM r WHERE (o = 0 AND i <= 3) OR (o = 1 AND i <= 2) GROUP BY c) SELECT c AS case_id, array_to_string({_first('a')}, ';') AS agenda FROM g",
    "company_context": "SELECT o_orderkey, c_mktsegment, c_nationkey, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey",
    "known_industry": "SELECT c_custkey, CASE WHEN lower(i) IN (SELECT lower(p_type) FROM part) THEN i END AS industry FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Economy' ELSE c_mktsegment END AS i FROM customer)",
    "source_index_full": f"WITH {_SRC} SELECT c AS case_id, CAST(place AS BIGINT) AS place, CAST(position AS BIGINT) AS position, source_id, source_type, verified FROM si",
    "fallback_source": f"WITH {_SRC} SELECT c AS case_id, arg_min(source_id, row(CASE WHEN source_type = 'customer_profile' THEN 1 ELSE 2 END, place, position)) AS fallback FROM si WHERE source_type <> 'meeting_transcript' AND (c % 3 <> 0 OR source_type <> 'customer_profile') AND verified GROUP BY c",
    "validate_evidence": f"WITH {_REFS}, w AS (SELECT c, item, position, CASE WHEN kt IS NULL THEN 'unknown_source' WHEN kt <> st THEN 'type_mismatch' WHEN kt = 'solution_library' THEN 'forbidden_type' END AS wrong, verified AND kt IN ('customer_profile', 'meeting_transcript', 'salesperson_note') AS good FROM rv) SELECT c AS case_id, item, concat_ws(',', string_agg(wrong || ':' || position, ',' ORDER BY position), CASE WHEN NOT coalesce(bool_or(wrong IS NULL AND good), false) THEN 'no_verified_support' END) AS issues FROM w GROUP BY ALL",
    "references_exist": f"WITH {_REFS} SELECT c AS case_id, item, bool_and(coalesce(kt = st, false)) AS valid FROM rv GROUP BY ALL",
    "entity_issues": f"WITH {_LINES}, x AS (SELECT f, {_pick_sql(['fact', 'inference', 'assumption', 'unknown'], 'p')} AS ct, p, l_discount > 0.055 AS qn FROM ln), y AS (SELECT f, CASE f WHEN 'N' THEN {_marks(fact_without_verified_source=chr(99) + 't = ' + repr('fact') + ' AND p % 3 = 0', solution_library_source='p % 4 > 0', no_verified_customer_source='p % 2 = 0')} WHEN 'R' THEN {_marks(pain_is_no_inference='ct NOT IN (' + repr('inference') + ', ' + repr('assumption') + ')', no_evidence='p % 5 = 0')} ELSE {_marks(unknown_claim='ct = ' + repr('unknown'), quantified_without_value='qn AND p % 6 <> 0', no_measurement='NOT qn AND p % 6 <> 0 AND p % 7 = 0')} END AS m FROM x) SELECT f, issue, count(*) AS n FROM (SELECT f, unnest(string_split(m, ',')) AS issue FROM y) WHERE issue <> '' GROUP BY ALL",
    "intent_issues": f"""WITH {_LINES}, g AS (SELECT c, coalesce(string_agg({_SIG} || n, ' ') FILTER (f = 'N'), '') AS ps, count(*) FILTER (f = 'N') AS np, string_agg({_SIG} || n, ' ') AS al FROM ln GROUP BY c), x AS (SELECT c, ps, np, CASE WHEN c % 20 = 0 THEN al || ' see reference' ELSE al || ' fine' END AS ev, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium_high' ELSE 'other' END AS it, {_pick_sql(QUALITIES, 'o_custkey')} AS ql FROM g JOIN orders ON o_orderkey = c),
        y AS (SELECT c AS case_id, concat_ws(',', CASE WHEN ql = 'insufficient' THEN 'insufficient_context' END, CASE WHEN ql = 'partially_sufficient' AND it = 'high' THEN 'high_intent_on_partial_context' END, CASE WHEN it <> 'other' AND np = 0 THEN 'no_positive_signal' END, CASE WHEN contains(ev, 'SOLUTION-') THEN 'mentions_solution' END, CASE WHEN contains(upper(ev), 'REFERENCE') THEN 'mentions_reference' END, CASE WHEN it <> 'other' AND contains(ps, 'NOTE-') AND NOT contains(ev, 'MTG-') THEN 'notes_alone' END) AS issues FROM x) SELECT * FROM y WHERE issues <> ''""",
    "stakeholder_issues": f"WITH {_LINES} SELECT role, issue, count(*) AS n FROM (SELECT role, unnest(string_split(concat_ws(',', CASE WHEN NOT confirmed AND p % 4 < 2 THEN 'no_next_step' END, CASE WHEN confirmed AND role IN ('champion', 'decision_maker', 'budget_owner', 'business_owner') AND p % 3 = 0 THEN 'key_role_without_customer_evidence' END), ',')) AS issue FROM ln WHERE role IS NOT NULL) WHERE issue <> '' GROUP BY ALL",
    "gap_issues": f"WITH {_LINES} SELECT gap, issue, count(*) AS n FROM (SELECT gap, unnest(string_split(concat_ws(',', CASE WHEN p % 5 = 1 THEN 'question_too_short' END, CASE WHEN p % 5 = 0 THEN 'question_vague' END, CASE WHEN priority IN ('high', 'critical') AND p % 3 = 0 THEN 'impact_not_explained' END), ',')) AS issue FROM ln WHERE gap IS NOT NULL) WHERE issue <> '' GROUP BY ALL",
    "gap_set_issues": f"WITH {_FACTS}, x AS (SELECT c AS case_id, concat_ws(',', CASE WHEN quality = 'insufficient' AND c % 4 > 0 AND NOT list_has_any(gaps, CASE c % 4 WHEN 1 THEN ['business_goal'] WHEN 2 THEN ['business_goal', 'current_metrics'] ELSE ['business_goal', 'current_metrics', 'authority', 'decision_process'] END) THEN 'blocking_gap_not_covered' END, CASE WHEN n_unconfirmed > 0 AND NOT list_has_any(gaps, ['authority', 'decision_process']) THEN 'authority_gap_missing' END, CASE WHEN c % 2 = 1 AND len(gaps) = 0 THEN 'unknown_factors_without_gap' END) AS issues FROM tt) SELECT * FROM x WHERE issues <> ''",
    "opportunity_issues": f"WITH {_LINES} SELECT suitability, issue, count(*) AS n FROM (SELECT suitability, unnest(string_split(concat_ws(',', CASE WHEN p % 3 = 0 THEN 'no_related_pain' END, CASE WHEN p % 2 = 1 THEN 'unknown_pain' END, CASE WHEN {_pick_sql(QUALITIES, 'c')} = 'partially_sufficient' AND suitability = 'suitable_now' THEN 'suitable_now_on_partial_context' END, CASE WHEN suitability = 'suitable_after_prerequisites' AND p % 4 = 0 THEN 'prerequisites_missing' END, CASE WHEN suitability IN ('not_recommended_now', 'not_suitable_for_ai', 'insufficient_information') AND p % 5 = 0 THEN 'limitations_missing' END), ',')) AS issue FROM ln WHERE suitability IS NOT NULL) WHERE issue <> '' GROUP BY ALL",
    "recommendation_issues": f"""WITH {_LINES}, r AS (SELECT c, n, max(p) AS p FROM ln WHERE fit_level IS NOT NULL GROUP BY ALL), ca AS (SELECT DISTINCT c, p % 7 AS s FROM ln WHERE k = 0), cd AS (SELECT DISTINCT c, p % 7 AS s FROM ln WHERE k <> 2), op AS (SELECT c, n, bool_or(suitability IN ('suitable_now', 'suitable_for_poc', 'suitable_after_prerequisites')) AS fits FROM ln WHERE suitability IS NOT NULL GROUP BY ALL),
        lk AS (SELECT r.c, r.n, 2 - count(op.n) AS unk, count(op.n) AS kn, bool_or(op.fits) AS fits FROM r LEFT JOIN op ON op.c = r.c AND (op.n = r.n - 1 OR op.n = r.n + 1) GROUP BY ALL), x AS (SELECT r.*, lk.unk, lk.kn, lk.fits, ca.s IS NOT NULL AS own, cd.s IS NOT NULL AS found, CASE WHEN r.p % 5 <> 0 THEN CASE WHEN r.p % 11 = 0 THEN 0 ELSE r.p % 7 END END AS src, r.p % 5 <> 0 AND r.p % 13 <> 0 AS lib FROM r JOIN lk USING (c, n) LEFT JOIN ca ON ca.c = r.c AND ca.s = r.p % 7 LEFT JOIN cd ON cd.c = r.c AND cd.s = r.p % 7)
        SELECT c AS case_id, n AS rec, concat_ws(',', CASE WHEN unk > 0 THEN 'unknown_opportunity' END, CASE WHEN NOT own THEN 'solution_not_in_catalogue' END, CASE WHEN src IS NULL THEN 'no_reference' END, CASE WHEN src IS NOT NULL AND NOT lib THEN 'reference_type' END, CASE WHEN lib AND own AND src <> p % 7 THEN 'reference_of_other_solution' END, CASE WHEN kn > 0 AND NOT fits THEN 'no_suitable_opportunity' END, CASE WHEN NOT found THEN 'solution_not_retrieved' END, CASE WHEN found AND NOT (lib AND src = p % 7) THEN 'candidate_source_not_referenced' END) AS issues FROM x""",
    "trace_issues": f"WITH {_TRACES} SELECT * FROM ti",
    "action_issues": f"WITH {_ACT} " + _counted("ac", "action_type", _ACT_MARKS),
    "final_checks": f"WITH {_TRACES}, " + _ACT.replace(_LINES + ", ", "") + f", b AS (SELECT c, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 50 = 0) GROUP BY 1 UNION ALL SELECT case_id, count(*) FROM ti WHERE issues LIKE 'orphan%' GROUP BY 1 UNION ALL SELECT c, count(*) FROM ac WHERE list_contains(string_split({_ACT_MARKS}, ','), 'p0_without_high_gap_or_risk') GROUP BY 1), s AS (SELECT c, sum(n) AS n FROM b GROUP BY 1), k AS (SELECT DISTINCT l_orderkey AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT c AS case_id, CAST(coalesce(n, 0) AS BIGINT) AS n_blocking, coalesce(n, 0) = 0 AS passed FROM k LEFT JOIN s USING (c)",
    "entity_rules": f"""WITH {_LINES}, en AS (SELECT c, n, max(p) AS p FROM ln WHERE f = 'R' GROUP BY ALL), fl AS (SELECT c, bool_or(pr > p % 3) AS falls FROM (SELECT *, lag(p % 3) OVER (PARTITION BY c ORDER BY n) AS pr FROM en) GROUP BY c), g AS (SELECT c, count(*) AS n, count(DISTINCT p % 3) AS texts, bool_or(n = 5) AS five, bool_or(n = 7) AS seven FROM en GROUP BY c), k AS (SELECT c, bool_or(n = 7) AS any7 FROM ln GROUP BY c)
        SELECT k.c AS case_id, concat_ws(',', CASE WHEN g.n IS NULL THEN 'no_rows' END, CASE WHEN g.texts < g.n THEN 'repeated_text' END, CASE WHEN coalesce(five, false) OR any7 THEN 'trace_mismatch' END, CASE WHEN falls THEN 'not_by_priority' END) AS issues FROM k LEFT JOIN g USING (c) LEFT JOIN fl USING (c)""",
    "goals": "WITH g AS (SELECT conv_id, turn, list_filter([CASE conv_id % 4 WHEN 0 THEN 'ask' WHEN 1 THEN 'grow' END, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'how|what|why') THEN 'ask' END, CASE WHEN regexp_matches(lower(coalesce(text, '')), '[0-9]') THEN 'number' END, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'write|summar|explain') THEN 'write' END], lambda x: x IS NOT NULL) AS a FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS goals FROM g",
    "sufficiency_full": f"WITH {_LINES}, x AS (SELECT c, list(DISTINCT {_pick_sql(deals.CATEGORIES, 'p')}) AS h FROM ln WHERE n <= 4 GROUP BY c), y AS (SELECT c, h, list_filter({deals.CATEGORIES}, lambda k: NOT list_contains(h, k)) AS m, list_filter({deals.CORE}, lambda k: NOT list_contains(h, k)) AS b FROM x) SELECT c AS case_id, array_to_string(list_sort(m), ',') AS missing, array_to_string(list_sort(b), ',') AS blocking, CASE WHEN len(b) = 0 AND len(h) >= 6 THEN 'sufficient' WHEN len(b) <= 1 OR len(h) >= 4 THEN 'partially_sufficient' ELSE 'insufficient' END AS quality FROM y",
}
