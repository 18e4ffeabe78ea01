"""Queries of run logs, responses and reviews, with the SQL that states the same.

Events are runs: the type is the node, the user's remainder names the model, value is latency, props.k the tokens in thousands."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import checks, metrics, responses, runs
from ..shared import durable, fresh_path
from . import retrieval, roles
from .roles import table as _t

ALWAYS = {"json_ok": "json_parse_failure", "schema_ok": "schema_validation_failure"}
BY_NODE = {"evidence_ok": (["click", "view"], "evidence_reference_failure"), "boundary_ok": (["signup"], "candidate_boundary_failure"), "rule_ok": (["error"], "business_rule_failure")}
PRICES = [("m0", "0.3", "1.2"), ("m1", "1", "2.5")]


def _runs(spark, d):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    i, u = F.col("event_id"), F.col("user_id")
    m, n = u % 3, F.col("event_type")
    r = e.select(
        i.alias("run"), "ts", n.alias("node"), F.concat(F.lit("m"), m.cast("string")).alias("model"), F.when(i % 37 != 0, F.col("value")).alias("latency"), F.when(i % 31 != 0, k).alias("tokens"), (k * 1000).cast("decimal(18,0)").alias("prompt_tokens"), (k * 100).cast("decimal(18,0)").alias("completion_tokens"),
        (~((m == 0) & (k >= 97))).alias("json_ok"), F.when(i % 101 != 5, ~((m == 1) & (n == "error") & (k >= 90))).alias("schema_ok"), (u % 9 != 4).alias("rule_ok"), (~((n == "click") & (u % 7 == 1))).alias("evidence_ok"), F.when(i % 11 != 0, u % 5 != 2).alias("boundary_ok"),
        F.when((m == 2) & (n == "view") & (i % 40 == 3), "timeout").when((m == 2) & (i % 55 == 0) & (n == "purchase"), "invalid_json").alias("error_type"), ((i % 97 == 0) & (m == 1)).cast("long").alias("n_blocking"), F.when(i % 13 == 0, F.concat(F.lit(" broken  at\n"), i.cast("string"))).alias("error_message"),
    )
    ok = F.col("json_ok") & F.coalesce("schema_ok", F.lit(False)) & F.col("rule_ok") & (F.col("n_blocking") == 0)
    r = r.withColumn("status", F.when(F.col("error_type").isNotNull(), "request_error").when(ok, "passed").otherwise("failed"))
    prices = spark.createDataFrame(PRICES, "model string, input_price string, output_price string").select("model", F.col("input_price").cast("decimal(9,3)").alias("input_price"), F.col("output_price").cast("decimal(9,3)").alias("output_price"))
    return runs.priced(r, prices).withColumn("cost", F.col("cost").cast("double"))


_R = """e AS (SELECT event_id AS i, user_id AS u, user_id % 3 AS m, event_type AS n, ts, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
    r0 AS (SELECT i AS run, i, u, ts, n AS node, 'm' || m AS model, CASE WHEN i % 37 <> 0 THEN value END AS latency, CASE WHEN i % 31 <> 0 THEN k END AS tokens, NOT (m = 0 AND k >= 97) AS json_ok, CASE WHEN i % 101 <> 5 THEN NOT (m = 1 AND n = 'error' AND k >= 90) END AS schema_ok, u % 9 <> 4 AS rule_ok, NOT (n = 'click' AND u % 7 = 1) AS evidence_ok, CASE WHEN i % 11 <> 0 THEN u % 5 <> 2 END AS boundary_ok,
        CASE WHEN m = 2 AND n = 'view' AND i % 40 = 3 THEN 'timeout' WHEN m = 2 AND i % 55 = 0 AND n = 'purchase' THEN 'invalid_json' END AS error_type, CAST(i % 97 = 0 AND m = 1 AS BIGINT) AS n_blocking, CASE WHEN i % 13 = 0 THEN 'broken at ' || i END AS error_message,
        CASE m WHEN 0 THEN round_even(CAST((k * 1000 * 0.3 + k * 100 * 1.2) / 1000000 AS DOUBLE), 6) WHEN 1 THEN round_even(CAST((k * 1000 * 1 + k * 100 * 2.5) / 1000000 AS DOUBLE), 6) END AS cost FROM e),
    r AS (SELECT *, CASE WHEN error_type IS NOT NULL THEN 'request_error' WHEN json_ok AND coalesce(schema_ok, false) AND rule_ok AND n_blocking = 0 THEN 'passed' ELSE 'failed' END AS status FROM r0)"""
_S = _R + """, s AS (SELECT node, model, count(*) AS n_runs, count(*) FILTER (status = 'passed') AS n_passed, count(error_type) AS n_errors, count(*) FILTER (n_blocking > 0) AS n_blocked, round(avg(json_ok::INT), 6) AS json_ok_rate, round(avg(coalesce(schema_ok, false)::INT), 6) AS schema_ok_rate, round(avg(evidence_ok::INT), 6) AS evidence_ok_rate, round(avg(coalesce(boundary_ok, false)::INT), 6) AS boundary_ok_rate, round(avg(rule_ok::INT), 6) AS rule_ok_rate,
        round(avg(latency), 3) AS mean_latency, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, concat_ws(',', CASE WHEN count(error_type) > 0 THEN 'request_error' END, CASE WHEN NOT bool_and(json_ok) THEN 'json_parse_failure' END, CASE WHEN NOT bool_and(coalesce(schema_ok, false)) THEN 'schema_validation_failure' END, CASE WHEN count(*) FILTER (n_blocking > 0) > 0 THEN 'blocking_assertion_failure' END,
        CASE WHEN node IN ('click', 'view') AND NOT bool_and(evidence_ok) THEN 'evidence_reference_failure' END, CASE WHEN node = 'signup' AND NOT bool_and(coalesce(boundary_ok, false)) THEN 'candidate_boundary_failure' END, CASE WHEN node = 'error' AND NOT bool_and(rule_ok) THEN 'business_rule_failure' END) AS reasons FROM r GROUP BY node, model)"""


def request_cost(spark, d):
    return _runs(spark, d).groupBy("model").agg(F.count("cost").alias("n_priced"), F.count("*").alias("n_runs"), F.round(F.sum("cost"), 4).alias("cost"))


def _gated(spark, d):
    return runs.node_model_summary(_runs(spark, d), ALWAYS, BY_NODE)


def node_model_gates(spark, d):
    s = _gated(spark, d)
    return s.select(*[F.array_join(c, ",").alias(c) if c == "reasons" else F.col(c) for c in s.columns])


def routing_table_gated(spark, d):
    """As if only models with a request error were unfit."""
    s = _gated(spark, d).withColumn("eligible", ~F.array_contains("reasons", "request_error"))
    return runs.routing_table(s, 10).withColumn("disqualified", F.array_join("disqualified", ","))


def budget_with_unknown_costs(spark, d):
    """A budget of 20 a node, or ten runs of unknown cost, whichever comes first; hours are summed before rows are."""
    kept = runs.budget_cutoff(_runs(spark, d), ["node"], ["ts", "run"], 20.0, max_unknown=400, bucket=F.date_trunc("hour", "ts"))
    return kept.groupBy("node").agg(F.count("*").alias("n_run"), F.count_if(F.col("cost").isNull()).alias("n_unknown"), F.max("run").alias("last_run"))


def pilot_totals(spark, d):
    return runs.pilot_rollup(_runs(spark, d))


def _assertions(spark, d):
    r = _runs(spark, d)
    x = F.array(*[F.struct(F.lit(a).alias("assertion"), F.lit(t).alias("type"), p.alias("passed"), F.lit(b).alias("blocking")) for a, t, p, b in (("a1", "schema", F.col("schema_ok"), True), ("a2", "rule", F.col("rule_ok"), False), ("a3", "boundary", F.col("boundary_ok"), True))])
    return r.select("run", F.explode(x).alias("x")).select("run", "x.*")


def _records(spark, d):
    return runs.failure_records(_runs(spark, d), _assertions(spark, d), "run")


def failure_summaries(spark, d):
    return _records(spark, d).withColumn("types", F.array_join("types", ","))


def failure_taxonomy(spark, d):
    return runs.failure_counts(_records(spark, d), _runs(spark, d).select("run", "json_ok", "schema_ok", "rule_ok", "evidence_ok", "boundary_ok"))


def evaluate_assertions(spark, d):
    """Each event's props as output: a flag, a value at a path, and forbidden words."""
    e = _t(spark, d, "events").select("event_id", "event_type", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.lit("secret").alias("name"))).alias("items"))).alias("output"), (F.col("value") < 300).alias("flag"))
    k = F.array(F.struct(F.lit("flag").alias("type"), F.lit("request").alias("location"), F.lit("true").alias("expected")), F.struct(F.lit("value_equals").alias("type"), F.lit("items[0].name").alias("location"), F.lit("click").alias("expected")), F.struct(F.lit("value_equals").alias("type"), F.lit("items.1.name").alias("location"), F.lit("secret").alias("expected")), F.struct(F.lit("value_equals").alias("type"), F.lit("k").alias("location"), F.lit("7").alias("expected")), F.struct(F.lit("forbidden_absent").alias("type"), F.lit("output").alias("location"), F.lit(None).cast("string").alias("expected")), F.struct(F.lit("forbidden_absent").alias("type"), F.lit("items[0]").alias("location"), F.lit(None).cast("string").alias("expected")))
    got = runs.evaluate_assertions(e.select("*", F.explode(k).alias("x")).select("event_id", "event_type", "output", "flag", "x.*"), ["api_key", "secret"])
    return got.groupBy("type", "location").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"))


def run_summary(spark, d):
    """Events as run folders: architecture by the user, error files by the id."""
    e = _t(spark, d, "events")
    i = F.col("event_id")
    r = e.select(i.alias("run"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int")).alias("architecture"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.when(i % 29 == 0, "invalid_json").when(F.col("event_type") == "error", "timeout").alias("error_type"), (i % 3 != 0).alias("has_report"), F.when(i % 5 == 0, "Invalid JSON in answer").alias("detail"))
    p, v = e.where("event_id % 23 = 0").select(i.alias("run")), e.where("event_id % 19 = 0").select(i.alias("run"), (i % 4).alias("n_errors"))
    got = runs.run_summary(r, p, v, "run")
    return got.groupBy("architecture", "json_success", "schema_success").agg(F.count("*").alias("n_runs"), F.sum("n_validation_errors").alias("n_errors"))


def _run_files(spark, d):
    """(run, name, value) of the files of run folders, a supplier a run: some without metadata, some with files that cannot be read."""
    i = F.col("s_suppkey")
    arch = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (i % 3 + 1).cast("int"))
    status = F.when(i % 5 == 0, "failed").otherwise("success")
    meta = F.when(i % 13 == 0, "{broken").otherwise(F.to_json(F.struct(i.cast("string").alias("run_id"), arch.alias("architecture"), status.alias("status"), F.when(i % 10 == 0, "invalid_json").alias("error_type"), F.when(i % 15 == 5, "answer is Invalid JSON").alias("error"), F.struct((i * 10).alias("prompt_tokens"), (i * 12).alias("total_tokens")).alias("usage"))))
    files = [("run_metadata.json", F.when(i % 17 != 0, meta)), ("json_parse_error.json", F.when(i % 7 == 0, F.when(i % 14 == 0, "oops").otherwise('{"line": 1}'))), ("validation_error.json", F.when(i % 4 == 0, F.when(i % 8 == 0, '{"errors": [1, 2]}').otherwise('{"n_errors": 5}'))), ("parsed_report.json", F.when(i % 5 != 0, "{}"))]
    each = _t(spark, d, "supplier").select(i.alias("run"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in files])).alias("f"))
    return each.select("run", "f.*").where("value is not null")


def _folders(spark, d):
    path = fresh_path(spark, "runs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources.write_folders(_run_files(spark, d).withColumnRenamed("run", "folder").repartition(parts, "folder"), path)
    return durable(sources.read_folders(spark, path, runs.RUN_FILES), "folders")  # a summary asks for the files three times


def run_folders(spark, d):
    """Runs read back from their folders."""
    told, _ = runs.runs_of_folders(_folders(spark, d))
    return told.select("run", "architecture", "status", "error_type", "prompt_tokens", "total_tokens", "json_success", "schema_success", "n_validation_errors")


def run_warnings(spark, d):
    return runs.runs_of_folders(_folders(spark, d))[1]


def _responses(spark, d):
    """Conversations as responses: the first assistant turn is the proposed text, user turns the pains, the rest by the number."""
    t = _t(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("s"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("q"), F.count_if(F.col("role") == "user").alias("u"))
    i = F.col("conv_id")
    base = F.coalesce("s", F.lit(""))
    x = t.select(
        "conv_id", F.concat(F.lit("p"), (i % 3).cast("string")).alias("provider"), "q", F.when(i % 11 == 0, F.concat(base, F.lit(" ROI: 30%"))).when(i % 7 == 0, F.concat(F.lit("保证 "), base)).when(i % 5 == 0, F.concat(base, F.lit(" Note 4 shadow"))).otherwise(base).alias("solution"),
        (10 - i % 3).alias("n_present"), F.lit(10).alias("n_required"), (i % 3 == 0).alias("valid"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("required_sections"), F.when(i % 4 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("filled"),
        F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Note 4"), F.lit("x"))).alias("evidence_titles"), F.when(i % 2 == 0, 2).otherwise(1).alias("debug_count"), (i % 5 < 2).alias("shadow"), (i % 6 == 0).alias("fallback"), (i % 12 == 0).alias("confirmation"), F.when(i % 6 == 0, F.array(F.lit("no_evidence_found"))).otherwise(F.array().cast("array<string>")).alias("fallback_reasons"),
        (i % 3 == 0).alias("expected_fallback"), F.array(F.lit("la le")).alias("forbidden_claims"), F.array_repeat(F.lit("pain"), F.col("u").cast("int")).alias("pains"), F.when(i % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("opp"))).alias("opportunities"), F.lit("").alias("note"), F.lit("sum").alias("summary"),
    )
    return x


_W = """t AS (SELECT conv_id AS i, arg_min(text, turn) FILTER (role = 'assistant') AS s, arg_min(text, turn) FILTER (role = 'user') AS q, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1), b AS (SELECT *, coalesce(s, '') AS base FROM t),
    w AS (SELECT i, 'p' || (i % 3) AS provider, q, u, CASE WHEN i % 11 = 0 THEN base || ' ROI: 30%' WHEN i % 7 = 0 THEN '保证 ' || base WHEN i % 5 = 0 THEN base || ' Note 4 shadow' ELSE base END AS sol FROM b),
    sc AS (SELECT i AS conv_id, provider, i % 3 = 0 AS valid, CASE WHEN i % 3 = 0 THEN 20 ELSE CAST(round_even(20 * (10 - i % 3) / 10, 0) AS BIGINT) END AS schema_validity, CASE WHEN i % 4 = 0 THEN 5 ELSE 15 END AS section_completeness, CASE WHEN i % 6 = 0 THEN 20 ELSE CASE WHEN contains(sol, 'Note 4') OR contains(sol, 'x') THEN 10 ELSE 0 END + CASE WHEN i % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN i % 5 >= 2 OR NOT contains(lower(sol), 'shadow') THEN 5 ELSE 0 END END AS evidence_grounding,
        CASE WHEN i % 11 = 0 OR contains(lower(sol), 'la le') OR regexp_matches(sol, '(?i)(保证|确保|100%|一定会|必然)') OR regexp_matches(sol, '(?i)(roi|回报|收益|提升)\\s*[:：]?\\s*\\d+%?') THEN 0 ELSE 20 END AS hallucination_risk, CASE WHEN i % 3 = 0 THEN CASE WHEN i % 6 = 0 THEN 12 ELSE 0 END + CASE WHEN i % 12 = 0 THEN 3 ELSE 0 END ELSE CASE WHEN i % 6 = 0 THEN 0 ELSE 15 END END AS fallback_alignment,
        CASE WHEN regexp_matches(sol, '[一-鿿]') THEN 3 ELSE 0 END + CASE WHEN u > 0 AND i % 10 <> 0 THEN 4 ELSE 0 END + CASE WHEN length(sol) BETWEEN 20 AND 240 THEN 2 ELSE 0 END + CASE WHEN len(regexp_extract_all(sol, '(赋能|抓手|闭环|全链路)')) <= 2 THEN 1 ELSE 0 END AS business_clarity FROM w),
    sr AS (SELECT *, schema_validity + section_completeness + evidence_grounding + hallucination_risk + fallback_alignment + business_clarity AS overall FROM sc)"""


def _scored(spark, d):
    return _responses(spark, d).withColumns(responses.response_scores())


def response_scores(spark, d):
    return _scored(spark, d).select("conv_id", *responses.response_scores())


def score_averages(spark, d):
    dims = list(responses.response_scores())
    return responses.score_averages(_scored(spark, d), "provider", dims)


def problem_cases(spark, d):
    return responses.problem_cases(_scored(spark, d), "provider", "conv_id")


def recommend_provider(spark, d):
    """Providers of the responses, of which the last failed, and a house provider that did not run."""
    s = responses.score_averages(_scored(spark, d), "provider", ["overall"])
    p = s.select("provider", F.substring("provider", 2, 1).cast("int").alias("place"), F.lit(True).alias("ran"), F.when(F.col("provider") == "p2", "failed").otherwise("completed_with_case_errors").alias("status"), F.col("overall").alias("score"))
    return runs.recommend_provider(p)


def _annotations(spark, d):
    """Parts as annotations: scores by the key, some of them missing or out of range."""
    k = F.col("p_partkey")
    p = _t(spark, d, "part").where("p_partkey % 2 = 0")
    cols = {c: F.when(k % 10 < 8, (k * (j + 3)) % 5 + 1).cast("int") for j, c in enumerate(responses.HUMAN_SCORES)}
    x = p.select(k.alias("case_id"), F.when(k % 10 < 8, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("reviewer_id"), F.when((k % 10 < 8) | (k % 90 == 8), "2024").alias("reviewed_at"), *[c.alias(n) for n, c in cols.items()], (p["p_size"] % 2).alias("g"))
    x = x.withColumn("business_relevance_score", F.when(k_is(x, 22), F.lit(9)).when(k_is(x, 26), F.lit(None).cast("int")).otherwise(F.col("business_relevance_score")))
    return x.withColumn("overall_human_score", F.when(F.col("case_id") % 10 < 8, F.when(F.col("case_id") % 34 == 0, F.lit(1.5)).otherwise(responses.overall_human()))).withColumn("pass_fail", F.when(F.col("case_id") % 30 == 28, "pass").when(F.col("case_id") % 10 < 8, F.when(F.col("case_id") % 4 == 0, "pass").otherwise("fail")))


def k_is(df, n):
    return df["case_id"] % n == 0


_H = "an0 AS (SELECT p_partkey AS k, p_size % 2 AS g, " + ", ".join(f"CASE WHEN p_partkey % 10 < 8 THEN CAST((p_partkey * {j + 3}) % 5 + 1 AS INT) END AS s{j}" for j in range(6)) + """ FROM part WHERE p_partkey % 2 = 0),
    an1 AS (SELECT * REPLACE (CASE WHEN k % 22 = 0 THEN 9 WHEN k % 26 = 0 THEN NULL ELSE s0 END AS s0) FROM an0), an2 AS (SELECT *, round((s0 + s1 + s2 + s3 + s4 + s5) / CAST(6 AS DOUBLE) * 20, 2) AS mean, CASE WHEN k % 10 < 8 THEN 'r' || (k % 3) END AS reviewer, (k % 10 < 8 OR k % 90 = 8) AS at_, (s0 IS NOT NULL)::INT + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT AS n FROM an1),
    an AS (SELECT *, CASE WHEN k % 10 < 8 THEN CASE WHEN k % 34 = 0 THEN 1.5 ELSE mean END END AS own, CASE WHEN k % 30 = 28 THEN 'pass' WHEN k % 10 < 8 THEN CASE WHEN k % 4 = 0 THEN 'pass' ELSE 'fail' END END AS pf FROM an2)"""


def annotation_checks(spark, d):
    return _annotations(spark, d).select("case_id", F.array_join(responses.annotation_issues(), ",").alias("issues")).where("issues <> ''")


def effective_annotations(spark, d):
    """Local rows (two rounds) over a template."""
    t = _t(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("case_id"), F.lit("template").alias("note"), F.lit(None).cast("long").alias("round"))
    l = _t(spark, d, "part").where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("case_id"), F.explode(F.expr("sequence(1L, 2L)")).alias("round"))  # noqa: E741
    local = l.where("round = 1 or case_id % 12 = 0").select("case_id", F.concat(F.lit("local "), F.col("round").cast("string")).alias("note"), "round")
    return responses.effective_annotations(t, local, "case_id", "round")


def human_summary(spark, d):
    s = responses.human_summary(_annotations(spark, d), "g")
    return s


def merged_remarks(spark, d):
    """Tags of all documents a type, as first seen by document: how text lists of reviews are merged."""
    x = roles.chunks(spark, d).where("chunk % 3 = 0").select("document_type", "doc", "tags")
    return metrics.first_seen(x, ["document_type"], "tags", ["doc"], "merged").withColumn("merged", F.array_join("merged", ","))


def review_packets(spark, d):
    r = _responses(spark, d)
    cases = _t(spark, d, "conversations").where("role = 'user' and turn < 2").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return responses.review_packets(cases, r.where("conv_id % 9 <> 0").select("conv_id", "solution", F.size("evidence_titles").alias("n_evidence")), "conv_id")


def observability(spark, d):
    """Events a user as one request's log."""
    e = _t(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", "skill").when(F.col("event_type") == "view", "provider").when(F.col("event_type") == "signup", "candidates").when(F.col("event_type") == "purchase", "evidence").otherwise("fallback").alias("kind"), F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("skipped"), F.lit("recommended")), (F.col("event_id") % 4 + 1).cast("int")).alias("outcome"), (F.col("event_id") % 6).alias("value"))
    return responses.observability(e, "user_id")


def recompute_and_compare(spark, d):
    """The stored summary of the retrieval methods, worked out anew from stored case rows: no difference but in the column that was spoiled."""
    from ..shared import durable

    scores = durable(retrieval._scores(spark, d), "case-scores")
    stored = metrics.method_summary(scores, ["q"]).withColumn("n_errors", F.when(F.col("method") == "vector_v1", F.col("n_errors") + 1).otherwise(F.col("n_errors")))
    again = metrics.method_summary(scores, ["q"])
    return checks.diff(stored, again, "method", [c for c in again.columns if c not in ("method", "latency", "reasons")])


_NAMES = "run_folders run_warnings request_cost node_model_gates routing_table_gated budget_with_unknown_costs pilot_totals failure_summaries failure_taxonomy evaluate_assertions run_summary response_scores score_averages problem_cases recommend_provider annotation_checks effective_annotations human_summary merged_remarks review_packets observability recompute_and_compare"
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_REC = _R + """, fr AS (SELECT run, node, model, status, error_type, concat_ws(',', CASE WHEN NOT coalesce(schema_ok, false) THEN 'schema' END, CASE WHEN NOT rule_ok THEN 'rule' END, CASE WHEN NOT coalesce(boundary_ok, false) THEN 'boundary' END) AS types, (NOT coalesce(schema_ok, false))::INT + (NOT coalesce(boundary_ok, false))::INT AS n_blocking, (NOT rule_ok)::INT AS n_other, error_message,
        concat_ws(',', CASE WHEN NOT coalesce(boundary_ok, false) THEN 'boundary' END, CASE WHEN NOT rule_ok THEN 'rule' END, CASE WHEN NOT coalesce(schema_ok, false) THEN 'schema' END) AS sorted, json_ok, schema_ok, rule_ok, evidence_ok, boundary_ok FROM r WHERE status <> 'passed'),
    fs AS (SELECT *, CASE WHEN x = '' THEN 'Benchmark failure without additional summary.' WHEN length(x) <= 200 THEN x ELSE substr(x, 1, 197) || '...' END AS summary FROM (SELECT *, concat_ws(' | ', 'error_type=' || error_type, CASE WHEN sorted <> '' THEN 'assertions=' || sorted END, error_message) AS x FROM fr))"""
_FOLDERS = """f AS (SELECT s_suppkey AS i, s_suppkey % 17 <> 0 AS m, s_suppkey % 17 <> 0 AND s_suppkey % 13 <> 0 AS ok, s_suppkey % 7 = 0 AND s_suppkey % 14 <> 0 AS p, CASE WHEN s_suppkey % 8 = 0 THEN 2 WHEN s_suppkey % 4 = 0 THEN 5 END AS v, s_suppkey % 5 <> 0 AS rep FROM supplier),
    r AS (SELECT *, ['A', 'B', 'C'][i % 3 + 1] AS architecture, CASE WHEN i % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN i % 10 = 0 THEN 'invalid_json' END AS error_type, i % 10 = 0 OR p AS bad, i % 15 = 5 AS says FROM f WHERE ok)"""
ORACLE = {
    "run_folders": f"""WITH {_FOLDERS} SELECT CAST(i AS VARCHAR) AS run, architecture, status, error_type, i * 10 AS prompt_tokens, i * 12 AS total_tokens, CASE WHEN architecture = 'A' THEN NULL WHEN bad THEN false WHEN v IS NOT NULL THEN true WHEN status = 'success' AND rep THEN true WHEN says OR error_type IS NOT NULL THEN false END AS json_success,
        CASE WHEN architecture = 'A' THEN NULL WHEN bad OR v IS NOT NULL THEN false WHEN status = 'success' AND rep THEN true WHEN says OR error_type IS NOT NULL THEN false END AS schema_success, CASE WHEN v IS NOT NULL THEN v WHEN architecture <> 'A' AND NOT bad AND status = 'success' AND rep THEN 0 END AS n_validation_errors FROM r""",
    "run_warnings": f"""WITH {_FOLDERS} SELECT CAST(i AS VARCHAR) AS folder, 'run_metadata.json' AS file, CASE WHEN m THEN 'unreadable' ELSE 'missing' END AS warning FROM f WHERE NOT ok AND (m OR i % 7 = 0 OR v IS NOT NULL OR rep)
        UNION ALL SELECT CAST(i AS VARCHAR), 'json_parse_error.json', 'unreadable' FROM f WHERE i % 14 = 0""",
    "request_cost": f"WITH {_R} SELECT model, count(cost) AS n_priced, count(*) AS n_runs, round(sum(cost), 4) AS cost FROM r GROUP BY 1",
    "node_model_gates": f"WITH {_S} SELECT node, model, n_runs, n_passed, n_errors, n_blocked, json_ok_rate, schema_ok_rate, evidence_ok_rate, boundary_ok_rate, rule_ok_rate, mean_latency, tokens, cost, reasons, reasons = '' AS eligible FROM s",
    "routing_table_gated": f"WITH {_S}, o AS (SELECT *, NOT list_contains(string_split(reasons, ','), 'request_error') AND n_runs >= 10 AS ok FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY node, ok ORDER BY CASE WHEN coalesce(cost, 0) = 0 THEN 999999 ELSE cost END, mean_latency, tokens, model) AS place FROM o) SELECT node, max(model) FILTER (ok AND place = 1) AS \"primary\", max(model) FILTER (ok AND place = 2) AS fallback, coalesce(string_agg(model, ',' ORDER BY model) FILTER (NOT ok), '') AS disqualified, CASE WHEN count(*) FILTER (ok) = 0 THEN 'no_eligible_model' ELSE 'route_ready' END AS status FROM p GROUP BY node",
    "budget_with_unknown_costs": f"WITH {_R}, w AS (SELECT *, coalesce(sum(coalesce(cost, 0)) OVER o, 0) AS spent, coalesce(sum((cost IS NULL)::INT) OVER o, 0) AS unk FROM r WINDOW o AS (PARTITION BY node ORDER BY ts, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT node, count(*) AS n_run, count(*) FILTER (cost IS NULL) AS n_unknown, max(run) AS last_run FROM w WHERE spent < 20 AND unk <= 400 GROUP BY node",
    "pilot_totals": f"WITH {_R}, c AS (SELECT node, model, count(*) AS n, sum(tokens) AS tokens, sum(cost) AS cost, avg(latency) AS latency FROM r GROUP BY ALL), u AS (SELECT * FROM c UNION ALL SELECT NULL, model, sum(n), sum(tokens), sum(cost), avg(latency) FROM c GROUP BY model UNION ALL SELECT NULL, NULL, sum(n), sum(tokens), sum(cost), avg(latency) FROM c) SELECT node, model, CAST(n AS BIGINT) AS n, CAST(tokens AS BIGINT) AS tokens, round(cost, 6) AS cost, round(tokens / n, 3) AS mean_tokens, round(latency, 3) AS latency FROM u",
    "failure_summaries": f"WITH {_REC} SELECT run, node, model, status, error_type, types, CAST(n_blocking AS BIGINT) AS n_blocking, CAST(n_other AS BIGINT) AS n_other, summary FROM fs",
    "failure_taxonomy": f"WITH {_REC} SELECT 'node' AS dimension, node AS value, count(*) AS n FROM fr GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM fr GROUP BY 2 UNION ALL SELECT 'error_type', coalesce(error_type, 'unknown'), count(*) FROM fr GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM fr UNION ALL SELECT 'assertion_type', t, count(*) FROM (SELECT unnest(string_split(types, ',')) AS t FROM fr) WHERE t <> '' GROUP BY 2 UNION ALL SELECT 'assertions', 'blocking', CAST(sum(n_blocking) AS BIGINT) FROM fr UNION ALL SELECT 'assertions', 'non_blocking', CAST(sum(n_other) AS BIGINT) FROM fr"
    + "".join(f" UNION ALL SELECT 'gate', '{c}', count(*) FILTER (NOT coalesce({c}, false)) FROM fr" for c in ("json_ok", "schema_ok", "rule_ok", "evidence_ok", "boundary_ok")),
    "evaluate_assertions": "WITH e AS (SELECT value < 300 AS f, event_type AS t, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT 'flag' AS type, 'request' AS location, count(*) FILTER (f) AS n_passed, count(*) AS n FROM e UNION ALL SELECT 'value_equals', 'items[0].name', count(*) FILTER (t = 'click'), count(*) FROM e UNION ALL SELECT 'value_equals', 'items.1.name', count(*), count(*) FROM e UNION ALL SELECT 'value_equals', 'k', count(*) FILTER (k = 7), count(*) FROM e UNION ALL SELECT 'forbidden_absent', 'output', 0, count(*) FROM e UNION ALL SELECT 'forbidden_absent', 'items[0]', count(*), count(*) FROM e",
    "run_summary": """WITH x AS (SELECT event_id AS i, ['A', 'B', 'C'][user_id % 3 + 1] AS architecture, event_type <> 'error' AND event_id % 3 <> 0 AS fine, event_id % 29 = 0 OR event_id % 23 = 0 AS bad, CASE WHEN event_id % 19 = 0 THEN event_id % 4 END AS v, event_id % 5 = 0 AS told FROM events),
        y AS (SELECT architecture, CASE WHEN architecture = 'A' THEN NULL WHEN bad THEN false WHEN v IS NOT NULL THEN true WHEN fine THEN true WHEN told THEN false END AS json_success, CASE WHEN architecture = 'A' THEN NULL WHEN bad OR v IS NOT NULL THEN false WHEN fine THEN true WHEN told THEN false END AS schema_success, CASE WHEN v IS NOT NULL THEN v WHEN architecture <> 'A' AND NOT bad AND fine THEN 0 END AS n FROM x) SELECT architecture, json_success, schema_success, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_errors FROM y GROUP BY ALL""",
    "response_scores": f"WITH {_W} SELECT * EXCLUDE (provider, valid) FROM sr",
    "score_averages": f"WITH {_W} SELECT provider, " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in ("schema_validity", "section_completeness", "evidence_grounding", "hallucination_risk", "fallback_alignment", "business_clarity", "overall")) + ", " + ", ".join(f"count(*) FILTER ({c}) AS n_{n}" for n, c in responses.PROBLEMS.items()) + " FROM sr GROUP BY provider",
    "problem_cases": f"WITH {_W} " + " UNION ALL ".join(f"SELECT provider, conv_id, '{n}' AS problem FROM sr WHERE {c}" for n, c in responses.PROBLEMS.items()),
    "recommend_provider": f"WITH {_W}, a AS (SELECT provider, round(avg(overall), 4) AS score FROM sr GROUP BY 1) SELECT min(provider) FILTER (provider <> 'p2') AS demo, (SELECT provider FROM a WHERE provider <> 'p2' ORDER BY score DESC, provider DESC LIMIT 1) AS production FROM a",
    "annotation_checks": f"""WITH {_H}, x AS (SELECT k AS case_id, concat_ws(',', CASE WHEN {" OR ".join(f"s{j} NOT BETWEEN 1 AND 5" for j in range(6))} THEN 'score_out_of_range' END, CASE WHEN n > 0 AND n < 6 THEN 'some_scores_missing' END, CASE WHEN reviewer IS NULL AND at_ THEN 'reviewed_without_reviewer' END, CASE WHEN reviewer IS NOT NULL AND n < 6 THEN 'review_without_scores' END, CASE WHEN n = 6 AND own IS NOT NULL AND round(own, 2) <> mean THEN 'overall_mismatch' END, CASE WHEN n < 6 AND own IS NOT NULL THEN 'overall_too_early' END, CASE WHEN n < 6 AND pf IS NOT NULL THEN 'verdict_too_early' END) AS issues FROM an) SELECT * FROM x WHERE issues <> ''""",
    "effective_annotations": "WITH t AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 0), l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 12 = 0 THEN 2 ELSE 1 END AS r FROM part WHERE p_partkey % 6 = 0) SELECT coalesce(t.k, l.k) AS case_id, CASE WHEN l.k IS NOT NULL THEN 'local ' || r ELSE 'template' END AS note, CAST(r AS BIGINT) AS round FROM t FULL JOIN l ON t.k = l.k",
    "human_summary": f"WITH {_H} SELECT g, count(*) AS n_annotations, count(reviewer) AS n_completed, " + ", ".join(f"round(avg(s{j}) FILTER (reviewer IS NOT NULL), 4) AS {c}" for j, c in enumerate(responses.HUMAN_SCORES)) + ", round(avg(own) FILTER (reviewer IS NOT NULL), 4) AS overall_human_score, round(count(*) FILTER (reviewer IS NOT NULL AND pf = 'pass') / nullif(count(reviewer), 0), 4) AS pass_rate, CASE WHEN count(reviewer) = 0 THEN 'not_started' WHEN count(reviewer) = count(*) THEN 'completed' ELSE 'in_progress' END AS status FROM an GROUP BY g",
    "merged_remarks": f"WITH {roles.SQL}, x AS (SELECT document_type, t, min(row(doc, i)) AS at_ FROM (SELECT document_type, doc, unnest(tags) AS t, unnest(range(len(tags))) AS i FROM chunks WHERE chunk % 3 = 0) GROUP BY ALL) SELECT document_type, string_agg(t, ',' ORDER BY at_) AS merged FROM x GROUP BY 1",
    "review_packets": f"WITH {_W}, c AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' AND turn < 2 GROUP BY 1) SELECT conv_id, substr(trim(regexp_replace(query, '\\s+', ' ', 'g')), 1, 120) AS query_preview, CASE WHEN conv_id % 9 = 0 THEN '' ELSE substr(trim(regexp_replace(sol, '\\s+', ' ', 'g')), 1, 240) END AS solution_preview, CASE WHEN conv_id % 9 = 0 OR conv_id % 6 = 0 THEN 0 ELSE 2 END AS n_evidence FROM c LEFT JOIN w ON i = conv_id",
    "observability": "WITH x AS (SELECT user_id, event_type AS t, event_id % 4 AS o, event_id % 6 AS v FROM events) SELECT user_id, count(*) FILTER (t = 'click') AS n_skills, count(*) FILTER (t = 'click' AND o = 1) AS n_failed_skills, count(*) FILTER (t = 'view' AND o = 0) AS n_providers_ok, count(*) FILTER (t = 'view' AND o = 1) AS n_providers_failed, count(*) FILTER (t = 'view' AND o = 2) AS n_providers_skipped, coalesce(CAST(sum(v) FILTER (t = 'signup') AS BIGINT), 0) AS n_candidates, coalesce(CAST(sum(v) FILTER (t = 'purchase') AS BIGINT), 0) AS n_evidence, bool_or(t = 'error' AND o = 3) AS fell_back FROM x GROUP BY 1",
    "recompute_and_compare": "SELECT 'vector_v1' AS method, 'n_errors' AS \"column\" FROM supplier LIMIT 1",
}
