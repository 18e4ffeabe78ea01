"""Run logs: cost, gates, roll-ups, routing, budgets, failures, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMMARY_LIMIT = 200


def request_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Tokens a million times price, six places, half to even; null tokens give null."""
    return F.bround((prompt * price_in + completion * price_out) / F.lit(1_000_000), 6)


def priced(runs: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """runs (prompt_tokens, completion_tokens) with cost from a price table (model, input_price, output_price, a million tokens); unknown models give null."""
    return runs.join(F.broadcast(prices), model, "left").withColumn("cost", request_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input_price"), F.col("output_price"))).drop("input_price", "output_price")


def node_model_summary(runs: DataFrame, always: dict[str, str], by_node: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """Per (node, model): counts, pass rates (null counts as failed), latency, tokens, null-aware cost, ordered reasons, eligibility.

    always: flag -> reason where its rate is below 1, for every node; by_node: flag -> (nodes that it gates, reason). A request error and a
    blocking failure (n_blocking > 0), where runs have them, disqualify too."""
    by_node = by_node or {}
    flags = [*always, *by_node]
    rate = {f: F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")), 6).alias(f"{f}_rate") for f in flags}
    error = F.count_if(F.col("status") == "request_error") if "status" in runs.columns else F.lit(0).cast("long")
    passed = F.count_if(F.col("status") == "passed") if "status" in runs.columns else F.lit(0).cast("long")
    blocking = F.count_if(F.col("n_blocking") > 0) if "n_blocking" in runs.columns else F.lit(0).cast("long")
    whole = {f: F.bool_and(F.coalesce(F.col(f), F.lit(False))).alias(f"_{f}") for f in flags}
    got = runs.groupBy("node", "model").agg(F.count("*").alias("n_runs"), passed.alias("n_passed"), error.alias("n_errors"), blocking.alias("n_blocked"), *rate.values(), *whole.values(), F.round(F.avg("latency"), 3).alias("mean_latency"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    marks = [F.when(F.col("n_errors") > 0, F.lit("request_error"))] + [F.when(~F.col(f"_{f}"), F.lit(r)) for f, r in always.items()] + [F.when(F.col("n_blocked") > 0, F.lit("blocking_assertion_failure"))]
    marks += [F.when(F.col("node").isin(nodes) & ~F.col(f"_{f}"), F.lit(r)) for f, (nodes, r) in by_node.items()]
    return got.withColumn("reasons", F.array_compact(F.array(*marks))).withColumn("eligible", F.size("reasons") == 0).drop(*[f"_{f}" for f in flags])


def routing_table(summary: DataFrame, full: int) -> DataFrame:
    """Per node the primary and fallback model by cost (0 and null last), latency, tokens, name; what is disqualified; and the route's status."""
    ok = F.col("eligible") & (F.col("n_runs") >= full)
    price = F.when(F.coalesce(F.col("cost"), F.lit(0)) == 0, F.lit(999999)).otherwise(F.col("cost"))
    w = Window.partitionBy("node", ok).orderBy(price, "mean_latency", "tokens", "model")
    r = summary.withColumn("ok", ok).withColumn("place", F.row_number().over(w))
    pick = lambda n: F.max(F.when(F.col("ok") & (F.col("place") == n), F.col("model")))
    got = r.groupBy("node").agg(pick(1).alias("primary"), pick(2).alias("fallback"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("model")))).alias("disqualified"))
    return got.withColumn("status", F.when(F.col("primary").isNull(), "no_eligible_model").otherwise("route_ready"))


def budget_cutoff(runs: DataFrame, group: list[str], order: list[str], budget: float, max_unknown: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Runs of each group in order until what was spent before reaches the budget, or more than max_unknown runs of unknown cost were made before.

    bucket: a coarse Column that rises with the order (an hour, say). Sums a bucket come first, so only the bucket in which a group
    stops is gone through row by row; a group of any size is no single task then. Costs must not be negative."""
    b = F.lit(0) if bucket is None else bucket
    cost, unknown = F.coalesce(F.col("cost"), F.lit(0)), F.col("cost").isNull().cast("long")
    most = F.lit(max_unknown if max_unknown is not None else (1 << 62))
    rows = runs.withColumn("_b", b)
    sums = rows.groupBy(*group, "_b").agg(F.sum(cost).alias("_s"), F.sum(unknown).alias("_u"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_s0", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_u0", F.coalesce(F.sum("_u").over(before), F.lit(0)))
    sums = sums.where((F.col("_s0") < budget) & (F.col("_u0") <= most)).withColumn("_whole", (F.col("_s0") + F.col("_s") < budget) & (F.col("_u0") + F.col("_u") <= most))
    near = rows.join(sums.select(*group, "_b", "_s0", "_u0", "_whole"), [*group, "_b"])
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = near.where("not _whole").withColumn("_s1", F.col("_s0") + F.coalesce(F.sum(cost).over(w), F.lit(0))).withColumn("_u1", F.col("_u0") + F.coalesce(F.sum(unknown).over(w), F.lit(0)))
    kept = part.where((F.col("_s1") < budget) & (F.col("_u1") <= most))
    return near.where("_whole").select(*runs.columns).unionByName(kept.select(*runs.columns))


def failure_records(runs: DataFrame, assertions: DataFrame, key: str, limit: int = SUMMARY_LIMIT) -> DataFrame:
    """Runs that did not pass, with their failed assertions (types in order of id), how many of them block, and a one-line summary.

    runs: key, node, model, status, error_type, error_message; assertions: key, assertion, type, passed, blocking."""
    failed = assertions.where(~F.coalesce(F.col("passed"), F.lit(False))).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("assertion", "type"))), lambda x: x["type"]).alias("types"), F.count_if("blocking").alias("n_blocking"), F.count_if(~F.col("blocking")).alias("n_other"))
    none = F.array().cast("array<string>")
    bad = runs.where(F.col("status") != "passed").select(key, "node", "model", "status", "error_type", "error_message").join(failed, key, "left").withColumn("types", F.coalesce("types", none))
    message = F.trim(F.regexp_replace(F.coalesce("error_message", F.lit("")), r"\s+", " "))
    said = F.concat_ws(" | ", F.when(F.coalesce("error_type", F.lit("")) != "", F.concat(F.lit("error_type="), "error_type")), F.when(F.size("types") > 0, F.concat(F.lit("assertions="), F.array_join(F.array_sort(F.array_distinct("types")), ","))), F.nullif(message, F.lit("")))
    said = F.when(said == "", "Benchmark failure without additional summary.").otherwise(said)
    said = F.when(F.length(said) <= limit, said).otherwise(F.concat(F.substring(said, 1, limit - 3), F.lit("...")))
    return bad.select(key, "node", "model", "status", "error_type", "types", F.coalesce("n_blocking", F.lit(0)).alias("n_blocking"), F.coalesce("n_other", F.lit(0)).alias("n_other"), said.alias("summary"))


def failure_counts(records: DataFrame, flags: DataFrame | None = None, key: str = "run") -> DataFrame:
    """dimension, value, n: failed runs by node, model, error type (null: unknown) and in all, assertion failures by type and by whether they
    block, and, from flags (key and boolean gates), runs that fail each gate."""
    one = records.select("node", "model", F.coalesce("error_type", F.lit("unknown")).alias("error_type"))
    g = one.groupingSets([[F.col("node")], [F.col("model")], [F.col("error_type")], []], "node", "model", "error_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "node").when(F.col("g") == 5, "model").when(F.col("g") == 6, "error_type").otherwise("all")
    out = g.select(name.alias("dimension"), F.coalesce("node", "model", "error_type").alias("value"), "n")
    out = out.unionByName(records.select(F.explode("types").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("assertion_type").alias("dimension"), "value", "n"))
    sums = records.agg(F.coalesce(F.sum("n_blocking"), F.lit(0)).alias("blocking"), F.coalesce(F.sum("n_other"), F.lit(0)).alias("non_blocking")).unpivot([], ["blocking", "non_blocking"], "value", "n")
    out = out.unionByName(sums.select(F.lit("assertions").alias("dimension"), "value", "n"))
    if flags is not None:
        gates = [c for c in flags.columns if c != key]
        f = records.select(key).join(flags, key).agg(*[F.count_if(~F.coalesce(F.col(c), F.lit(False))).alias(c) for c in gates]).unpivot([], gates, "value", "n")
        out = out.unionByName(f.select(F.lit("gate").alias("dimension"), "value", "n"))
    return out


def best_by_dimension(means: DataFrame, dimensions: list[str], provider: str) -> DataFrame:
    """The provider with the highest mean in each dimension; of ties the first by name."""
    long = means.unpivot([provider], dimensions, "dimension", "mean")
    w = Window.partitionBy("dimension").orderBy(F.desc("mean"), provider)
    return long.withColumn("place", F.row_number().over(w)).where("place = 1").select("dimension", provider, "mean")


def manifest_counts(runs: DataFrame, by: str, passed: Column) -> DataFrame:
    """Planned, completed (no error), passed, failed and errored runs, and runs of unknown cost."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    done = F.col("error_type").isNull()
    ok = F.coalesce(passed, F.lit(False))
    return runs.groupBy(by).agg(F.count("*").alias("n_planned"), n(done).alias("n_completed"), n(done & ok).alias("n_passed"), n(done & ~ok).alias("n_failed"), n(~done).alias("n_errors"), n(F.col("cost").isNull()).alias("n_unknown_cost"))


def pilot_rollup(runs: DataFrame) -> DataFrame:
    """node, model, counts, tokens, cost and mean latency: a row a node and model (means a run), a row a model (node null: mean of its nodes' means) and totals (both null)."""
    cells = runs.groupBy("node", "model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.avg("latency").alias("latency"))
    all_ = lambda *by: cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.avg("latency").alias("latency"))
    no = F.lit(None).cast("string")
    out = cells.unionByName(all_("model").withColumn("node", no)).unionByName(all_().withColumn("node", no).withColumn("model", no))
    return out.select("node", "model", "n", "tokens", F.round("cost", 6).alias("cost"), F.round(F.col("tokens") / F.col("n"), 3).alias("mean_tokens"), F.round("latency", 3).alias("latency"))


def latency_summary(runs: DataFrame, by: str) -> DataFrame:
    """Mean, extremes and count of latency; token total with null as 0."""
    return runs.groupBy(by).agg(F.count("latency").alias("n"), F.round(F.avg("latency"), 3).alias("mean"), F.max("latency").alias("most"), F.min("latency").alias("least"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def provider_status(runs: DataFrame, by: str) -> DataFrame:
    """completed, completed_with_case_errors, or failed (every run an error)."""
    got = runs.groupBy(by).agg(F.count("*").alias("n_cases"), F.count("error_type").alias("n_errors"))
    return got.withColumn("status", F.when(F.col("n_errors") == 0, "completed").when(F.col("n_errors") < F.col("n_cases"), "completed_with_case_errors").otherwise("failed"))


def recommend_provider(providers: DataFrame, house: str = "deterministic") -> DataFrame:
    """(demo, production): the house provider if it ran, else the first requested that completed; and the best scored other one that completed (ties: the larger name).

    providers: provider, place (order of request), ran, status, score."""
    fine = F.col("status").isin("completed", "completed_with_case_errors")
    got = providers.agg(F.max(F.when((F.col("provider") == house) & F.col("ran"), F.col("provider"))).alias("h"), F.min_by("provider", F.when(fine, F.col("place"))).alias("f"), F.count_if(fine).alias("n"), F.max(F.when(fine & (F.col("provider") != house) & F.col("score").isNotNull(), F.struct("score", "provider"))).alias("best"))
    return got.select(F.coalesce("h", F.when(F.col("n") > 0, F.col("f"))).alias("demo"), F.col("best.provider").alias("production"))


def usage_totals(runs: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Null-aware token total (all null gives null) and the models in first-seen order."""
    first = runs.groupBy(by, "model").agg(F.min(F.struct(*order)).alias("at"), F.sum("tokens").alias("tokens"))
    return first.groupBy(by).agg(F.sum("tokens").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))


def json_path(location: Column) -> Column:
    """A dotted path with numbers or [numbers] for places (a.0.b, a[0].b) as a JSON path."""
    return F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(F.concat(F.lit("."), F.replace(F.replace(location, F.lit("["), F.lit(".")), F.lit("]"), F.lit(""))), r"\.([0-9]+)(?=\.|$)", "[$1]"), r"\s", ""))


def evaluate_assertions(checks: DataFrame, forbidden: list[str]) -> DataFrame:
    """checks with actual and passed: a flag equals what is expected, a value at a path equals, a value holds no forbidden word.

    checks: type (flag, value_equals, forbidden_absent), location (a flag's column value is in `flag`), output (JSON), expected (string)."""
    out = checks.withColumn("_p", json_path(F.col("location")))
    value = F.when(F.col("location").isin("response", "output"), F.col("output")).otherwise(F.expr("get_json_object(output, _p)"))
    actual = F.when(F.col("type") == "flag", F.col("flag").cast("string")).otherwise(value)
    clean = ~F.exists(F.array(*map(F.lit, forbidden)), lambda w: F.coalesce(F.lower(value), F.lit("")).contains(w))
    ok = F.when(F.col("type") == "forbidden_absent", clean).otherwise(F.coalesce(actual == F.col("expected"), F.lit(False)))
    return out.withColumn("actual", actual).withColumn("passed", ok).drop("_p")


def run_summary(runs: DataFrame, parse_errors: DataFrame, validation_errors: DataFrame, key: str) -> DataFrame:
    """A row a run from its metadata and the error files it may have: whether its JSON and its schema were fine (null: not known).

    runs: key, architecture, status, error_type, started_at, has_report, detail; parse_errors: key; validation_errors: key, n_errors."""
    j = runs.join(parse_errors.select(key, F.lit(True).alias("_p")).distinct(), key, "left").join(validation_errors.groupBy(key).agg(F.max("n_errors").alias("_v")), key, "left")
    bad = (F.coalesce(F.col("error_type") == "invalid_json", F.lit(False))) | F.col("_p").isNotNull()
    told = F.coalesce(F.lower("detail").contains("invalid json"), F.lit(False))
    fine = (F.col("status") == "success") & F.col("has_report")
    a = F.col("architecture") == "A"
    js = F.when(a, F.lit(None)).when(bad, False).when(F.col("_v").isNotNull(), True).when(fine, True).when(told, False)
    schema = F.when(a, F.lit(None)).when(bad | F.col("_v").isNotNull(), False).when(fine, True).when(told, False)
    n = F.when(F.col("_v").isNotNull(), F.col("_v")).when(~a & ~bad & fine, F.lit(0))
    return j.withColumn("json_success", js).withColumn("schema_success", schema).withColumn("n_validation_errors", n.cast("long")).drop("_p", "_v")


RUN_FILES = ["run_metadata.json", "json_parse_error.json", "validation_error.json", "parsed_report.json"]


def runs_of_folders(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a run as run_summary gives it, warnings: folder, file, warning) of run folders (folder and the text of each of RUN_FILES).

    A folder without metadata, or with metadata that is no JSON object, is a warning and no run; an optional file that is no JSON
    object is a warning and counts as absent. Errors are counted as n_errors says, else by the length of `errors`."""
    good = lambda c: F.col(c).isNotNull() & F.json_object_keys(c).isNotNull()
    get = lambda c, path: F.when(good(c), F.get_json_object(c, path))
    m, v = "run_metadata", "validation_error"
    rows = folders.where(good(m)).select(
        F.coalesce(get(m, "$.run_id"), F.col("folder")).alias("run"), *[get(m, f"$.{c}").alias(c) for c in ("architecture", "case_id", "status", "error_type", "started_at")],
        *[get(m, f"$.usage.{c}").cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")], F.col("parsed_report").isNotNull().alias("has_report"), F.col(m).alias("detail"),
        good("json_parse_error").alias("_p"), F.when(good(v), F.coalesce(get(v, "$.n_errors").cast("long"), F.json_array_length(get(v, "$.errors")).cast("long"), F.lit(0))).alias("n_errors"),
    )
    told = run_summary(rows.drop("_p", "n_errors"), rows.where("_p").select("run"), rows.where("n_errors is not null").select("run", "n_errors"), "run")
    optional = [F.when(F.col(c).isNotNull() & ~good(c), F.struct(F.lit(f"{c}.json").alias("file"), F.lit("unreadable").alias("warning"))) for c in ("json_parse_error", v)]
    first = F.when(F.col(m).isNull(), F.struct(F.lit(RUN_FILES[0]).alias("file"), F.lit("missing").alias("warning"))).when(~good(m), F.struct(F.lit(RUN_FILES[0]).alias("file"), F.lit("unreadable").alias("warning")))
    warned = folders.select("folder", F.explode(F.array_compact(F.array(first, *optional))).alias("w")).select("folder", "w.*")
    return told, warned
