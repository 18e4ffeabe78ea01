"""Nested values as rows: every node of a JSON value with its path, the paths at which two values differ, ids at any depth, report checks.

Paths are written a.b[0].c, and $ for the whole value. A text that is no JSON has one node, of kind `broken`; a null has none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "path string, parent string, field string, kind string, size int, value string"
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "int", float: "double", type(None): "null"}


def _walk(value: object, path: str, parent: str | None, field: str | None, out: list[tuple], fields: frozenset | None = None, only: type | None = None) -> None:
    """Adds all nodes, or those of the names and the type asked for."""
    todo = [(value, path, parent, field)]
    while todo:
        value, path, parent, field = todo.pop()
        kind = type(value)
        many = kind is dict or kind is list
        if (fields is None or field in fields) and (only is None or kind is only):
            out.append((path or "$", parent, field, _KINDS[kind], len(value) if many else None, None if many else json.dumps(value, ensure_ascii=False)))
        if kind is dict:
            todo += [(v, f"{path}.{k}" if path else k, path or "$", k) for k, v in value.items()]
        elif kind is list:
            todo += [(v, f"{path}[{i}]", path or "$", field) for i, v in enumerate(value)]


def nodes(df: DataFrame, key: str, column: str, fields: list[str] | None = None, only: type | None = None) -> DataFrame:
    """key and NODES of each value: kind, number of fields or elements of a container, JSON text of anything else.

    field is the name under which a node, or the array that holds it, stands. fields, only: names and a type of which alone rows are made."""
    wanted = None if fields is None else frozenset(fields)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                before = len(rows)
                try:
                    _walk(json.loads(text), "", None, None, rows, wanted, only)
                except ValueError:
                    if wanted is None:
                        rows.append(("$", None, None, "broken", None, text))
                at += [i] * (len(rows) - before)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int32() if i == 4 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[key, "path", "parent", "field", "kind", "size", "value"])

    return df.select(key, F.col(column).cast("string").alias("_text")).mapInArrow(run, f"{key} {kind}, {NODES}")


def _by_path(text: str | None) -> dict[str, list[tuple]]:
    """kind, size and value of the nodes of a text, by path; names with dots may give several nodes one path."""
    rows: list[tuple] = []
    if text is not None:
        try:
            _walk(json.loads(text), "", None, None, rows)
        except ValueError:
            rows.append(("$", None, None, "broken", None, text))
    out: dict[str, list[tuple]] = {}
    for path, _, _, kind, size, value in rows:
        out.setdefault(path, []).append((kind, size, value))
    return out


def _differences(a: dict[str, list[tuple]], b: dict[str, list[tuple]]) -> dict[str, str]:
    """change by path, without what lies below another differing path."""
    out = {path: "removed" for path in a if path not in b}
    for path, now in b.items():
        if path not in a:
            out[path] = "added"
            continue
        for (was, n, old), (kind, size, value) in zip(sorted(a[path], key=repr), sorted(now, key=repr), strict=False):
            if was != kind:
                out.setdefault(path, "type")
            elif kind == "array" and n != size:
                out.setdefault(path, "length")
            elif old != value:
                out.setdefault(path, "value")
        if len(a[path]) != len(now):
            out.setdefault(path, "removed" if len(a[path]) > len(now) else "added")
    if "$" in out:
        return {"$": out["$"]}
    return {p: c for p, c in out.items() if not any(p[i] in ".[" and p[:i] in out for i in range(1, len(p)))}


def differences(expected: DataFrame, actual: DataFrame, key: str, column: str, ignored: list[str] = ()) -> DataFrame:
    """key, path, change (added, removed, type, length, value) of two JSON columns of the same key, each key once a side.

    Nothing below a differing node is told. Arrays of different lengths differ as a whole. Paths that end with one of `ignored` are left
    out at last, so what lies below them is left out too. A key of one side alone differs in its whole value ($)."""
    j = expected.select(key, F.col(column).cast("string").alias("a")).join(actual.select(key, F.col(column).cast("string").alias("b")), key, "full")
    # both texts of a key are in one row: equal ones are not parsed, and of the others only paths that differ leave the task
    unlike = j.where(~F.col("a").eqNullSafe(F.col("b")))
    kind = dict(unlike.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, changes = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                told = _differences(_by_path(x), _by_path(y))
                at += [i] * len(told)
                paths += told
                changes += told.values()
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(changes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "path", "change"])

    told = unlike.select(key, "a", "b").mapInArrow(run, f"{key} {kind}, path string, change string")
    for suffix in ignored:
        told = told.where(~F.endswith("path", F.lit(suffix)))
    return told


def references(df: DataFrame, key: str, column: str, fields: list[str]) -> DataFrame:
    """key, path, id: the strings that stand under one of these names, or in an array under it, at any depth."""
    found = nodes(_naming(df, column, fields), key, column, fields, str)
    return found.select(key, "path", F.expr("get_json_object(concat('[', value, ']'), '$[0]')").alias("id"))


def _naming(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Rows whose text can hold one of these names: it stands there as it is, or something is escaped."""
    text = F.col(column).cast("string")
    may = F.contains(text, F.lit("\\"))
    for name in fields:
        may |= F.contains(text, F.lit(name))
    return df.where(may)


def reference_counts(df: DataFrame, key: str, column: str, fields: list[str], known: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(key, n_references, passed: it has references and knows all, n_unknown, first_path: the least path of those; key, path, id of those unknown).

    References are looked up once and gathered once by key."""
    used = references(df, key, column, fields)
    ids = known.select(F.col(id_column).cast("string").alias("id")).distinct().withColumn("_known", F.lit(True))
    told = used.join(ids, "id", "left").withColumn("_unknown", F.col("_known").isNull())
    n = told.groupBy(key).agg(F.count("*").alias("n"), F.count_if("_unknown").alias("u"), F.min(F.when(F.col("_unknown"), F.col("path"))).alias("first_path"))
    none = F.lit(0)
    out = df.select(key).join(n, key, "left").select(key, F.coalesce("n", none).alias("n_references"), F.coalesce("u", none).alias("n_unknown"), "first_path")
    out = out.select(key, "n_references", ((F.col("n_references") > 0) & (F.col("n_unknown") == 0)).alias("passed"), "n_unknown", "first_path")
    return out, told.where("_unknown").select(key, "path", "id")


def references_exist(df: DataFrame, key: str, column: str, fields: list[str], known: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(key, n_references, passed: it has references and knows all; key, path, id of those unknown)."""
    told, unknown = reference_counts(df, key, column, fields, known, id_column)
    return told.select(key, "n_references", "passed"), unknown


def named(df: DataFrame, key: str, column: str, fields: list[str]) -> DataFrame:
    """key and NODES of what stands under one of these names, or in an array under it; texts that hold none are not parsed."""
    return nodes(_naming(df, column, fields), key, column, fields)


# Names that a report must not hold, suitabilities that may be recommended, and urgent levels.
INTERNAL_KEYS = ["risk_trace", "risk_traces", "action_trace", "action_traces", "node_records", "failures", "artifact_paths", "matched_terms", "prompt_version", "api_key"]
SUITABLE = ["suitable_now", "suitable_for_poc", "suitable_after_prerequisites"]
URGENT = ["high", "critical"]


def report_issues(differs: Column, leaks: Column) -> dict[str, Column]:
    """How many issues of each code a report has against the state it was made from: a number by code.

    A row has case_id, report_case_id, review (human review is required), total, dimensions array<struct<score, max_score>>,
    candidates array<string>, recommended array<struct<solution, opportunities array<string>>>, opportunities array<struct<id, suitability>>,
    gaps, risks array<struct<id, level>>, report_risks, report_actions array<string>, risk_traces array<struct<id, gaps array<string>>>,
    action_traces array<struct<id, risks array<string>>>, actions array<struct<id, priority, gaps array<string>>>. differs: paths at
    which the report's parts differ from the state's (score, recommendations); leaks: how many internal names the report holds."""
    n = lambda name, cond: F.size(F.filter(name, cond))
    ids = lambda name: F.transform(name, lambda x: x["id"])
    urgent = lambda name: F.transform(F.filter(name, lambda x: x["level"].isin(*URGENT)), lambda x: x["id"])
    total = F.aggregate("dimensions", F.lit(0).cast("long"), lambda z, x: z + x["score"])
    fit = F.transform(F.filter("opportunities", lambda x: x["suitability"].isin(*SUITABLE)), lambda x: x["id"])
    asked = F.flatten(F.transform("recommended", lambda x: x["opportunities"]))
    beyond = lambda some, known: F.size(F.array_except(some, known)) > 0

    def driven(x: Column) -> Column:
        traced = F.flatten(F.transform(F.filter("action_traces", lambda t: t["id"] == x["id"]), lambda t: t["risks"]))
        return F.arrays_overlap(x["gaps"], urgent("gaps")) | F.arrays_overlap(traced, urgent("risks"))

    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "CASE_ID_MISMATCH": one(~F.col("case_id").eqNullSafe(F.col("report_case_id"))), "HUMAN_REVIEW_DISABLED": one(~F.coalesce("review", F.lit(False))),
        "DEAL_SCORE_MISMATCH": one(F.exists(differs, lambda p: F.startswith(p, F.lit("score")))), "DEAL_SCORE_TOTAL_INVALID": one((F.col("total") != total) | ~F.col("total").between(0, 100)),
        "DEAL_SCORE_DIMENSION_INVALID": one(F.exists("dimensions", lambda x: (x["score"] < 0) | (x["score"] > x["max_score"]))),
        "SOLUTION_RECOMMENDATION_MISMATCH": one(F.exists(differs, lambda p: F.startswith(p, F.lit("recommended")))), "RECOMMENDATION_WITHOUT_CANDIDATE": one((F.size("candidates") == 0) & (F.size("recommended") > 0)),
        "SOLUTION_OUTSIDE_RETRIEVED_CANDIDATES": n("recommended", lambda x: ~F.array_contains("candidates", x["solution"])), "UNKNOWN_OPPORTUNITY_REFERENCE": F.size(F.filter(asked, lambda x: ~F.array_contains(ids("opportunities"), x))),
        "INELIGIBLE_OPPORTUNITY_RECOMMENDATION": F.size(F.filter(asked, lambda x: F.array_contains(ids("opportunities"), x) & ~F.array_contains(fit, x))),
        "ORPHAN_RISK_TRACE": n("risk_traces", lambda t: ~F.array_contains("report_risks", t["id"])), "UNKNOWN_GAP_REFERENCE": n("risk_traces", lambda t: beyond(t["gaps"], ids("gaps"))),
        "ORPHAN_ACTION_TRACE": n("action_traces", lambda t: ~F.array_contains("report_actions", t["id"])), "UNKNOWN_RISK_REFERENCE": n("action_traces", lambda t: beyond(t["risks"], ids("risks"))),
        "P0_ACTION_WITHOUT_CRITICAL_DRIVER": n("actions", lambda x: (x["priority"] == "P0") & ~driven(x)), "INTERNAL_WORKFLOW_DATA_LEAK": one(leaks > 0),
    }
