"""Queries of nested values: what two reports differ in, which ids they name, and what is wrong with them; with the SQL.

Orders are reports of a case, their lines its entities. What the workflow held and what the report says are JSON texts that differ by the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested
from .roles import table as _t


def _text(spark: bool, actual: bool) -> tuple[str, str]:
    """(text of a line, text of an order with `items`), in either dialect."""
    say = (lambda c: f"CAST({c} AS string)") if spark else (lambda c: f"CAST({c} AS VARCHAR)")
    part = f"CASE WHEN o % 5 = 0 AND line = 1 THEN {say('part + 1')} ELSE {say('part')} END" if actual else say("part")
    line = f"""concat('{{"line":', {say('line')}, ',"part":', {part}, ',"flags":["', rf, '","', ls, '"],"evidence":[{{"source_id":"p', {say('part')}, '"}}]}}')"""
    level = "CASE WHEN o % 7 = 0 THEN 'X' ELSE 'N' END" if actual else "'N'"
    total = f"""CASE WHEN o % 17 = 0 THEN concat('"', {say('n')}, '"') ELSE {say('n')} END""" if actual else say("n")
    more = """CASE WHEN o % 13 = 0 THEN ',"note":{"source_id":"x9","node_records":[1]}' ELSE '' END""" if actual else "''"
    whole = f"""concat('{{"case":', {say('o')}, ',"score":{{"total":', {total}, ',"level":"', {level}, '"}},"recommended":[', items, ']', {more}, '}}')"""
    return line, whole


_LINES = "l_orderkey AS o, CAST(l_linenumber AS INT) AS line, l_partkey AS part, l_returnflag AS rf, l_linestatus AS ls, CAST(l_quantity AS INT) AS qty"


def _side(spark, d, actual: bool):
    line, whole = _text(True, actual)
    rows = _t(spark, d, "lineitem").selectExpr(*_LINES.split(", ")).where("o % 19 <> 0 and not (o % 11 = 0 and line > 2)" if actual else "true")
    kept = rows.withColumn("text", F.expr(line)).groupBy("o").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), ",").alias("items"))
    return kept.select("o", F.expr(whole).alias("report"))  # an order has a few lines


def nested_differences(spark, d):
    """Paths at which orders' reports differ from what was held, notes aside."""
    return nested.differences(_side(spark, d, False), _side(spark, d, True), "o", "report", ignored=[".flags", "note"])


def output_references(spark, d):
    """Orders with the sources their report names at any depth, and whether all of them are known."""
    known = _t(spark, d, "part").where("p_partkey % 50 <> 3").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return nested.reference_counts(_side(spark, d, True), "o", "report", ["source_id"], known, "id")[0]


_ID = lambda c, n: f"concat('{c}', CAST({n} AS STRING))"


def report_checks(spark, d):
    """Every report's issues by code, over all codes that reports can have, and whether it passes."""
    x = _t(spark, d, "lineitem").selectExpr(*_LINES.split(", ")).groupBy("o").agg(F.array_sort(F.collect_list(F.struct("line", "part", "qty", "rf"))).alias("l"))
    of = lambda cond, out: f"transform(filter(l, x -> {cond}), x -> {out})"
    x = x.selectExpr(
        "o AS case_id", "o + CAST(o % 29 = 0 AS INT) AS report_case_id", "CASE WHEN o % 37 = 0 THEN NULL ELSE o % 31 <> 0 END AS review", of("true", "named_struct('score', x.qty % 12, 'max_score', 10)") + " AS dimensions",
        "CAST(aggregate(l, 0, (z, x) -> z + x.qty % 12) + CAST(o % 6 = 0 AS INT) AS BIGINT) AS total", of("x.line % 2 = 1 AND o % 23 <> 0", _ID("p", "x.part")) + " AS candidates",
        of("x.rf = 'R'", f"named_struct('solution', {_ID('p', 'x.part')}, 'opportunities', array({_ID('o', 'x.line')}, {_ID('o', 'x.line + 3')}))") + " AS recommended",
        of("true", f"named_struct('id', {_ID('o', 'x.line')}, 'suitability', CASE x.line % 3 WHEN 0 THEN 'suitable_now' WHEN 1 THEN 'suitable_for_poc' ELSE 'not_suitable' END)") + " AS opportunities",
        of("x.line % 2 = 0", f"named_struct('id', {_ID('g', 'x.line')}, 'level', CASE WHEN x.line % 4 = 0 THEN 'high' ELSE 'low' END)") + " AS gaps", of("true", f"named_struct('id', {_ID('r', 'x.line')}, 'level', CASE WHEN x.line % 3 = 0 THEN 'critical' ELSE 'low' END)") + " AS risks",
        of("x.line <> 5", _ID("r", "x.line")) + " AS report_risks", of("x.line <> 4", _ID("a", "x.line")) + " AS report_actions",
        of("true", f"named_struct('id', {_ID('r', 'x.line')}, 'gaps', array({_ID('g', 'x.line + x.line % 2')}))") + " AS risk_traces", of("true", f"named_struct('id', {_ID('a', 'x.line')}, 'risks', array({_ID('r', 'x.line + 2')}))") + " AS action_traces",
        of("true", f"named_struct('id', {_ID('a', 'x.line')}, 'priority', CASE WHEN x.line % 2 = 1 THEN 'P0' ELSE 'P1' END, 'gaps', array({_ID('g', 'x.line + 1')}))") + " AS actions",
    )
    differs = nested_differences(spark, d).groupBy("o").agg(F.collect_set("path").alias("paths"))  # of one report
    leaks = nested.named(_side(spark, d, True), "o", "report", nested.INTERNAL_KEYS).groupBy("o").agg(F.count("*").alias("leaks"))
    j = x.join(differs.withColumnRenamed("o", "case_id"), "case_id", "left").join(leaks.withColumnRenamed("o", "case_id"), "case_id", "left")
    told = nested.report_issues(F.coalesce("paths", F.array().cast("array<string>")), F.coalesce("leaks", F.lit(0)))
    each = j.select("case_id", *[c.cast("long").alias(n) for n, c in told.items()])
    return each.withColumn("passed", sum((F.col(n) for n in told), F.lit(0)) == 0)


def _sides_sql() -> str:
    out = []
    for name, actual in (("a", False), ("b", True)):
        line, whole = _text(False, actual)
        out.append(f"{name} AS (SELECT o, {whole} AS report FROM (SELECT o, count(*) AS n, string_agg({line}, ',' ORDER BY line, {line}) AS items FROM li {'WHERE o % 19 <> 0 AND NOT (o % 11 = 0 AND line > 2)' if actual else ''} GROUP BY o))")
    tree = "SELECT o, CASE WHEN fullkey = '$' THEN '$' ELSE substr(fullkey, 3) END AS path, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'int' ELSE type END AS kind, CASE WHEN type = 'ARRAY' THEN json_array_length(value) END AS size, CASE WHEN type NOT IN ('ARRAY', 'OBJECT') THEN CAST(value AS VARCHAR) END AS value FROM {0}, json_tree({0}.report)"
    return f"li AS (SELECT {_LINES} FROM lineitem), " + ", ".join(out) + f""", na AS ({tree.format("a")}), nb AS ({tree.format("b")}),
        un AS (SELECT coalesce(na.o, nb.o) AS o, coalesce(na.path, nb.path) AS path, CASE WHEN na.o IS NULL THEN 'added' WHEN nb.o IS NULL THEN 'removed' WHEN na.kind <> nb.kind THEN 'type' WHEN na.size <> nb.size THEN 'length' WHEN na.value IS DISTINCT FROM nb.value THEN 'value' END AS change FROM na FULL JOIN nb ON na.o = nb.o AND na.path = nb.path),
        df AS (SELECT * FROM un u WHERE change IS NOT NULL AND NOT EXISTS (SELECT 1 FROM un v WHERE v.change IS NOT NULL AND v.o = u.o AND v.path <> u.path AND (v.path = '$' OR starts_with(u.path, v.path || '.') OR starts_with(u.path, v.path || '['))) AND NOT ends_with(path, '.flags') AND NOT ends_with(path, 'note'))"""


def _report_sql() -> str:
    lam = lambda name, cond: f"len(list_filter({name}, lambda x: {cond}))"
    ids = lambda name, cond="true": f"list_transform(list_filter({name}, lambda y: {cond}), lambda y: y.id)"
    of = lambda cond, out: f"list_transform(list_filter(l, lambda x: {cond}), lambda x: {out})"
    asked = "flatten(list_transform(recommended, lambda x: x.opportunities))"
    known = {
        "op_ids": ids("opportunities"), "fit_ids": ids("opportunities", "y.suitability IN ('suitable_now', 'suitable_for_poc')"), "gap_ids": ids("gaps"), "risk_ids": ids("risks"),
        "urgent_gaps": ids("gaps", "y.level IN ('high', 'critical')"), "urgent_risks": ids("risks", "y.level IN ('high', 'critical')"),
    }
    codes = {
        "CASE_ID_MISMATCH": "(case_id <> report_case_id)::INT", "HUMAN_REVIEW_DISABLED": "(NOT coalesce(review, false))::INT", "DEAL_SCORE_MISMATCH": "coalesce(dm, 0)",
        "DEAL_SCORE_TOTAL_INVALID": "(total <> list_sum(list_transform(dimensions, lambda x: x.score)) OR total NOT BETWEEN 0 AND 100)::INT", "DEAL_SCORE_DIMENSION_INVALID": f"({lam('dimensions', 'x.score < 0 OR x.score > x.max_score')} > 0)::INT",
        "SOLUTION_RECOMMENDATION_MISMATCH": "coalesce(rm, 0)", "RECOMMENDATION_WITHOUT_CANDIDATE": "(len(candidates) = 0 AND len(recommended) > 0)::INT", "SOLUTION_OUTSIDE_RETRIEVED_CANDIDATES": lam("recommended", "NOT list_contains(candidates, x.solution)"),
        "UNKNOWN_OPPORTUNITY_REFERENCE": lam(asked, "NOT list_contains(op_ids, x)"), "INELIGIBLE_OPPORTUNITY_RECOMMENDATION": lam(asked, "list_contains(op_ids, x) AND NOT list_contains(fit_ids, x)"),
        "ORPHAN_RISK_TRACE": lam("risk_traces", "NOT list_contains(report_risks, x.id)"), "UNKNOWN_GAP_REFERENCE": lam("risk_traces", "NOT list_has_all(gap_ids, x.gaps)"), "ORPHAN_ACTION_TRACE": lam("action_traces", "NOT list_contains(report_actions, x.id)"),
        "UNKNOWN_RISK_REFERENCE": lam("action_traces", "NOT list_has_all(risk_ids, x.risks)"), "P0_ACTION_WITHOUT_CRITICAL_DRIVER": lam("actions", "x.priority = 'P0' AND NOT (list_has_any(x.gaps, urgent_gaps) OR list_contains(traced, x.id))"),
        "INTERNAL_WORKFLOW_DATA_LEAK": "(coalesce(leaks, 0) > 0)::INT",
    }
    return f"""WITH {_sides_sql()}, g AS (SELECT o, list(struct_pack(line := line, part := part, qty := qty, rf := rf) ORDER BY line, part, qty, rf) AS l FROM li GROUP BY o),
        x AS (SELECT o AS case_id, o + (o % 29 = 0)::INT AS report_case_id, CASE WHEN o % 37 = 0 THEN NULL ELSE o % 31 <> 0 END AS review, {of('true', "struct_pack(score := x.qty % 12, max_score := 10)")} AS dimensions, list_sum(list_transform(l, lambda x: x.qty % 12)) + (o % 6 = 0)::INT AS total,
            {of('x.line % 2 = 1 AND o % 23 <> 0', "'p' || x.part")} AS candidates, {of("x.rf = 'R'", "struct_pack(solution := 'p' || x.part, opportunities := ['o' || x.line, 'o' || (x.line + 3)])")} AS recommended,
            {of('true', "struct_pack(id := 'o' || x.line, suitability := CASE x.line % 3 WHEN 0 THEN 'suitable_now' WHEN 1 THEN 'suitable_for_poc' ELSE 'not_suitable' END)")} AS opportunities, {of('x.line % 2 = 0', "struct_pack(id := 'g' || x.line, level := CASE WHEN x.line % 4 = 0 THEN 'high' ELSE 'low' END)")} AS gaps,
            {of('true', "struct_pack(id := 'r' || x.line, level := CASE WHEN x.line % 3 = 0 THEN 'critical' ELSE 'low' END)")} AS risks, {of('x.line <> 5', "'r' || x.line")} AS report_risks, {of('x.line <> 4', "'a' || x.line")} AS report_actions, {of('true', "struct_pack(id := 'r' || x.line, gaps := ['g' || (x.line + x.line % 2)])")} AS risk_traces,
            {of('true', "struct_pack(id := 'a' || x.line, risks := ['r' || (x.line + 2)])")} AS action_traces, {of('true', "struct_pack(id := 'a' || x.line, priority := CASE WHEN x.line % 2 = 1 THEN 'P0' ELSE 'P1' END, gaps := ['g' || (x.line + 1)])")} AS actions FROM g),
        y AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in known.items())} FROM x), z AS (SELECT *, list_transform(list_filter(action_traces, lambda t: list_has_any(t.risks, urgent_risks)), lambda t: t.id) AS traced FROM y),
        dd AS (SELECT o AS case_id, max(starts_with(path, 'score')::INT) AS dm, max(starts_with(path, 'recommended')::INT) AS rm FROM df GROUP BY o),
        lk AS (SELECT b.o AS case_id, count(*) AS leaks FROM b, json_tree(b.report) t WHERE t.key IN ({", ".join(f"'{k}'" for k in nested.INTERNAL_KEYS)}) GROUP BY b.o),
        c AS (SELECT case_id, {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in codes.items())} FROM z LEFT JOIN dd USING (case_id) LEFT JOIN lk USING (case_id))
        SELECT *, {" + ".join(codes)} = 0 AS passed FROM c"""


QUERIES = {n: globals()[n] for n in "nested_differences output_references report_checks".split()}
ORACLE = {
    "nested_differences": f"WITH {_sides_sql()} SELECT o, path, change FROM df",
    "output_references": f"""WITH {_sides_sql()}, r AS (SELECT b.o, t.value->>'$' AS id, substr(t.fullkey, 3) AS path FROM b, json_tree(b.report) t WHERE t.key = 'source_id'), k AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 50 <> 3)
        SELECT b.o, count(r.o) AS n_references, count(r.o) > 0 AND count(r.o) = count(k.id) AS passed, count(r.o) - count(k.id) AS n_unknown, min(CASE WHEN k.id IS NULL THEN path END) AS first_path FROM b LEFT JOIN r ON r.o = b.o LEFT JOIN k ON k.id = r.id GROUP BY b.o""",
    "report_checks": _report_sql(),
}
