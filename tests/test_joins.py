"""Joins on overlapping lists and on intervals, nested values, line numbers and substring search against plain statements."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import sources
from weftline.operators import corpus, joins, nested, runs


@pytest.mark.parametrize("least", [1_000, 2])
def test_overlap_join_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(joins.split_join, "__defaults__", (50, least))
    r = random.Random(least)
    some = lambda n: [r.choice("abcde") for _ in range(r.randint(0, n))]
    q = [(i, r.choice([None, some(3)]), r.choice([None, some(2)])) for i in range(40)] + [(100 + i, None, None) for i in range(5)]
    d = [(i, some(3), r.choice([None, some(2)]), r.randint(0, 5)) for i in range(60)] + [(200 + i, ["a"], ["b"], 1) for i in range(40)]
    d += [(300, ["a", None], [None], 1)]
    queries = spark.createDataFrame(q, "q int, x array<string>, y array<string>")
    documents = spark.createDataFrame(d, "d int, u array<string>, v array<string>, n int")
    filters = [joins.Overlap("one", F.col("x"), F.col("u"), F.col("x").isNotNull()), joins.Overlap("two", F.col("y"), F.col("v"), F.size("y") > 0, F.col("v").isNull() | (F.size("v") == 0))]
    got = [(x.q, x.d) for x in joins.overlap_join(queries, documents, filters, "q", "d", F.col("n") > 0).collect()]
    fine = lambda v: {x for x in v or [] if x is not None}
    want = [(i, k) for i, x, y in q for k, u, v, n in d if n > 0 and (x is None or fine(x) & fine(u)) and (not y or not v or fine(y) & fine(v))]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    assert joins.overlap_join(queries.limit(0), documents, filters, "q", "d").count() == 0 == joins.overlap_join(queries, documents.limit(0), filters, "q", "d").count()


@pytest.mark.parametrize("least", [1_000, 2])
def test_interval_join_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(joins.split_join, "__defaults__", (50, least))
    r, day = random.Random(3), lambda n: datetime.date(1999, 12, 1) + datetime.timedelta(n)
    a = [(i, r.choice([None, day(r.randint(-40, 300))]), r.choice([None, day(r.randint(-40, 300))])) for i in range(120)] + [(500, day(9), day(9)), (501, day(9), day(8)), (502, None, None)]
    p = [(i, day(r.randint(0, 200))) for i in range(80)] + [(900, None), (901, day(9)), (902, day(9))]
    left, right = spark.createDataFrame(a, "i int, lo date, hi date"), spark.createDataFrame(p, "p int, at date")
    got = sorted((x.i, x.p) for x in joins.interval_join(left, "lo", "hi", right, "at", ("i", "p")).collect())
    assert got == sorted((i, k) for i, lo, hi in a for k, at in p if at and (lo is None or lo <= at) and (hi is None or at <= hi))
    assert joins.interval_join(left, "lo", "hi", right.limit(0), "at", ("i", "p")).count() == 0


def test_interval_totals_against_all_pairs_without_making_them(spark, monkeypatch):
    r, day = random.Random(4), lambda n: datetime.date(1999, 12, 1) + datetime.timedelta(n)
    a = [(i, r.choice([None, day(r.randint(-40, 300))]), r.choice([None, day(r.randint(-40, 300))])) for i in range(120)] + [(500, day(9), day(9)), (501, day(9), day(8)), (502, None, None), (503, None, None)]
    p = [(i, day(r.randint(0, 200))) for i in range(80)] + [(900, None), (901, day(9)), (902, day(9))]
    left, right = spark.createDataFrame(a, "i int, lo date, hi date"), spark.createDataFrame(p, "p int, at date")
    monkeypatch.setattr(joins, "split_join", None)  # makes pairs
    got = {x.i: (x.n, x.first, x.last, x.total) for x in joins.interval_totals(left, "lo", "hi", right, "at", "p").collect()}
    want = {}
    for i, lo, hi in a:
        met = [(at, k) for k, at in p if at and (lo is None or lo <= at) and (hi is None or at <= hi)]
        if met:
            want[i] = (len(met), min(met)[0], max(met)[0], sum(k for _, k in met))
    assert got == want
    assert joins.interval_totals(left, "lo", "hi", right.limit(0), "at", "p").count() == 0


def plain_differences(a, b, path=""):
    if type(a) is not type(b):
        return [path or "$"]
    if isinstance(a, dict):
        out = []
        for k in sorted(set(a) | set(b)):
            at = f"{path}.{k}" if path else k
            out += plain_differences(a[k], b[k], at) if k in a and k in b else [at]
        return out
    if isinstance(a, list):
        if len(a) != len(b):
            return [path or "$"]
        return [x for i, (u, v) in enumerate(zip(a, b)) for x in plain_differences(u, v, f"{path}[{i}]")]
    return [] if a == b else [path or "$"]


def test_differences_of_random_values(spark):
    r = random.Random(8)

    def value(depth):
        kind = r.randint(0, 5 if depth else 3)
        if kind > 3:
            return {k: value(depth - 1) for k in r.sample("abcd", r.randint(0, 3))} if kind == 4 else [value(depth - 1) for _ in range(r.randint(0, 3))]
        return [None, True, r.randint(0, 2), r.choice(["x", "y.z", 1.5])][kind]

    def changed(x):
        if r.random() < 0.12:
            return value(2)
        if isinstance(x, dict):
            return {k: changed(v) for k, v in x.items() if r.random() > 0.05}
        return [changed(v) for v in x] if isinstance(x, list) else x

    rows = [(i, x, changed(x)) for i, x in enumerate({"a": value(3), "b": [value(3), value(2)]} for _ in range(150))]
    frame = lambda at: spark.createDataFrame([(x[0], json.dumps(x[at])) for x in rows], "k int, j string")
    got = sorted((x.k, x.path) for x in nested.differences(frame(1), frame(2), "k", "j").collect())
    assert got == sorted((i, p) for i, a, b in rows for p in plain_differences(a, b))
    left = [(i, p) for i, p in got if not p.endswith("a")]
    assert sorted((x.k, x.path) for x in nested.differences(frame(1), frame(2), "k", "j", ["a"]).collect()) == left


def test_references_at_any_depth(spark):
    df = spark.createDataFrame([(1, '{"a":[{"source_id":"s1"},{"more":{"source_id":["s2","s9"]}}],"source_id":3}'), (2, '{"x":1}'), (3, "{broken"), (4, None), (5, '{"source_id":"s1"}')], "k int, j string")
    told, unknown = nested.references_exist(df, "k", "j", ["source_id"], spark.createDataFrame([("s1",), ("s2",)], "id string"), "id")
    assert sorted(map(tuple, told.collect())) == [(1, 3, False), (2, 0, False), (3, 0, False), (4, 0, False), (5, 1, True)]
    assert [tuple(x) for x in unknown.collect()] == [(1, "a[1].more.source_id[1]", "s9")]


def test_line_numbers_of_a_file_of_several_splits(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("s", T.StructType([T.StructField("t", T.ArrayType(T.StringType(), False), False)]))])
    lines, want = [], {}
    for n in range(1, 801):
        bad = {7: ('{"a": 1, "s": {"t": ["x", 2]}}', "invalid field: s.t[1]"), 11: ('{"a": 1, "s": {"u": 1, "t": []}}', "unknown field: s.u"), 13: ("[]", "not an object"), 17: ('{"a": 99999999999999999999}', "invalid field: a")}.get(n % 19)
        lines.append("" if n % 5 == 0 else bad[0] if bad else '{"a": %d, "s": {"t": ["x"]}}' % n)
        if bad and n % 5:
            want[n] = bad[1]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        good, bad = sources.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema)
        assert spark.read.text(f"file://{tmp_path}/x.jsonl").rdd.getNumPartitions() > 5
        assert {x.line: x.reason for x in bad.collect()} == want
        assert good.count() == sum(bool(x) for x in lines) - len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_as_substrings_in_parts(spark):
    r = random.Random(1)
    ids = sorted({"".join(r.choice("ab1") for _ in range(r.randint(1, 5))) for _ in range(60)})
    texts = [(i, "".join(r.choice("ab12 ") for _ in range(r.randint(0, 40)))) for i in range(80)] + [(900, None), (901, "")]
    df, known = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame([(x,) for x in [*ids, "", None, ids[0]]], "id string")
    want = sorted((k, x) for k, t in texts for x in ids if x in (t or ""))
    for most in (1 << 20, 200):
        assert sorted(map(tuple, corpus.find_ids(df, "k", "t", known, "id", most).collect())) == want


def test_run_folders(spark, tmp_path):
    def put(run, name, text):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text)

    put("r1", "run_metadata.json", '{"architecture": "B", "status": "success", "usage": {"total_tokens": 7}}')
    put("r1", "parsed_report.json", "{}")
    put("r2", "run_metadata.json", '{"run_id": "two", "architecture": "C", "status": "failed"}')
    put("r2", "validation_error.json", '{"errors": [1, 2, 3]}')
    put("r3", "json_parse_error.json", "{}")
    put("r4", "run_metadata.json", "nope")
    folders = sources.read_folders(spark, f"file://{tmp_path}/*/*.json", runs.RUN_FILES)
    told, warned = runs.runs_of_folders(folders)
    assert sorted((x.run, x.json_success, x.schema_success, x.n_validation_errors, x.total_tokens) for x in told.collect()) == [("r1", True, True, 0, 7), ("two", True, False, 3, None)]
    assert sorted(map(tuple, warned.collect())) == [("r3", "run_metadata.json", "missing"), ("r4", "run_metadata.json", "unreadable")]


def test_pairs_are_told_as_before_and_no_wide_row_is_shuffled(spark):
    from weftline.plans import roles

    d = "/root/testdata/sf0.001"
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got, want = roles.pairs(spark, d), roles.told(spark, d, roles.met(spark, d))
        assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") <= 5 < want._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")
        assert got.select(*got.columns).exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_match_solutions_scores_texts_that_are_alike_once(spark, monkeypatch):
    from weftline.operators import matching

    q = spark.createDataFrame([(i, ["red ring", "red bolt", None, "ring of red"][i % 4]) for i in range(200)], "q int, text string")
    c = spark.createDataFrame([(i, ["red ring", "bolt", "red red plate"][i % 3], 300 - i) for i in range(150)], "s int, content string, place int")
    seen, split = [], matching.split_join
    monkeypatch.setattr(matching, "split_join", lambda *a, **k: seen.append(split(*a, **k)) or seen[-1])
    rows = matching.match_solutions(q, c, "q", "text", "s", "content", k=4).collect()
    got = {}
    for r in rows:
        got.setdefault(r.q, []).append((r["rank"], r.s, tuple(r.matched)))
    ring, bolt, plate = ([s for s, content, _ in sorted(c.collect(), key=lambda x: x[2]) if content == t] for t in ("red ring", "bolt", "red red plate"))
    for i in range(200):
        first = [] if i % 4 == 2 else bolt[:4] if i % 4 == 1 else ring[:4]
        assert [s for _, s, _ in sorted(got.get(i, []))] == first and plate
    assert seen[0].count() < 20  # pairs of texts, where pairs of rows are thousands


@pytest.mark.parametrize("rows", [3, 1000])
def test_cosine_topk_scores_a_few_queries_at_a_time(spark, monkeypatch, rows):
    from weftline.operators import vectors

    r = random.Random(6)
    data = [(i, [float(r.randint(-2, 2)) for _ in range(3)] + [1.0]) for i in range(90)]
    df = spark.createDataFrame(data, "k long, v array<double>")
    monkeypatch.setattr(vectors, "SCORES", rows * 40)
    got = {}
    for x in vectors.cosine_topk(df, df.where("k < 20"), "k", "v", 5, part=40).collect():
        got.setdefault(x.query_id, []).append((-x.score, x.k))
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for i, v in data[:20]:
        want = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 8), k) for k, w in data)[:5]
        assert [x for x, _ in sorted(got[i])] == pytest.approx([x for x, _ in want])


def test_reports_that_are_equal_are_not_parsed_and_only_named_nodes_leave_a_task(spark):
    same = [(i, '{"a": [1, {"source_id": "s1"}]}') for i in range(50)]
    a, b = spark.createDataFrame([*same, (90, '{"a": {"b": 1}, "c.d": 1}')], "k int, j string"), spark.createDataFrame([*same, (90, '{"a": {"b": 2}, "c.d": 1, "c": {"d": 2}}')], "k int, j string")
    got = nested.differences(a, b, "k", "j")
    assert sorted((x.k, x.path, x.change) for x in got.collect()) == [(90, "a.b", "value"), (90, "c", "added")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # nodes of either side were rows before
    odd = spark.createDataFrame([(1, '{"source\\u005fid": "s1"}'), (2, '{"x": "source_id"}'), (3, '{"source_id": ["s1", "s9", 4]}'), (4, None)], "k int, j string")
    told, unknown = nested.reference_counts(odd, "k", "j", ["source_id"], spark.createDataFrame([("s1",)], "id string"), "id")
    assert sorted((x.k, x.n_references, x.passed, x.n_unknown, x.first_path) for x in told.collect()) == [(1, 1, True, 0, None), (2, 0, False, 0, None), (3, 2, False, 1, "source_id[1]"), (4, 0, False, 0, None)]
    assert [(x.k, x.path, x.id) for x in unknown.collect()] == [(3, "source_id[1]", "s9")]
    assert {x.path for x in nested.named(odd, "k", "j", ["source_id"]).collect()} == {"source_id", "source_id[0]", "source_id[1]", "source_id[2]"}


def test_split_join_sends_no_side_whole_through_the_driver(spark):
    a, b = spark.range(1000).selectExpr("id AS i", "id % 7 AS k"), spark.range(1000).selectExpr("id AS j", "id % 7 AS k")
    plan = joins.split_join(a, b, "k", ["i"], ["j"])
    physical = plan._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [k" in physical and plan.count() == sum(len(range(i, 1000, 7)) ** 2 for i in range(7))


def test_statuses_that_decide_alike_are_one_class(spark):
    from weftline.operators import eligibility

    x = spark.createDataFrame([("draft",), ("deprecated",), ("expired",), ("approved",), ("else",), (None,)], "status string")
    assert [r.c for r in x.select(eligibility.status_class().alias("c")).collect()] == ["other", "expired", "expired", "approved", "other", None]


def test_folders_are_read_from_their_root_at_any_depth(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / f"run={run}" / "name=x.json").mkdir(parents=True)
        (tmp_path / f"run={run}" / "name=x.json" / "part-0.txt").write_text(f'{{"r": "{run}"}}')
    got = sources.read_folders(spark, str(tmp_path), ["x.json", "y.json"], r"run=([^/]+)/name=([^/]+)/[^/]+$")
    assert sorted(map(tuple, got.select("folder", "x", "y").collect())) == [("a", '{"r": "a"}', None), ("b", '{"r": "b"}', None)]


@pytest.mark.parametrize("few", [True, False])
def test_dated_pairs_and_totals_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "PIECE", 3)
    if not few:  # as with large tables
        monkeypatch.setattr(joins, "BROADCAST_IDS", 0)
        monkeypatch.setattr(joins, "BROADCAST_PAIRS", 0)
        monkeypatch.setattr(joins.split_join, "__defaults__", (5, 2))
    r, day = random.Random(5), lambda n: datetime.date(1999, 12, 1) + datetime.timedelta(n)
    q = [(i, r.choice("ab"), r.choice([None, day(r.randint(0, 60))])) for i in range(40)] + [(None, "a", day(9)), (None, "a", day(9)), (7, "b", day(9)), (90, "none", day(9))]
    c = [(i, r.choice("xyz"), r.choice([None, day(r.randint(-9, 70))]), r.choice([None, day(r.randint(-9, 70))])) for i in range(60)] + [(None, "x", None, None), (5, "x", day(9), day(9)), (6, "x", day(9), day(8))]
    c = [(i, k, f"g{k in 'xy'}", lo, hi) for i, k, lo, hi in c]
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "none")]
    queries, documents = spark.createDataFrame(q, "q int, qc string, at date"), spark.createDataFrame(c, "d int, dc string, g string, lo date, hi date")
    allowed = spark.createDataFrame(pairs, "qc string, dc string")
    want = [(i, a, at, k, g) for i, a, at in q for k, b, g, lo, hi in c if (a, b) in pairs and (at is None or ((lo is None or lo <= at) and (hi is None or at <= hi)))]
    by = lambda x: tuple((v is None, v) for v in x)
    got = joins.dated_pairs(queries, documents, allowed, "at", "lo", "hi", "q", "d")
    assert sorted(((x.q, x.d) for x in got.collect()), key=by) == sorted(((i, k) for i, _, _, k, _ in want), key=by)
    totals = [((x.q, x.qc, x["at"], x.g), x.n) for x in joins.dated_totals(queries, documents, allowed, "at", "lo", "hi", ["g"]).collect()]
    rows = [(i, a, at, g) for i, a, at in q for g in ("gTrue", "gFalse")]
    counted = [(row, sum(1 for x in want if (x[0], x[1], x[2], x[4]) == row) // rows.count(row)) for row in rows]
    assert sorted(totals, key=lambda x: by(map(str, x[0]))) == sorted(((row, n) for row, n in counted if n), key=lambda x: by(map(str, x[0])))
    assert joins.dated_pairs(queries.limit(0), documents, allowed, "at", "lo", "hi", "q", "d").count() == 0 == joins.dated_totals(queries, documents.limit(0), allowed, "at", "lo", "hi", ["g"]).count()


def test_all_pairs_confusion_makes_no_pair_of_a_case_and_a_chunk(spark, monkeypatch, tmp_path):
    from weftline.plans import scopes

    for name in ("supplier", "part"):
        t, key = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"), {"supplier": "s_suppkey", "part": "p_partkey"}[name]
        # two lots of rows that the rules cannot tell apart
        t.unionByName(t.withColumn(key, F.col(key) + 3 * 5 * 7 * 4 * 9 * 100 * 11 * 13 * 17)).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    made, split = [], joins.split_join
    monkeypatch.setattr(joins, "split_join", lambda *a, **k: made.append(split(*a, **k)) or made[-1])
    rows = scopes.all_pairs_confusion(spark, str(tmp_path)).where("q is null and mode is null and scope_type is null and source is null").collect()
    n_made = [x.count() for x in made]
    made.clear()
    pairs = scopes.eligible_pairs(spark, str(tmp_path))
    n = pairs.count()
    assert rows[0].n_pairs == spark.read.parquet(f"{tmp_path}/supplier.parquet").count() * spark.read.parquet(f"{tmp_path}/part.parquet").count()
    assert max(x.count() for x in made) < n and all(x < rows[0].n_pairs // 4 for x in n_made)


def test_pairwise_confusion_goes_over_all_cases_by_all_chunks(spark):
    from weftline.operators import eligibility
    from weftline.plans import roles, scopes

    d = "/root/testdata/sf0.001"
    every = roles.cases(spark, d).select("q").crossJoin(roles.chunks(spark, d).select("doc", "chunk"))
    label = roles.told(spark, d, every).withColumns(eligibility.effective_label("override_mode"))
    want = eligibility.pairwise(label, F.col("mode")).where("false_exclusion or false_inclusion or conflict")
    got = scopes.pairwise_confusion(spark, d)
    want = want.select(got.columns)
    met = roles.met(spark, d).select("q", "chunk")
    assert want.join(met, ["q", "chunk"], "left_anti").count() > 0  # pairs without a line item
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_folders_are_written_by_tasks_without_sparks_writer(spark, tmp_path, monkeypatch):
    from weftline.plans import modelruns

    wrote = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.text", lambda *a, **k: wrote.append(a))
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.text", lambda *a, **k: wrote.append(a))
    files = spark.createDataFrame([("a", "x.json", "1\né"), ("a", "y.json", ""), ("b c", "x.json", "{}")], "folder string, name string, value string")
    for _ in range(2):  # a task may be tried again
        sources.write_folders(files, f"file://{tmp_path}/runs")
    got = sources.read_folders(spark, f"file://{tmp_path}/runs", ["x.json"])
    assert sorted(map(tuple, got.where("folder = 'a'").collect())) == [("a", "1\né")] and got.count() == 2
    sources.write_folders(files.limit(0), f"file:{tmp_path}/none")
    assert sources.read_folders(spark, f"file:{tmp_path}/none", ["x.json"]).count() == 0
    assert modelruns.run_folders(spark, "/root/testdata/sf0.001").count() > 0 and not wrote
