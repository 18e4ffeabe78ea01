"""Candidate generators and retrieval within classes, against plain statements of the rules."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import candidates, joins, lexical

DOCS = "view string, dc string, unit long, text string"
WORDS = "red blue green fox hen owl".split()


def _plain_bm25(docs, queries, allowed, own):
    """(view, query, unit) -> score, one index a query where own is set."""
    out = {}
    for q, (qc, text) in queries.items():
        for view in {d[0] for d in docs}:
            mine = [d for d in docs if d[0] == view and (qc, d[1]) in allowed]
            base = mine if own else [d for d in docs if d[0] == view]
            bags = {id(d): Counter((d[3] or "").split()) for d in base}
            if not base:
                continue
            avg = max(sum(sum(b.values()) for b in bags.values()) / len(base), 1.0)
            for d in mine:
                bag, score = bags[id(d)], 0.0
                for term, times in Counter(text.split()).items():
                    if bag[term]:
                        df = sum(1 for b in bags.values() if b[term])
                        score += times * math.log(1 + (len(base) - df + 0.5) / (df + 0.5)) * bag[term] * 2.5 / (bag[term] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg))
                if score > 0:
                    out[view, q, d[2]] = round(score, 6)
    return out


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("bound", [None, 0])
def test_bm25_within_classes(spark, monkeypatch, own, bound):
    if bound is not None:  # what is sent to all tasks otherwise is joined by keys that are dealt
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", bound)
        monkeypatch.setattr(lexical, "BROADCAST_PAIRS", bound)
    rnd = random.Random(3)
    docs = [(v, f"d{rnd.randrange(4)}", i, " ".join(rnd.choices(WORDS, k=rnd.randrange(9)))) for v in ("a", "b") for i in range(30)]
    docs += [("a", "d0", 90, None), ("a", "d0", 91, ""), ("b", "d9", 92, "red fox")]
    queries = {i: (f"q{i % 3}", " ".join(rnd.choices(WORDS + ["none"], k=4))) for i in range(7)} | {8: ("q1", ""), 9: ("q7", "red")}
    allowed = {("q0", "d0"), ("q0", "d1"), ("q1", "d2"), ("q2", "d0"), ("q2", "d1"), ("q2", "d2"), ("q2", "d3")}
    q = spark.createDataFrame([(k, c, t) for k, (c, t) in queries.items()], "q long, qc string, text string")
    terms = lexical.query_terms(q, "q", "text").join(q.select("q", "qc"), "q")
    post, size = lexical.view_index(spark.createDataFrame(docs, DOCS), "unit", {"text": 1}, terms)
    got = lexical.bm25_within(post, size, "unit", terms, "q", spark.createDataFrame(list(allowed), "qc string, dc string"), own)
    rows = {(r.view, r.q, r.unit): r.score for r in got.collect()}
    want = _plain_bm25(docs, queries, allowed, own)
    assert rows.keys() == want.keys()
    assert all(abs(rows[k] - want[k]) <= 1.1e-6 for k in want)


def test_bm25_within_empty_tables(spark):
    terms = spark.createDataFrame([], "q long, qc string, term string, times long, pos int")
    post, size = lexical.view_index(spark.createDataFrame([], DOCS), "unit", {"text": 1}, terms)
    for own in (True, False):
        assert lexical.bm25_within(post, size, "unit", terms, "q", spark.createDataFrame([], "qc string, dc string"), own).collect() == []


def test_classes_tell_nulls_from_empty_values(spark):
    rows = [(1, None, None), (2, "", None), (3, None, []), (4, "", []), (5, "a", ["b"]), (6, "a", ["b"]), (7, None, None), (8, "a,b", None)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, a string, b array<string>").select("i", joins.class_of(["a", "b"]).alias("c")).collect()}
    assert got[1] == got[7] and got[5] == got[6] and len(set(got.values())) == 6


def test_class_pairs_open_to_all_pairs(spark):
    rnd = random.Random(5)
    q = [(i, rnd.sample("xyz", rnd.randrange(3))) for i in range(20)]
    docs = [(i, rnd.sample("xyz", rnd.randrange(4))) for i in range(30)]
    left = spark.createDataFrame(q, "q long, asked array<string>").withColumn("qc", joins.class_of(["asked"]))
    right = spark.createDataFrame(docs, "d long, have array<string>").withColumn("dc", joins.class_of(["have"]))
    filters = [joins.Overlap("letters", F.col("asked"), F.col("have"), F.size("asked") > 0, F.size("have") == 0)]
    pairs = joins.class_pairs(left.select("qc", "asked"), right.select("dc", "have"), filters, F.lit(True))
    got = joins.open_classes(pairs, left.select("q", "qc"), right.select("d", "dc"), "q", ["d"]).collect()
    assert sorted((r.q, r.d) for r in got) == sorted((a, b) for a, x in q for b, y in docs if not x or not y or set(x) & set(y))


def _plain_generators(lists, depth):
    """lists: (filter, view, method, q) -> [chunk] by rank; document of a chunk is chunk // 10."""
    out = {}
    for method in ("lexical_v1", "vector_v1"):
        for name, parts in candidates.GENERATORS.items():
            own, opened = {}, {}
            for kind, view in parts:
                place = opened if view == "opened" else own
                place.update({c: i for i, c in enumerate(lists.get((kind, view, method, 1), []), 1)})
            every = own.keys() | opened.keys()
            best = sorted(every, key=lambda c: (min(own.get(c, 10_000), opened.get(c, 10_000)), opened.get(c, 10_000), own.get(c, 10_000), c))
            out[name, method] = best[:depth]
    for name in candidates.GENERATORS:
        source, score = "G4" if name in candidates.FUSED_ALIKE else name, defaultdict(float)
        for method in ("lexical_v1", "vector_v1"):
            for i, c in enumerate(out[source, method], 1):
                score[c] += 1 / (60 + i)
        out[name, "hybrid_v1"] = sorted(score, key=lambda c: (-round(score[c], 8), c // 10, c))[:depth]
    return out


@pytest.mark.parametrize("depth", [4, 50])
def test_generators(spark, depth):
    rnd = random.Random(depth)
    lists = {}
    for kind in ("all", "eligible"):
        for method in ("lexical_v1", "vector_v1"):
            for view in ("chunk", "enriched"):
                lists[kind, view, method, 1] = rnd.sample(range(60), rnd.randrange(3, 12))[:depth]
            lists[kind, "document", method, 1] = rnd.sample(range(6), 4)[:depth]
    rows = [(*k, x if k[1] == "document" else x // 10, None if k[1] == "document" else x, i) for k, v in lists.items() for i, x in enumerate(v, 1)]
    ranked = spark.createDataFrame(rows, "filter string, view string, method string, q long, doc long, chunk long, rank int")
    children = [c for c in range(60) if c % 10 < 3]
    got = candidates.generated(candidates.opened(ranked, spark.createDataFrame([(c // 10, c) for c in children], "doc long, chunk long"), depth), depth)
    for (kind, view, method, q), docs in list(lists.items()):
        if view == "document":
            own = {c: i for i, c in enumerate(lists[kind, "chunk", method, q], 1)}
            opened = [c for doc in docs for c in sorted((c for c in children if c // 10 == doc), key=lambda c: (own.get(c, 10_000), c))]
            lists[kind, "opened", method, q] = opened[:depth]
    have = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        have[r.variant, r.method].append(r.chunk)
    assert dict(have) == _plain_generators(lists, depth)


def test_places_of_expected_items(spark):
    """Chunk 11 stands behind its sibling 10 and an ineligible row; 20 is in the prefiltered list alone; document 3 is found by a chunk."""
    rows = [("G0", 1, 10, "c10", 1, True), ("G0", 5, 50, "c50", 2, False), ("G0", 1, 11, "c11", 3, True), ("G0", 3, 30, "d3", 4, True), ("G1", 2, 20, "c20", 1, True), ("G4", 1, 11, "c11", 2, True)]
    ranked = spark.createDataFrame([(v, "lexical_v1", 1, d, c, i, r, e) for v, d, c, i, r, e in rows], "variant string, method string, q long, doc long, chunk long, item string, rank int, eligible boolean")
    gold = spark.createDataFrame([(1, "c11", 1, 11), (1, "c20", 2, 20), (1, "d3", 3, None), (2, "c11", 1, 11)], "q long, item string, doc long, chunk long")
    x = candidates.item_places(ranked, gold, {"current_rank": "G0", "prefilter_rank": "G1", "enriched_rank": "G2", "dual_rank": "G4"})
    got = {(r.q, r.item): (r.current_rank, r.prefilter_rank, r.enriched_rank, r.dual_rank, r.n_ineligible_ahead, r.sibling_ahead) for r in x.collect()}
    assert got == {(1, "c11"): (3, None, None, 2, 1, True), (1, "c20"): (None, 1, None, None, 1, False), (1, "d3"): (4, None, None, None, 1, False), (2, "c11"): (None, None, None, None, 0, False)}


@pytest.mark.parametrize("small", [False, True])
def test_best_within_classes_and_dates_makes_no_pair_outside_a_task(spark, monkeypatch, small):
    import datetime

    from weftline.operators import vectors, within

    if small:  # as with large tables: several blocks, parts, batches and steps
        monkeypatch.setattr(within, "LEAST", 3)
        monkeypatch.setattr(within, "BLOCK", 4)
        monkeypatch.setattr(within, "COUNTED", 2)
        monkeypatch.setattr(within, "PART", 20)
        monkeypatch.setattr(within, "BROADCAST_TERMS", 0)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rnd, day = random.Random(4), lambda n: datetime.date(1999, 12, 20) + datetime.timedelta(n)
    some = lambda: rnd.choice([None, day(rnd.randrange(30))])
    docs = [(v, i // 3, None if v == "b" else i, f"d{rnd.randrange(4)}", some(), some(), " ".join(rnd.choices(WORDS, k=rnd.randrange(5)))) for v in ("a", "b") for i in range(60)]
    docs += [("a", 90, 270, "d0", None, None, None), ("a", 90, 271, "d0", None, None, "")]
    cases = [(i, f"q{i % 3}", some(), " ".join(rnd.choices(WORDS + ["none"], k=3))) for i in range(13)] + [(20, "q7", day(3), "red"), (21, "q2", None, "")]
    met = {"all": {("q0", "d0"), ("q1", "d2"), ("q2", "d3"), ("q2", "d1")}, "eligible": {("q0", "d0"), ("q0", "d1"), ("q1", "d2"), ("q2", "d0"), ("q2", "d1"), ("q2", "d2")}}
    try:
        units = spark.createDataFrame([(*r, r[6] or "") for r in docs], "view string, doc long, chunk long, dc string, effective_from date, effective_until date, text string, t string")
        q = spark.createDataFrame(cases, "q long, qc string, effective_on date, text string")
        coded = lambda df, c: df.withColumn(c, F.md5(F.col(c).cast("binary")))
        units, q = coded(units, "dc").withColumn("v", vectors.hash_bytes(F.col("t"), "x", 4)), coded(q, "qc").withColumn("v", vectors.hash_bytes(F.col("text"), "y", 4))
        terms = lexical.query_terms(q, "q", "text")
        allowed = {n: within.Allowed(coded(coded(spark.createDataFrame(sorted(p), "qc string, dc string"), "qc"), "dc"), starts=n == "eligible", own=n == "eligible") for n, p in met.items()}
        rows = within.best(within.prepared(units, {"text": 1}, terms), q, terms, allowed, 5, vector=True).collect()
        vector = {(k, t): v for k, df in (("x", units.select("t", vectors.hash_embedding(F.col("t"), "x", 4))), ("y", q.select("text", vectors.hash_embedding(F.col("text"), "y", 4)))) for t, v in df.distinct().collect()}
        none = within.best(within.prepared(units.limit(0), {"text": 1}, terms), q, terms, allowed, 5, vector=True).count()
        nobody = within.best(within.prepared(units, {"text": 1}, terms), q.limit(0), terms.limit(0), allowed, 5, vector=False).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, want = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["filter"], r.view, r.method, r.q].append((round(-r.score, 6), r.doc, -1 if r.chunk is None else r.chunk))
    for name, pairs in met.items():
        for i, qc, on, text in cases:
            for view in ("a", "b"):
                base = [x for x in docs if x[0] == view]
                mine = [x for x in base if (qc, x[3]) in pairs and (on is None or ((name == "all" or x[4] is None or x[4] <= on) and (x[5] is None or on <= x[5])))]
                corpus = mine if name == "eligible" else base
                bags = {id(x): Counter((x[6] or "").split()) for x in corpus}
                avg = max(sum(sum(b.values()) for b in bags.values()) / max(1, len(corpus)), 1.0)
                for x in mine:
                    bag, score, key = bags[id(x)], 0.0, (x[1], -1 if x[2] is None else x[2])
                    for term, times in Counter(text.split()).items():
                        df = sum(1 for b in bags.values() if b[term])
                        score += times * math.log(1 + (len(corpus) - df + 0.5) / (df + 0.5)) * bag[term] * 2.5 / (bag[term] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg)) if bag[term] else 0
                    if score > 0:
                        want[name, view, "lexical_v1", i].append((round(-score, 6), *key))
                    want[name, view, "vector_v1", i].append((round(-sum(a * b for a, b in zip(vector["x", x[6] or ""], vector["y", text])), 6), *key))
    want = {k: sorted(v)[:5] for k, v in want.items()}
    assert got.keys() == want.keys() and none == 0 == nobody
    for k, v in want.items():
        assert [x[1:] for x in got[k]] == [x[1:] for x in v] and all(abs(a[0] - b[0]) <= 2e-6 for a, b in zip(got[k], v))
