"""Product codes and near copies of vectors against plain statements of the same."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import queries, vector_codes, vector_links

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, entries=256, rounds=4):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    v = {i: [math.floor(1024 * float(np.float32(x))) for x in r[1]] for i, r in enumerate(ok)}
    m = len(v[0]) // 4
    order = sorted(v, key=lambda i: (ok[i][0] is None, ok[i][0], v[i]))
    books = [[v[i][p * m : p * m + m] for i in order[:entries]] for p in range(4)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            got = {}
            for i in v:
                x = v[i][p * m : p * m + m]
                got.setdefault(near(x, p)[1], []).append(x)
            new.append([[sum(c) // len(got[j]) for c in zip(*got[j])] if j in got else e for j, e in enumerate(books[p])])
        books = new
    out = []
    for i in v:
        told = [near(v[i][p * m : p * m + m], p) for p in range(4)]
        out.append((ok[i][0], ok[i][2], "".join(f"{j:02x}" for _, j in told), sum(d for d, _ in told)))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries", [256, 5])
def test_codes_against_a_plain_statement(spark, entries):
    r = random.Random(entries)
    rows = [(i, [r.gauss(0, 0.1) for _ in range(8)], r.choice([1, 2, None])) for i in range(90)]
    rows += [(200, rows[3][1], 1), (3, rows[4][1], 2), (None, [0.5] * 8, None), (300, None, 1), (301, [None] + [0.1] * 7, 1), (302, [NAN] + [0.1] * 7, 1), (303, [INF] + [0.1] * 7, 1), (304, [], 1), (305, [0.1] * 4, 1)]
    want, digest = plain_codes([x for x in rows if x[0] not in (304, 305)], entries)
    df = spark.createDataFrame(rows, KIND).withColumn("code", F.lit("clash"))
    ints = vector_codes.integers(df)
    books = vector_codes.fit(ints, entries=entries)
    got = vector_codes.label_errors(vector_codes.encode(ints, books)).collect()
    assert vector_codes.digest(books) == digest
    assert sorted(map(repr, ((g.vec_id, g.label, g.code, g.error) for g in got))) == sorted(map(repr, want))
    for g in got:
        assert g.label_error == sum(e for _, label, _, e in want if label == g.label)


def test_gnat_is_exact_and_leaves_entries_out():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (8, 6))
    points = (centres[r.integers(0, 8, 200)] + r.integers(-60, 60, (200, 6))).astype(np.int64)
    points[50], points[150] = points[7], points[7]  # ties go to the lower index
    q = (centres[r.integers(0, 8, 400)] + r.integers(-90, 90, (400, 6))).astype(np.int64)
    q[:50] = points[:50]
    tree = vector_codes.Gnat(points)
    at, d = tree.nearest(q)
    full = ((q[:, None] - points[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert tree.compared < full.size / 2  # whole subtrees were ruled out
    far = (points + (1 << 26)) * 1  # too large for exact doubles
    assert (vector_codes.squares(far, far[:9]) == ((far[:, None] - far[None, :9]) ** 2).sum(2)).all()


def test_codes_decode_to_the_named_entries(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, [r.random() for _ in range(8)], 0) for i in range(20)], KIND)
    coded, books = vector_codes.compress(df)
    back = {x.vec_id: x.embedding for x in vector_codes.decode(coded, books).collect()}
    for x in vector_codes.integers(df).collect():  # fewer rows than entries: every row is an entry of its own
        assert back[x.vec_id] == [y / 1024 for y in x.ints]


def test_no_vectors(spark):
    none = spark.createDataFrame([], KIND)
    coded, books = vector_codes.compress(none)
    assert coded.count() == 0 and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    assert vector_links.near_copies(none).count() == 0
    got = vector_links.near_copies(spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0), (3, [NAN, 1.0], 0)], KIND)).collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def plain_links(rows, cosine=0.95):
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    up, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok[i] and ok[j] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    up[top(i)] = top(j)
    name = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            name[top(i)] = min(r[0], name.get(top(i), r[0]))
    return sorted(repr((r[0], n[i], name.get(top(i)), r[0] == name.get(top(i)))) for i, r in enumerate(rows))


def vectors(seed, d=24):
    r = np.random.default_rng(seed)
    rows = [r.standard_normal(d) for _ in range(60)]
    one, two = r.standard_normal(d), r.standard_normal(d)
    rows += [one + r.standard_normal(d) * s for s in [0.12] * 50 + [0.25] * 25 + [0.4] * 20]  # a large group, tight and loose
    rows += [one + 0.3 * two + r.standard_normal(d) * 0.12 for _ in range(40)]  # another beside it
    chain = r.standard_normal(d)
    for _ in range(12):  # neighbours link, the ends do not
        chain = chain + r.standard_normal(d) * 0.28
        rows.append(chain)
    out = [(i, [float(x) for x in v], 0) for i, v in enumerate(rows)]
    out += [(500, out[0][1], 1), (501, [2 * x for x in out[0][1]], 1), (None, out[0][1], 2), (7, out[1][1], 1), (900, [0.0] * d, 0), (901, None, 0), (902, [None] * d, 0), (903, [1.0, 2.0], 0), (904, [2.0, 4.1], 0), (905, [], 0)]
    return out


@pytest.mark.parametrize("chunk", [16, 4096])
def test_links_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_links, "BATCH", 32)
    rows = vectors(chunk)
    df = spark.createDataFrame(rows, KIND).withColumn("n_links", F.lit("clash"))
    got = vector_links.near_copies(df, width=6, chunk=chunk).collect()
    assert sorted(repr(tuple(g)) for g in got) == plain_links(rows)


def test_large_groups_are_cliques_and_budgets_hold():
    r = np.random.default_rng(5)
    one = r.standard_normal(24)
    group = one + r.standard_normal((300, 24)) * 0.1
    group /= np.linalg.norm(group, axis=1, keepdims=True)
    plan = vector_links.Plan(group, 300, 0.95, 6, 4096)
    own, _ = plan.clique(group)
    assert len(plan.centres) == 1 and (own == 0).mean() > 0.9
    assert (group[own == 0] @ group[own == 0].T >= 0.95).all()
    # a pair at the threshold is within the budget of some block
    for _ in range(200):
        a, b = r.standard_normal((2, 24))
        a, b = a / np.linalg.norm(a), b - (b @ a) * a / (a @ a)
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)
        g = plan.grid(np.stack([a, b]))
        assert any(((g[0, s] - g[1, s]) ** 2).sum() <= m for s, m in zip(plan.blocks, plan.budgets))


def test_registered_vector_queries(spark, tmp_path):
    spark.createDataFrame(vectors(1, 8), KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    codes = queries.op11_vector_codes(spark, str(tmp_path))
    assert codes.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    links = queries.op12_vector_links(spark, str(tmp_path))
    assert links.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert links.count() == len(vectors(1, 8))
