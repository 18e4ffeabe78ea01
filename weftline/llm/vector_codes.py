"""Product codes of vectors: equal parts, a codebook for each, nearest entries found by a GNAT over the entries.

Components become integers floor(1024 * x), so all distances and sums are exact. Codebooks start as the parts of the rows with
the least ids; in each round every part goes to its nearest entry and each entry becomes the floor of the mean of its
parts. Tasks sum their parts by entry; what meets is a row for each entry and task, and the driver gets one for each entry.

Nearest entries: a geometric near-neighbour access tree (GNAT) stands over the entries of each part. A node has split points;
every other entry below it belongs to the nearest split point's subtree, and each pair of a split point and a subtree has the
range of distances between them. A query's distances to the split points rule a subtree out if some range is farther from
the query's own distance than the nearest entry so far: strictly, with all roots and differences rounded outwards, so no
nearest entry is lost to rounding. Whatever is reached is compared in integers, ties going to the lower index.

Dropped: rows whose vector is null, empty or holds null or non-finite components, and those whose length is not the commonest
one (of equally common ones the least) or no multiple of the number of parts. Integers beyond 2**26 in size count as 2**26, as
sums would not fit otherwise. Rows may repeat and each has its code; a null id comes last in the order of ids, equal
ids go by their vectors. Fewer rows than entries make a shorter codebook. An empty table gives an empty table. Extra columns do not pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable
from .components import _spread
from .memory import tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of an integer component.
MOST = 1 << 26
#: Split points of a node, and entries of a leaf.
FAN, LEAF = 8, 8


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of q from all of p, as int64."""
    size = max(int(np.abs(q).max(initial=0)), int(np.abs(p).max(initial=0)))
    if 4 * size * size * max(1, q.shape[1]) < 1 << 53:  # then every number below is an integer that a double holds
        a, b = q.astype(np.float64), p.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(q), len(p)), np.int64)
    for j in range(len(p)):
        d = q - p[j]
        out[:, j] = (d * d).sum(1)
    return out


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


class Gnat:
    """The tree over points (int64, a row each); nearest() gives each query's nearest point and squared distance."""

    def __init__(self, points: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        self.points, self.fan, self.leaf = points, fan, leaf
        self.compared = 0  # distances taken so far
        self.root = self._node(np.arange(len(points)))

    def _node(self, own: np.ndarray) -> dict:
        if len(own) <= self.leaf:
            return {"at": own, "below": []}
        # split points far from each other: each the farthest from those before it
        at, far = [0], squares(self.points[own], self.points[own[:1]])[:, 0]
        while len(at) < self.fan:
            at.append(int(far.argmax()))
            far = np.minimum(far, squares(self.points[own], self.points[own[at[-1:]]])[:, 0])
        at = sorted(set(at))  # fewer if points are equal
        rest = np.delete(own, at)
        d = squares(self.points[rest], self.points[own[at]])
        nearest, below = d.argmin(1), []
        for i in range(len(at)):
            members = nearest == i
            if members.any():
                root = np.sqrt(d[members].astype(np.float64))
                below.append((i, _below(root.min(0)), _above(root.max(0)), self._node(rest[members])))
        return {"at": own[at], "below": below}

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, least = np.full(len(queries), -1, np.int64), np.full(len(queries), np.iinfo(np.int64).max)

        def visit(node: dict, rows: np.ndarray) -> None:
            d = squares(queries[rows], self.points[node["at"]])
            self.compared += d.size
            first = d.argmin(1)  # the lowest index of equal ones, as split points and leaves are in ascending order
            index, value = node["at"][first], d[np.arange(len(rows)), first]
            closer = (value < least[rows]) | (value == least[rows]) & (index < best[rows])
            best[rows[closer]], least[rows[closer]] = index[closer], value[closer]
            if not node["below"]:
                return
            root = np.sqrt(d.astype(np.float64))
            low, high = _below(root), _above(root)
            for home in (True, False):  # the nearest split point's subtree first, as it makes the others' bound tight
                for i, least_d, most_d, child in node["below"]:
                    pick = np.flatnonzero((first == i) == home)
                    bound = _above(np.sqrt(least[rows[pick]].astype(np.float64)))[:, None]
                    out = (_below(low[pick] - most_d) > bound) | (_below(least_d - high[pick]) > bound)
                    pick = pick[~out.any(1)]
                    if len(pick):
                        visit(child, rows[pick])

        if len(queries) and len(self.points):
            visit(self.root, np.arange(len(queries)))
        return best, least


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, label, ints array<long>: the rows that have a code."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    floors = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * SCALE))).cast("long"))
    kept = vectors.where(whole).select(F.col(id_col).alias("vec_id"), label.alias("label"), floors.alias("ints"))
    common = kept.where(F.size("ints") > 0).groupBy(F.size("ints").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    size = common[0]["size"] if common else 0
    return kept.where((F.size("ints") == size) & F.lit(size > 0 and size % parts == 0))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows x parts x components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _summing(trees, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, width = len(trees.value[0].points), trees.value[0].points.shape[1]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), parts)
            for p in range(parts):
                best, _ = trees.value[p].nearest(rows[:, p])
                n[p] += np.bincount(best, minlength=entries)
                np.add.at(sums[p], best, rows[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part (entries x components) after rounds over all rows of integers()."""
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # a top-k
    if not first:
        return [np.zeros((0, 0), np.int64) for _ in range(parts)]
    start = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, -1)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Gnat(b) for b in books])  # as large as the codebooks
        sums = rows.select("ints").mapInArrow(tidy(_summing(trees, parts)), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(start.shape[2])]).alias("sums"))
        for r in total.collect():  # a row for each entry at most
            books[r.part][r.entry] = [x // r.n for x in r.sums]
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance from the entries), of integers()."""
    parts = len(books)
    kinds = dict(rows.dtypes)
    if max(len(b) for b in books) > 256:
        raise ValueError("two hex digits hold 256 entries")
    trees = rows.sparkSession.sparkContext.broadcast([Gnat(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column("ints"), parts)
            got = [trees.value[p].nearest(found[:, p]) for p in range(parts)]
            code = [bytes(x).hex() for x in np.stack([best for best, _ in got], 1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in got))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(tidy(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, embedding array<double>: the vector of the entries that a code names."""
    entries = np.concatenate([b[:, None, :] for b in books], 1) if len({len(b) for b in books}) == 1 else None
    if entries is None:
        raise ValueError("codebooks differ in size")
    shared = coded.sparkSession.sparkContext.broadcast(entries / SCALE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([list(bytes.fromhex(x)) for x in batch.column("code").to_pylist()], np.int64).reshape(-1, len(books))
            rows = shared.value[at, np.arange(len(books))].reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(rows), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return coded.select("vec_id", "code").mapInArrow(tidy(run), f"vec_id {dict(coded.dtypes)['vec_id']}, embedding array<double>")


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for b in books for x in b.ravel().tolist())


def label_errors(coded: DataFrame) -> DataFrame:
    """coded (a written table) and label_error, the sum of the errors of its label; nulls are one label."""
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = coded.withColumn("_key", key)
    sums = durable(keyed.groupBy("_key").agg(F.sum("error").alias("label_error")), "label-errors")
    return _spread(keyed, sums, "_key", "left").drop("_key")


def compress(vectors: DataFrame, label_col: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """The rows of encode() with label_error, and the codebooks they refer to."""
    rows = integers(vectors, label_col=label_col)
    books = fit(rows)
    return label_errors(durable(encode(rows, books), "codes")), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
