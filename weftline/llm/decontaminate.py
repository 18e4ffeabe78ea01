"""Benchmark decontamination by winnowing.

Fingerprints are the least hash of K consecutive words in each run of WINDOW - K + 1 such hashes, so any WINDOW
words that a document shares with an item leave a fingerprint in both. Fingerprints of documents that a bounded
membership filter lets through are joined with those of the items on the hash; each match carries the words
around it, is checked word by word and extended to both sides. Where WINDOW words or more agree, the agreeing words
are hit. Items of fewer than WINDOW words are one window: every run of that many words of a document is a candidate.

Null and empty texts have no words: n_words 0, not contaminated. An item without words never occurs. Rows that
repeat a doc_id count as one document with the hits of all of them and the largest n_words; items that repeat
an item_id likewise. Only ids and texts are read, so extra columns cannot clash. With an empty benchmark, or
one without words, nothing is hit. No text is cut short and no match is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitset
from .memory import small_batches, tidy
from .words import ALNUM, Words, blocks, grams

WINDOW, K = 10, 5


def _winnowed(h: np.ndarray, run: int) -> np.ndarray:
    """Positions of the last least hash of each `run` consecutive ones."""
    n = len(h) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, run):
        less = h[j : j + n] <= low
        low = np.where(less, h[j : j + n], low)
        at[less] = j
    return np.unique(np.arange(n) + at)


def _prints(w: Words, i: int, kinds: list[int], k: int, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, positions, hashes) of text i. Kind 0: winnowed k-grams; kind n: all runs of n words."""
    h = w.hash[w.at[i] : w.at[i + 1]]
    for kind in kinds:
        g = grams(h, kind or k)
        at = np.arange(len(g)) if kind else _winnowed(g, window - k + 1)
        if len(at):
            yield kind, at, g[at] ^ np.uint64(kind)


def _item_prints(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for first, raw in blocks(batch.column(1).to_pylist()):
                w = Words(raw, ALNUM)
                for i in range(len(raw)):
                    lo, n = int(w.at[i]), int(w.at[i + 1] - w.at[i])
                    if not n:
                        continue
                    item = batch.column(0)[first + i].as_py()
                    kind = n if n < window else 0
                    for _, at, h in _prints(w, i, [kind], k, window):
                        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                            out.append((item, kind, x, *_context(w, lo, n, p, kind or k, window)))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *[pa.array(c, pa.list_(pa.string())) for c in cols[3:]]], names=["item_id", "kind", "h", "left", "mid", "right"])

    return run


def _context(w: Words, lo: int, n: int, p: int, k: int, window: int) -> tuple[list[str], list[str], list[str]]:
    """The words before (nearest first), in and after a match; as many as a window round it can have."""
    word = lambda j: w.word(lo + j).decode("utf-8", "replace")
    side = max(0, window - k) if k <= window else 0
    return [word(j) for j in range(p - 1, max(-1, p - 1 - side), -1)], [word(j) for j in range(p, p + k)], [word(j) for j in range(p + k, min(n, p + k + side))]


def _doc_prints(kinds: list[int], table, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        match = pa.list_(pa.struct([("kind", pa.int32()), ("h", pa.int64()), ("p", pa.int32()), ("left", pa.list_(pa.string())), ("mid", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        for batch in batches:
            for first, raw in blocks(batch.column(1).to_pylist()):
                w = Words(raw, ALNUM)
                count = np.diff(w.at)
                found: list = [[] for _ in raw]
                for kind in kinds:  # over the whole block, then by text
                    g = grams(w.hash, kind or k)
                    if not len(g):
                        continue
                    maybe = np.flatnonzero(bitset.probe(known, g ^ np.uint64(kind)))
                    for i in np.unique(np.searchsorted(w.at, maybe, side="right") - 1):
                        lo, n = int(w.at[i]), int(count[i])
                        for _, at, h in _prints(w, i, [kind], k, window):
                            for j in np.flatnonzero(bitset.probe(known, h)):
                                p = int(at[j])
                                left, mid, right = _context(w, lo, n, p, kind or k, window)
                                found[i].append({"kind": kind, "h": int(h[j : j + 1].view(np.int64)[0]), "p": p, "left": left, "mid": mid, "right": right})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(count, pa.int64()), pa.array(found, match)], names=["doc_id", "n_words", "found"])

    return run


def _agreeing(a: str, b: str):
    """How many leading words two lists share."""
    n = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i) != F.get(b, i))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(unlike, 0), n))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_words, each row once; hits: doc_id, item_id, start, stop in words, for every agreeing run)."""
    spark = docs.sparkSession
    small_batches(spark)
    item_type = dict(benchmark.dtypes)["item_id"]
    doc_type = dict(docs.dtypes)["doc_id"]
    lists = "left array<string>, mid array<string>, right array<string>"
    from ..shared import durable

    items = durable(benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_prints(k, window), f"item_id {item_type}, kind int, h long, {lists}").distinct(), "benchmark-prints")
    kinds = sorted(r.kind for r in items.select("kind").distinct().collect())  # at most `window` values
    table = spark.sparkContext.broadcast(bitset.build(items.select("h").distinct(), "h"))
    found = durable(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(_doc_prints(kinds, table, k, window)), f"doc_id {doc_type}, n_words long, found array<struct<kind int, h long, p int, left array<string>, mid array<string>, right array<string>>>"), "document-prints")
    # items that share a fingerprint and its surroundings are met once, and told apart after the match
    near = items.select("kind", "h", F.col("left").alias("l"), F.col("mid").alias("m"), F.col("right").alias("r")).distinct()
    d = found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").distinct()
    met = d.join(near, ["kind", "h"]).where(F.col("mid") == F.col("m"))
    met = met.withColumn("before", _agreeing("left", "l")).withColumn("after", _agreeing("right", "r")).where((F.col("kind") > 0) | (F.col("before") + F.col("after") + k >= window))
    span = met.select("doc_id", "kind", "h", "l", "m", "r", (F.col("p") - F.col("before") * (F.col("kind") == 0).cast("int")).alias("start"), F.when(F.col("kind") > 0, F.col("p") + F.col("kind")).otherwise(F.col("p") + k + F.col("after")).alias("stop"))
    names = items.select("item_id", "kind", "h", F.col("left").alias("l"), F.col("mid").alias("m"), F.col("right").alias("r"))
    hits = span.join(names, ["kind", "h", "l", "m", "r"]).select("doc_id", "item_id", "start", "stop")
    return found.select("doc_id", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items array<string>, contaminated; one row a doc_id."""
    seen, hits = matches(docs, benchmark, window, k)
    # agreeing runs joined into stretches: a run that starts beyond all earlier ends opens one
    by_start = Window.partitionBy("doc_id").orderBy("start", "stop")
    runs = hits.select("doc_id", "start", "stop").distinct()
    runs = runs.withColumn("reach", F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = runs.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    items = hits.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    docs_once = seen.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    # one more aggregation in place of outer joins, so that a null id meets its own hits
    wide = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>")]
    parts = [t.select("doc_id", *[(F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wide]) for t in (docs_once, hit, items)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc_id").agg(*[F.max(c).alias(c) for c, _ in wide])
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
