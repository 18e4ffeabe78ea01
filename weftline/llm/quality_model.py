"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits (case kept) and runs of other visible characters. Features are hashed tokens and
pairs of neighbours, and two features that say how often n-grams repeat within the text; values are counts over the root of
the number of all of them. Training goes through a bounded
sample of labelled rows in one task, in the order of a hash of the id, a few times (FTRL-proximal: per-coordinate rates,
L1 and L2). Scores are sparse dot products over whole texts, then the logistic function.

Null and empty texts have no features and get the bias alone. With no labelled rows every score is 0.5. With repeated labels of one
document, the least counts. Rows that repeat each give a row. Texts of equal score are told apart by nothing; very long texts are
scored whole, in a block of their own. Only doc_id, text and the label are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, rows_of
from .words import blocks, grams, mix

#: log2 of the number of weights.
LOG_DIM = 18
THRESHOLD = 0.3
#: Tokens of a run that counts as repeated, and the hashes that stand for repetition.
REPEAT = 4
TWICE, AGAIN = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 letters, digits and beyond ASCII, 2 other
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Tokens:
    """Token hashes of a block of texts: `at[i]:at[i+1]` are those of text i."""

    def __init__(self, raw: list[bytes]):
        from .words import _tables

        arr = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = _KIND[arr]
        change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
        lo, hi = change[:-1], change[1:]
        real = kind[lo] > 0
        lo, hi = lo[real], hi[real]
        up, down = _tables(len(arr))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * up)])
        self.hash = mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))
        self.at = np.concatenate([[0], np.searchsorted(lo, np.cumsum([len(x) + 1 for x in raw]))])


def features(t: Tokens, log_dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every n-gram of the block, and of every n-gram that repeats: a token like the one before it has the
    feature TWICE, REPEAT tokens that stood in the text before have the feature AGAIN, whatever the tokens are."""
    own = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))
    pairs = grams(t.hash, 2)
    inside = own[1:] == own[:-1] if len(own) else np.zeros(0, bool)
    again = np.zeros(0, np.int64)
    runs = grams(t.hash, REPEAT)
    if len(runs):
        whole = np.flatnonzero(own[: len(runs)] == own[REPEAT - 1 :])
        _, first = np.unique(runs[whole] ^ mix(own[whole].astype(np.uint64) + np.uint64(1)), return_index=True)
        again = np.delete(own[whole], first)
    twice = own[1:][inside & (t.hash[1:] == t.hash[:-1])] if len(own) > 1 else own[:0]
    kinds = [t.hash, pairs[inside] if len(own) > 1 else pairs[:0], np.full(len(twice), TWICE), np.full(len(again), AGAIN)]
    texts = [own, own[1:][inside] if len(own) > 1 else own[:0], twice, again]
    return (np.concatenate(kinds) >> np.uint64(64 - log_dim)).astype(np.int64), np.concatenate(texts)


class Model:
    def __init__(self, log_dim: int, weights: np.ndarray, bias: float):
        self.log_dim, self.weights, self.bias = log_dim, weights.astype(np.float32), bias


def _train(rows: pd.DataFrame, log_dim: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    size = 1 << log_dim
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    docs = []
    for text in rows["text"]:
        t = Tokens([(text or "").encode()])
        f, _ = features(t, log_dim)
        u, c = np.unique(f, return_counts=True)
        docs.append((np.append(u, size), np.append(c / np.sqrt(max(1, len(f))), 1.0)))
    y = rows["label"].to_numpy(np.float64)

    def weight(at: np.ndarray) -> np.ndarray:
        free = at == size  # the bias is not regularised
        pull = np.where(free, 0.0, l1)
        return np.where(np.abs(z[at]) <= pull, 0.0, (np.sign(z[at]) * pull - z[at]) / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0.0, l2)))

    for _ in range(epochs):
        for (at, x), label in zip(docs, y, strict=True):
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(size + 1))
    return w[:size], float(w[size])


def fit(texts: DataFrame, labels: DataFrame, per_label: int = 2500, log_dim: int = LOG_DIM, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """texts: doc_id, text; labels: doc_id, label (0 or 1). At most per_label sampled rows of each label are learned from, in one task."""
    chosen = bounded_sample(labels.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", "label", per_label)
    if not chosen:
        return Model(log_dim, np.zeros(1 << log_dim), 0.0)
    rows = rows_of(texts.select("doc_id", "text"), "doc_id", chosen, "label", "int").dropDuplicates(["doc_id"])
    rows = rows.withColumn("order", F.xxhash64("doc_id", F.lit("order")))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = _train(pdf.sort_values(["order", "doc_id"]), log_dim, epochs, alpha, beta, l1, l2)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "b": [b]})

    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "w binary, b double").first()
    return Model(log_dim, np.frombuffer(got.w, np.float32), got.b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**log_dim weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, raw in blocks(batch.column(1).to_pylist()):
                f, own = features(Tokens(raw), m.log_dim)
                total = np.bincount(own, m.weights[f], minlength=len(raw)) / np.sqrt(np.maximum(1, np.bincount(own, minlength=len(raw))))
                p = 1 / (1 + np.exp(-np.clip(total + m.bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **limits) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold)."""
    return score(docs, fit(texts, labels, **limits)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
