"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows. Terms are lower-cased words, and all of them count: document
frequencies are counted over all documents, and the norm of a text is taken over all of its terms, known to the examples
or not. The index holds every term of the examples. The `DENSE` commonest stand in blocks of examples with the largest
weight of each term in a block, the others as sparse postings, which are summed first; a block is opened for a document
only if its best sum of rare terms and its products of query weight and block maximum could still reach the document's
k-th best, so the neighbours are the exact ones. What is dense and what is sparse only steers the work.

Neighbours do not depend on the document's norm. Terms that neither the examples hold nor are among the `COMMON` commonest
of the corpus get their document frequency by a join on the term's hash; only they are shuffled.

Votes are taken among the examples of each label apart, as labels are of very unequal numbers: for each size in `rings`, the
mean cosine of so many nearest examples of the label (a text's distance-weighted vote), and the mean cosine of all its
examples. The calibration is a logistic curve over these votes, fitted on the examples themselves, each left out of its own
neighbours, weighted to the labels' shares in all labelled rows. Evidence is the ids of the k nearest examples of either label with
their cosines. `power` is the exponent of the inverse document frequency.

Null and empty texts, and texts without a term, have no neighbour and get the curve's value at no votes. With no labelled
rows every score is the same and below the threshold. Ties in cosine go to the smaller example id. Rows that repeat each give a row. Only ids, text
and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable
from .memory import tidy
from .sampling import bounded_sample, rows_of
from .words import ALNUM, Words, blocks

THRESHOLD = 0.3
#: Numbers of nearest examples of a label whose mean cosine is a vote.
RINGS = (5, 15, 40, 100, 250, 600)
BLOCK = 64
#: Terms of the examples that are held as dense columns, the commonest first.
DENSE = 512
#: Texts that meet the examples at a time.
CHUNK = 128
#: Terms of the corpus whose document frequency every task holds, the commonest first.
COMMON = 1 << 16


def _counted(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count, place of its first word) for each distinct term of each text, by text and hash."""
    own = np.repeat(np.arange(len(w.at) - 1), np.diff(w.at))
    order = np.lexsort((w.hash, own))
    o, h = own[order], w.hash[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    return o[new], h[new], np.diff(np.append(new, len(h))), order[new]


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether h is in the sorted table, where)."""
    if not len(table):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h, at


class Vocabulary:
    """The examples' terms in order of their hash, to be found by binary search; equal hashes are one term."""

    def __init__(self, h: np.ndarray, terms: list[bytes]):
        self.hash, self.terms = h, terms

    def matrix(self, raw: list[bytes]) -> np.ndarray:
        """Term counts, one row a text, for a few texts."""
        out = np.zeros((len(raw), len(self.hash)), np.int64)
        own, h, n, _ = _counted(Words(raw, ALNUM))
        hit, at = _find(self.hash, h)
        out[own[hit], at[hit]] = n[hit]
        return out


class Postings:
    """Unit rows of one label's examples, the commonest terms dense in blocks of BLOCK with block maxima, the rest sparse by term."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, term: np.ndarray, x: np.ndarray, n_terms: int):
        norm = np.sqrt(np.bincount(own, x * x, len(ids)))
        df = np.bincount(term, minlength=n_terms)
        self.place = np.empty(n_terms, np.int64)
        self.place[np.argsort(-df, kind="stable")] = np.arange(n_terms)
        column = self.place[term]
        # examples of like terms share a block, which keeps block maxima telling
        lead, second = np.full(len(ids), n_terms), np.full(len(ids), n_terms)
        np.minimum.at(lead, own, column)
        later = column > lead[own]
        np.minimum.at(second, own[later], column[later])
        some = np.flatnonzero(norm > 0)  # examples without a term are nobody's neighbour
        self.order = some[np.lexsort((ids[some], second[some], lead[some]))]
        self.ids, m = ids[self.order], len(self.order)
        new = np.full(len(ids), -1)
        new[self.order] = np.arange(m)
        own, column, x = new[own], column, x / np.maximum(norm[own], 1e-300)
        #: sums of the unit rows, by term
        self.total = np.bincount(term[own >= 0], x[own >= 0], n_terms)
        self.n_dense = min(DENSE, n_terms)
        near = (column < self.n_dense) & (own >= 0)
        self.common = np.zeros((self.n_dense, m))
        self.common[column[near], own[near]] = x[near]
        self.cut = np.arange(0, m, BLOCK)
        self.most = np.maximum.reduceat(self.common, self.cut, 1) if m else np.zeros((self.n_dense, 0))
        far = np.flatnonzero((column >= self.n_dense) & (own >= 0))
        far = far[np.lexsort((own[far], column[far]))]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(column[far] - self.n_dense, minlength=n_terms - self.n_dense))]).astype(np.int64)
        self.post, self.post_x = own[far].astype(np.int32), x[far]

    def nearest(self, own: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example positions, products) of the k nearest of n texts with weights x, in order of own; -1 and 0 where there are fewer."""
        at, dot = np.full((n, k), -1, np.int64), np.zeros((n, k))
        if not len(self.ids):
            return at, dot
        ends = np.searchsorted(own, np.arange(0, n + CHUNK, CHUNK))
        for i, lo in enumerate(range(0, n, CHUNK)):
            hi, s = min(n, lo + CHUNK), slice(ends[i], ends[i + 1])
            self._chunk(own[s] - lo, self.place[term[s]], x[s], at[lo:hi], dot[lo:hi], None if leave is None else leave[lo:hi])
        return at, dot

    def _chunk(self, own, column, x, at, dot, leave) -> None:
        n, m, k = len(at), len(self.ids), min(at.shape[1], len(self.ids))
        near = column < self.n_dense
        q = np.zeros((n, self.n_dense))
        q[own[near], column[near]] = x[near]
        # rare terms, summed over all their postings
        r, far, w = column[~near] - self.n_dense, own[~near], x[~near]
        count = self.first[r + 1] - self.first[r]
        e = np.repeat(self.first[r] - np.cumsum(count) + count, count) + np.arange(count.sum())
        sums = np.bincount(np.repeat(far, count) * m + self.post[e], np.repeat(w, count) * self.post_x[e], n * m).astype(np.float64).reshape(n, m)
        if leave is not None:
            out = np.flatnonzero(leave >= 0)
            sums[out, leave[out]] = -np.inf
        bound = np.maximum.reduceat(sums, self.cut, 1) + q @ self.most
        opened = np.full((n, m), -np.inf)

        def enter(which: np.ndarray) -> np.ndarray:
            """Open blocks, one flag a text and block; the k-th best of each text so far."""
            for b in np.flatnonzero(which.any(0)):
                mine, s = np.flatnonzero(which[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                opened[mine, s] = np.round(sums[mine, s] + q[mine] @ self.common[:, s], 12)
            return np.partition(opened, m - k, 1)[:, m - k]

        first = min(k // BLOCK + 2, bound.shape[1] - 1)
        done = bound >= -np.partition(-bound, first, 1)[:, [first]]
        done &= bound > 0
        kth = enter(done)
        kth = enter(~done & (bound > 0) & (bound >= kth[:, None] - 1e-9))
        # the k best in order, equal ones by example id
        by_id = np.argsort(self.ids, kind="stable")
        held = opened[:, by_id]
        if k < m:
            held = np.where(held >= np.maximum(kth, 1e-12)[:, None], held, -np.inf)
        best = np.argsort(-held, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(held, best, 1)
        real = value > 1e-12
        at[:, :k], dot[:, :k] = np.where(real, by_id[best], -1), np.where(real, value, 0.0)


class Index:
    """The examples of label 0 and of label 1, and the curve over their votes."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, entries: tuple, k: int, rings: tuple[int, ...]):
        own, term, n = entries
        self.vocabulary, self.idf, self.k, self.rings = vocabulary, idf, k, rings
        x, self.sides = np.log1p(n) * idf[term], []
        for label in (0, 1):
            mine = np.flatnonzero(labels == label)
            place = np.full(len(ids), -1)
            place[mine] = np.arange(len(mine))
            of = place[own] >= 0
            self.sides.append(Postings(ids[mine], place[own[of]], term[of], x[of], len(idf)))
            self.sides[-1].order = mine[self.sides[-1].order]
        self.ids = np.concatenate([p.ids for p in self.sides])
        self.curve = np.zeros(2 * len(rings) + 3)
        #: hashes and IDF of the commonest terms of the corpus that no example holds
        self.other, self.other_idf = np.zeros(0, np.uint64), np.zeros(0)

    @property
    def rows(self) -> np.ndarray:
        """The unit rows as a matrix over the vocabulary, for a few examples."""
        out = [np.zeros((len(p.ids), len(self.idf))) for p in self.sides]
        for p, o in zip(self.sides, out, strict=True):
            for t, c in enumerate(p.place):
                if c < p.n_dense:
                    o[:, t] = p.common[c]
                else:
                    s = slice(p.first[c - p.n_dense], p.first[c - p.n_dense + 1])
                    o[p.post[s], t] = p.post_x[s]
        return np.concatenate(out)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def votes(self, own, term, n, size: int, leave: list | None = None):
        """(ids, products) of the k nearest (0 where there are fewer); the mean products of each ring and of all, label by label."""
        x, votes, ids, dots = np.log1p(n) * self.idf[term], [], [], []
        most = max(self.k, *self.rings)
        for j, p in enumerate(self.sides):
            out = None if leave is None else leave[j]
            at, dot = p.nearest(own, term, x, size, most, out)
            there = len(p.ids) - (0 if out is None else (out >= 0))
            sums, total = np.cumsum(dot, 1), np.bincount(own, x * p.total[term], size).astype(np.float64)
            if out is not None:  # a text's product with itself is its norm
                total -= np.where(out >= 0, np.sqrt(np.bincount(own, x * x, size)), 0.0)
            votes += [sums[:, k - 1] / np.maximum(1, np.minimum(k, there)) for k in self.rings] + [total / np.maximum(1, there)]
            ids.append(np.where(at[:, : self.k] >= 0, p.ids[at[:, : self.k]] if len(p.ids) else 0, np.iinfo(np.int64).max))
            dots.append(dot[:, : self.k])
        ids, dots = np.concatenate(ids, 1), np.concatenate(dots, 1)
        order = np.lexsort((ids, -dots))[:, : self.k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dots, order, 1), np.stack(votes, 1)

    def calibrate(self, share: dict[int, float], ids: np.ndarray, y: np.ndarray, entries: tuple) -> None:
        """Fit the logistic curve on the examples, each left out, with smoothed targets and the labels' true shares."""
        if not len(y) or y.min() == y.max():
            self.curve[-1] = 4.0 if len(y) and y.min() == 1 else -4.0
            return
        own, term, n = entries
        leave = [np.full(len(ids), -1), np.full(len(ids), -1)]
        for out, p in zip(leave, self.sides, strict=True):
            out[p.order] = np.arange(len(p.order))
        *_, votes = self.votes(own, term, n, len(ids), leave)
        votes = votes / np.maximum(np.sqrt(np.bincount(own, (np.log1p(n) * self.idf[term]) ** 2, len(ids))), 1e-300)[:, None]
        scale = np.maximum(votes.std(0), 1e-12)
        x = np.concatenate([votes / scale, np.ones((len(ids), 1))], 1)
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = np.where(y == 1, share[1] / n1, share[0] / n0) * len(y)
        ridge, c = np.append(np.full(votes.shape[1], 1e-3), 0.0), np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
            d, h = w * (p - t), w * p * (1 - p) + 1e-9
            step = np.linalg.solve((h[:, None] * x).T @ x + np.diag(ridge), x.T @ d + ridge * c)
            c = c - step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = np.append(c[:-1] / scale, c[-1])


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(h, n): documents with each term, over whole texts of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_counted(Words(raw, ALNUM))[1] for _, raw in blocks(batch.column(0).to_pylist())]
            h, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return durable(_text(docs).mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "df")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each example, with counts and hashes."""
    for batch in batches:
        for first, raw in blocks(batch.column(2).to_pylist()):
            w = Words(raw, ALNUM)
            own, h, n, at = _counted(w)
            ends = pa.array(np.searchsorted(own, np.arange(len(raw) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([w.word(i) for i in at], pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), batch.column(1).slice(first, len(raw)), *lists], names=["doc_id", "label", "h", "n", "word"])


def fit(docs: DataFrame, texts: DataFrame, labels: DataFrame, per_label: int = 2000, k: int = 15, rings: tuple[int, ...] = RINGS, power: float = 1.0) -> Index:
    """texts: doc_id, text; labels: doc_id, label. docs gives the document frequencies."""
    labels = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    share = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(labels, "doc_id", "label", per_label)
    ids, y, h, n, word, size = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64)
    if chosen:
        # the terms of the examples come to the driver: those of 2 * per_label texts at most
        rows = rows_of(texts.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id", chosen, "label", "int").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
        got = rows.mapInArrow(tidy(_entries), "doc_id long, label int, h array<long>, n array<long>, word array<binary>").toArrow().sort_by("doc_id").combine_chunks()
        if got.num_rows:
            ids, y = got["doc_id"].to_numpy(), got["label"].to_numpy().astype(np.float64)
            size = np.array(pa.compute.list_value_length(got["h"]).to_numpy())
            h, n = (pa.compute.list_flatten(got[c]).to_numpy() for c in ("h", "n"))
            word, h = pa.compute.list_flatten(got["word"]), h.view(np.uint64)
    known, at, term = np.unique(h, return_index=True, return_inverse=True)
    vocabulary, entries = Vocabulary(known, word.take(pa.array(at)).to_pylist()), (np.repeat(np.arange(len(ids)), size), term, n)

    df, total = document_frequencies(docs), docs.count()
    held = docs.sparkSession.sparkContext.broadcast(known)

    def of_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_find(held.value, batch.column("h").to_numpy().view(np.uint64))[0]))

    def idf(count: np.ndarray) -> np.ndarray:
        return (np.log((total + 1) / (count + 1)) + 1e-9) ** power

    mine = df.mapInArrow(of_examples, "h long, n long").toArrow()  # one row a term of the examples
    count = np.zeros(len(known), np.int64)
    count[np.searchsorted(known, mine["h"].to_numpy().view(np.uint64))] = mine["n"].to_numpy()
    index = Index(vocabulary, idf(count), ids, y, entries, k, rings)
    most = df.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    other = most["h"].to_numpy().view(np.uint64)
    order = np.argsort(other)
    order = order[~_find(known, other[order])[0]]
    index.other, index.other_idf = other[order], idf(most["n"].to_numpy()[order])
    index.calibrate({v: share.get(v, 0) / max(1, sum(share.values())) for v in (0, 1)}, ids, y, entries)
    index.total, index.df, index.power = total, df, power
    return index


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, evidence array<struct<example, cosine>>, nearest first."""
    df, index.df = index.df, None  # a table, which tasks cannot hold
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the examples' terms and COMMON
    index.df = df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, raw in blocks(batch.column(2).to_pylist()):
                size = len(raw)
                own, h, n, _ = _counted(Words(raw, ALNUM))
                hit, term = _find(m.vocabulary.hash, h)
                also, place = _find(m.other, h)
                also &= ~hit
                near, dot, votes = m.votes(own[hit], term[hit], n[hit], size)
                square = np.bincount(own[hit], (np.log1p(n[hit]) * m.idf[term[hit]]) ** 2, size).astype(np.float64)
                square += np.bincount(own[also], (np.log1p(n[also]) * m.other_idf[place[also]]) ** 2, size)
                rest = ~hit & ~also

                def lists(own, *values):
                    ends = pa.array(np.searchsorted(own, np.arange(size + 1)).astype(np.int32))
                    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]

                i, j = np.nonzero(dot > 0)
                cols = [pa.array(square), pa.array(list(votes), pa.list_(pa.float64())), *lists(i, near[i, j], dot[i, j]), *lists(own[rest], h[rest].view(np.int64), n[rest].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, size), batch.column(1).slice(first, size), *cols], names=["doc_id", "row", "square", "votes", "example", "dot", "h", "tf"])

    some = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    a = durable(some.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, row long, square double, votes array<double>, example array<long>, dot array<double>, h array<long>, tf array<int>"), "products")
    # squares of the terms that are neither the examples' nor common
    idf = F.pow(F.log(F.lit(float(index.total + 1)) / (F.col("n") + 1)) + 1e-9, F.lit(float(index.power)))
    rest = a.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", "x.h", "x.tf").join(df, "h").groupBy("row").agg(F.sum(F.pow(F.log1p("tf") * idf, 2)).alias("rest"))
    d = a.drop("h", "tf").join(rest, "row", "left").withColumn("norm", F.greatest(F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0))), F.lit(1e-300)))
    weights = F.array(*[F.lit(float(x)) for x in index.curve[:-1]])
    told = F.aggregate(F.arrays_zip(weights.alias("w"), F.col("votes").alias("v")), F.lit(0.0), lambda z, x: z + x["w"] * x["v"])
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), told / F.col("norm") + F.lit(float(index.curve[-1]))))))
    why = F.transform(F.arrays_zip("example", "dot"), lambda x: F.struct(x["example"].alias("example"), F.round(x["dot"] / F.col("norm"), 12).alias("cosine")))
    return d.select("doc_id", p.alias("score"), (p >= threshold).cast("int").alias("predicted"), why.alias("evidence"))
