"""Weighted BM25 for all queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import durable
from .joins import split_join

#: Query vocabularies of so many terms at most are sent to all tasks, beyond that Spark joins by term.
BROADCAST_TERMS = 200_000
#: Pairs of classes (two digests each) of so many rows at most are sent to all tasks.
BROADCAST_PAIRS = 50_000
#: Scores, and parts of scores, that a task holds at once.
SCORES = 1 << 22


def _tokened(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """key, length, terms array<struct<term, w>>: a field's tokens count as often as its weight."""
    each = [F.transform(tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))) for f, w in fields.items()]  # noqa: B023
    got = docs.select(key, F.flatten(F.array(*each)).alias("terms"))
    return got.select(key, F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("length"), "terms")


def postings(docs: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """(key, term, tf)."""
    return _tokened(docs, key, fields).select(key, F.explode("terms").alias("x")).groupBy(key, "x.term").agg(F.sum("x.w").alias("tf"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, times, pos): repeats add up, pos is the first place."""
    return queries.select(key, F.posexplode(tokens(text)).alias("pos", "term")).groupBy(key, "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))


def _hits(docs: DataFrame, key: str, fields: dict[str, int], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf, length of the query vocabulary's postings; key, length of every document), from one pass over the texts."""
    vocabulary = durable(terms.select("term").distinct(), "vocabulary")
    if vocabulary.count() <= BROADCAST_TERMS:
        vocabulary = F.broadcast(vocabulary)
    # a file may be one split however large: texts are dealt over tasks before they are taken apart
    docs = docs.select(key, *fields).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    each = _tokened(docs, key, fields).select(key, "length", F.posexplode_outer("terms").alias("pos", "x")).select(key, "length", "pos", "x.term", "x.w")
    asked = each.join(vocabulary.withColumn("asked", F.lit(True)), "term", "left").where("asked or coalesce(pos, 0) = 0")
    # the first token of a document, asked for or not, stands for its length; documents without a token have a row as well
    kept = durable(asked.groupBy(key, "term", "length", "asked").agg(F.sum("w").alias("tf"), F.min(F.coalesce("pos", F.lit(0))).alias("pos")), "postings")
    return kept.where("asked").select(key, "term", "tf", "length"), kept.where("pos = 0").select(key, "length")


def _idf() -> Column:
    return F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _score(k1: float, b: float) -> Column:
    return F.col("times") * _idf() * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))


def _summed(hit: DataFrame, by: list[str], k1: float, b: float) -> DataFrame:
    part = hit.select(*by, "term", "pos", _score(k1, b).alias("part"))
    out = part.groupBy(*by).agg(F.round(F.sum("part"), 6).alias("score"), _in_order().alias("matched_terms"))
    return out.where("score > 0")


def bm25(docs: DataFrame, key: str, fields: dict[str, int], terms: DataFrame, query_key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, matched_terms) for every pair with a positive score, rounded to 6 places before any ranking.

    Only postings of the queries' vocabulary leave the scan; document frequencies and lengths are of the whole corpus."""
    post, weighted = _weighted(docs, key, fields, terms)
    if weighted.count() <= BROADCAST_TERMS:  # a term that every document has is then no hot key
        weighted = F.broadcast(weighted)
    return _summed(post.join(weighted, "term"), [query_key, key], k1, b)


def _weighted(docs: DataFrame, key: str, fields: dict[str, int], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf, length of the query vocabulary's postings; terms with df, n and avgdl of the whole corpus)."""
    post, size = _hits(docs, key, fields, terms)
    corpus = size.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avgdl"))  # one row
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return post, durable(terms.join(df, "term").join(F.broadcast(corpus)), "weighted-terms")


def bm25_top(docs: DataFrame, key: str, fields: dict[str, int], terms: DataFrame, query_key: str, k: int, matched: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, rank): the k best of bm25() for every query, ties to the smaller key; matched: with matched_terms, gathered for these alone.

    A document's postings come together in one row and a task keeps the k best of its documents for each query, so what is shuffled
    grows with postings, not with pairs of a query and a document. Where the queries' terms are too many to be sent to all tasks, pairs
    are made and added up by joins."""
    post, weighted = _weighted(docs, key, fields, terms)
    if weighted.count() > BROADCAST_TERMS:
        scored = _summed(post.join(weighted, "term"), [query_key, key], k1, b).select(query_key, key, "score")
    else:
        scored = _best_of_tasks(post, weighted, key, query_key, k, k1, b).withColumn("score", F.round("score", 6)).where("score > 0")
    best = top(scored, query_key, [F.desc("score"), key], k)
    if not matched:
        return best
    best = durable(best, "best")
    few = best.select(F.col(query_key).alias("_q"), F.col(key).alias("_d"))
    few = F.broadcast(few) if few.count() <= BROADCAST_TERMS else few
    had = post.join(few, F.col(key).eqNullSafe(F.col("_d"))).select("_q", "_d", F.col("term").alias("_term")).distinct()
    got = had.join(weighted.select(query_key, "term", "pos"), F.col(query_key).eqNullSafe(F.col("_q")) & (F.col("term") == F.col("_term")))
    got = got.groupBy("_q", "_d").agg(_in_order().alias("matched_terms"))
    return best.join(got, F.col(query_key).eqNullSafe(F.col("_q")) & F.col(key).eqNullSafe(F.col("_d"))).drop("_q", "_d")


def _in_order() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])


def _best_of_tasks(post: DataFrame, weighted: DataFrame, key: str, query_key: str, k: int, k1: float, b: float) -> DataFrame:
    """(query, key, score): of every task's documents the k best for each query, scores rounded to 6 places, ties to the smaller key."""
    asked = weighted.select(query_key, "term", (F.col("times") * _idf()).alias("w"), "avgdl").orderBy("term", query_key).toArrow()  # BROADCAST_TERMS rows at most
    coded = asked[query_key].combine_chunks().dictionary_encode(null_encoding="encode")
    queries, of_query, weight = coded.dictionary, coded.indices.to_numpy(), asked["w"].to_numpy()
    known = asked["term"].combine_chunks().dictionary_encode()  # in order, so a term's rows follow each other
    known, first = known.dictionary, np.searchsorted(known.indices.to_numpy(), np.arange(len(known.dictionary) + 1))
    mean, n_queries = asked["avgdl"][0].as_py() if len(asked) else 1.0, len(queries)

    def near(batches):
        best = None
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            term = pc.index_in(flat.field("term"), value_set=known).to_numpy()
            tf, length = flat.field("tf").to_numpy().astype(np.float64), flat.field("length").to_numpy()
            divisor = tf + k1 * (1 - b + b * length / mean)
            n = first[term + 1] - first[term]  # queries that ask for a posting's term
            parts = np.concatenate(([0], np.cumsum(n)))
            ends = np.searchsorted(row, np.arange(len(lists) + 1))  # a document's first posting
            at = 0
            while at < len(lists):
                to = min(len(lists), at + max(1, SCORES // n_queries), max(at + 1, int(np.searchsorted(parts[ends], parts[ends[at]] + SCORES, side="right")) - 1))
                lo, hi = ends[at], ends[to]
                p = np.repeat(np.arange(lo, hi), n[lo:hi])
                place = first[term[p]] + np.arange(len(p)) - (parts[p] - parts[lo])
                score = np.bincount((row[p] - at) * n_queries + of_query[place], weight[place] * tf[p] * (k1 + 1) / divisor[p], (to - at) * n_queries).reshape(to - at, n_queries)
                score = np.floor(score * 1e6 + 0.5) / 1e6
                least = np.partition(score, to - at - k, axis=0)[to - at - k] if to - at > k else 0
                q, d = np.nonzero(((score >= least) & (score > 0)).T)
                found = pa.table({"q": q, "key": keys.take(pa.array(d + at)), "score": score[d, q]})
                best = _first_k(found if best is None else pa.concat_tables([best, found]), k)
                at = to
        if best is not None:
            yield from pa.table([queries.take(best["q"].combine_chunks()), best["key"], best["score"]], names=[query_key, key, "score"]).to_batches()

    kinds = weighted.select(query_key).schema.fields + post.select(key).schema.fields
    parts = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = post.repartition(parts, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "tf", "length"))).alias("postings")).sortWithinPartitions(key)
    return rows.mapInArrow(near, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", score double")


def _first_k(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each q; rows of one score stay in their order."""
    q, score = rows["q"].to_numpy(), rows["score"].to_numpy()
    order = np.lexsort((np.arange(len(q)), -score, q))
    q = q[order]
    return rows.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k])).combine_chunks()


def view_index(docs: DataFrame, key: str, fields: dict[str, int], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(view, dc, key, term, tf, length; view, dc, key, length) of documents in several views, dc being a document's class; one pass over the texts.

    Only postings of the queries' vocabulary leave the scan. A key may stand in several views; a null view or class is kept apart."""
    post, size = _hits(docs.select(F.struct("view", "dc", key).alias("_unit"), *fields), "_unit", fields, terms)
    return post.select("_unit.*", "term", "tf", "length"), size.select("_unit.*", "length")


def _met(left: DataFrame, right: DataFrame, on: list[str], left_by: list[str], right_by: list[str]) -> DataFrame:
    """Inner join on columns of which some may be hot on both sides: the right side goes to all tasks where it is small, else keys are dealt."""
    right = durable(right, "asked")
    if right.count() <= BROADCAST_TERMS:
        return left.join(F.broadcast(right), on)
    key = F.struct(*on).alias("_on")
    got = split_join(left.withColumn("_on", key), right.select(key, *[c for c in right.columns if c not in on]), "_on", left_by, right_by)
    return got.drop("_on")


def bm25_within(post: DataFrame, size: DataFrame, key: str, terms: DataFrame, query_key: str, allowed: DataFrame, own: bool, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(view, query, key, score, matched_terms) of pairs whose classes are allowed, by the index of view_index.

    terms: query, qc (its class), term, times, pos; allowed: distinct (qc, dc). own: frequencies and mean length are those of the
    documents allowed for the query, as if each query had an index of its own; else those of the whole view. They are the same for all
    queries of a class, and are summed over classes of documents, so what is shuffled grows with postings and with pairs of classes;
    pairs of a query and a document are made only where they share a term."""
    # pairs are small files of many rows: without the hint Spark would send them whole through the driver
    small = F.broadcast(allowed) if allowed.count() <= BROADCAST_PAIRS else allowed.hint("merge")
    mean = F.greatest(F.sum("sum_length") / F.sum("n"), F.lit(1.0)).alias("avgdl")
    sizes = size.groupBy("view", "dc").agg(F.count("*").alias("n"), F.sum("length").alias("sum_length"))
    have = post.groupBy("view", "dc", "term").agg(F.count("*").alias("df"))
    if own:
        corpus = sizes.join(small, "dc").groupBy("view", "qc").agg(F.sum("n").alias("n"), mean)
        asked = _met(have, terms.select("qc", "term").distinct(), ["term"], ["view", "dc"], ["qc"])
        df = asked.join(small, ["qc", "dc"]).groupBy("view", "qc", "term").agg(F.sum("df").alias("df"))
        weighted = terms.join(df, ["qc", "term"]).join(corpus, ["view", "qc"])
    else:
        df = have.groupBy("view", "term").agg(F.sum("df").alias("df"))
        weighted = terms.join(df, "term").join(F.broadcast(sizes.groupBy("view").agg(F.sum("n").alias("n"), mean)), "view")  # a row a view
    hit = _met(post, weighted, ["view", "term"], ["dc", key], [query_key]).join(small, ["qc", "dc"])
    return _summed(hit, ["view", query_key, key], k1, b)


def top(scored: DataFrame, query_key: str, order: list, k: int) -> DataFrame:
    """Rows of rank 1 to k within each query."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order))).where(F.col("rank") <= k)
