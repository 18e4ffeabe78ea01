"""Vector checks and exact cosine retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top

#: Scores that a task holds at once (a query and a row each); sorting them takes about four times their 8 bytes.
SCORES = 1 << 22


def valid(v, dim: int) -> Column:
    """Of the given dimension, all finite, norm not zero."""
    v = F.col(v) if isinstance(v, str) else v
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _bound(c: Column, f) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unit(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    both = lambda w: F.named_struct(F.lit("w"), w, F.lit("n"), norm(w))
    return _bound(F.transform(v, lambda x: x.cast("double")), lambda w: _bound(both(w), lambda s: F.transform(s["w"], lambda x: x / s["n"])))


def cosine_topk(corpus: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096, part: int = 1 << 14) -> DataFrame:
    """(query, key, score): for every query its k nearest rows, score rounded to 8 places, ties to the smaller key.

    Queries in blocks of about `block` meet the corpus in parts of about `part` rows, each pair of them in a task of its own that keeps
    k rows a query and scores a few queries at a time (SCORES); nothing passes through the driver. Null keys and invalid vectors (see valid) have to be left out before."""
    kind = dict(corpus.dtypes)[key]
    blocks, parts = max(1, -(-queries.count() // block)), max(1, -(-corpus.count() // part))
    share = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(key).alias("query_id"), unit(vector).alias("v"), share(blocks).alias("b"), every(parts).alias("p"))
    c = corpus.select(key, unit(vector).alias("v"), share(parts).alias("p"), every(blocks).alias("b"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", key, "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left["query_id"][:0], right[key][:0], pa.array([], pa.float64())], names=names)
        matrix = lambda t: np.stack(t["v"].to_numpy()).astype(np.float64)
        ids = right[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        lines, columns = matrix(left), matrix(right)[order].T
        step, n = max(1, SCORES // len(ids)), min(k, len(ids))
        found = []
        for i in range(0, len(lines), step):
            s = np.round(lines[i : i + step] @ columns, 8)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ties stay in the order of the keys
            found.append((at, np.take_along_axis(s, at, 1)))
        at, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([left["query_id"].take(pa.array(np.repeat(np.arange(len(lines)), n))), right[key].take(pa.array(order[at].ravel())), pa.array(s.ravel())], names=names)

    out = q.groupBy("b", "p").cogroup(c.groupBy("b", "p")).applyInArrow(near, f"query_id {kind}, {key} {kind}, score double")
    return top(out, "query_id", [F.desc("score"), key], k)


def normalized(v) -> Column:
    """The unit vector, or null where the vector is not valid for its own length."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(valid(v, F.size(v)), unit(v))


def _digests(text: Column, mode: str, dim: int) -> Column:
    """A chain of SHA-256 digests of mode and text in hexadecimal, of dim bytes or more."""
    hexes = [F.sha2(F.concat(F.lit(mode + "\x1f"), text), 256)]
    for _ in range(-(-dim // 32) - 1):
        hexes.append(F.sha2(F.unhex(hexes[-1]), 256))
    return F.concat(*hexes)


def hash_bytes(text: Column, mode: str, dim: int) -> Column:
    """The bytes from which hash_embedding makes a vector."""
    return F.unhex(F.substring(_digests(text, mode, dim), 1, 2 * dim))


def hash_embedding(text: Column, mode: str, dim: int) -> Column:
    """A unit vector from a chain of SHA-256 digests of mode and text; each byte b gives b / 255 * 2 - 1."""
    value = lambda h, i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0
    return unit(_bound(_digests(text, mode, dim), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: value(h, i))))


def embedding_delta(chunks: DataFrame, known: DataFrame, version: str, model: str, chunk: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(chunks whose vector is known, with it; those still to be encoded). A vector is known by version, chunk, content hash and model.

    known: cache_key, embedding. Both keep chunk, content and cache_key."""
    key = F.sha1(F.concat_ws("\x1f", F.lit(version), F.col(chunk).cast("string"), F.sha1(content), F.lit(model)))
    c = chunks.select(chunk, content, key.alias("cache_key"))
    return c.join(known.dropDuplicates(["cache_key"]), "cache_key"), c.join(known.select("cache_key"), "cache_key", "left_anti")
