"""Rank fusion, parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import top


def rrf(lists: dict[str, DataFrame], query: str, key: str, weights: dict[str, float] | None = None, c: int = 60, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists (query, key, rank): score, rank, sources and one rank column a list."""
    every = None
    for name, df in lists.items():
        part = df.select(query, key, F.lit(name).alias("source"), "rank")
        every = part if every is None else every.unionByName(part)
    weight = F.element_at(F.create_map(*[F.lit(x) for n in lists for x in (n, float((weights or {}).get(n, 1.0)))]), F.col("source"))
    got = every.groupBy(query, key).agg(F.round(F.sum(weight / (c + F.col("rank"))), 8).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), *[F.min(F.when(F.col("source") == n, F.col("rank"))).alias(f"{n}_rank") for n in lists])
    return top(got, query, [F.desc("score"), key], k)


def best_rank(lists: list[DataFrame], query: str, key: str) -> DataFrame:
    """The best rank of each candidate over several field lists, ranked again."""
    every = lists[0].select(query, key, "rank")
    for df in lists[1:]:
        every = every.unionByName(df.select(query, key, "rank"))
    best = every.groupBy(query, key).agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("best", key)))


def children_of(ranked: DataFrame, children: DataFrame, child_ranks: DataFrame, query: str, parent: str, child: str, per_parent: int | None = None) -> DataFrame:
    """Ranked parents opened to their children: by the child's own rank (absent last), then id; at most per_parent each."""
    opened = ranked.select(query, parent, F.col("rank").alias("parent_rank")).join(children, parent).join(child_ranks.select(query, child, F.col("rank").alias("own")), [query, child], "left")
    own = [F.asc_nulls_last("own"), F.asc(child)]
    within = opened.withColumn("nth", F.row_number().over(Window.partitionBy(query, parent).orderBy(*own)))
    if per_parent:
        within = within.where(F.col("nth") <= per_parent)
    return within.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("parent_rank", "nth"))).select(query, parent, child, "parent_rank", "nth", "rank")


def hybrid(lexical: DataFrame, vector: DataFrame, query: str, keys: list[str], weights: tuple[float, float] = (1.0, 1.0), c: int = 60, k: int = 5) -> DataFrame:
    """Two ranked lists (query, keys, rank, score) fused by reciprocal ranks: both ranks and scores, score (8 places), rank up to k.

    A side that has no such candidate adds nothing. Ties go to the smaller keys, in their order."""
    a = lexical.select(query, *keys, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    b = vector.select(query, *keys, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    part = lambda w, r: F.coalesce(F.lit(w) / (c + F.col(r)), F.lit(0.0))
    j = a.join(b, [query, *keys], "full").withColumn("score", F.round(part(weights[0], "lexical_rank") + part(weights[1], "vector_rank"), 8))
    return top(j, query, [F.desc("score"), *keys], k)


def max_view(chunk_view: DataFrame, context_view: DataFrame, query: str, keys: list[str], k: int = 5) -> DataFrame:
    """The larger of two views' scores for each candidate, which view won (or both), rank up to k. A view that lacks one never wins."""
    a, b = chunk_view.select(query, *keys, F.col("score").alias("x")), context_view.select(query, *keys, F.col("score").alias("y"))
    won = F.when(F.col("x").isNull(), "context_view").when(F.col("y").isNull(), "chunk_view").when(F.col("x") == F.col("y"), "both").when(F.col("y") > F.col("x"), "context_view").otherwise("chunk_view")
    j = a.join(b, [query, *keys], "full").select(query, *keys, F.greatest("x", "y").alias("score"), won.alias("winning_view"))
    return top(j, query, [F.desc("score"), *keys], k)


def partitioned(scored: DataFrame, query: str, part: str, keys: list[str], k: int = 20, c: int = 60) -> DataFrame:
    """The first k within each part (a document type) of a query, then fused: score is the sum of 1 / (c + rank) over a key's lists."""
    w = Window.partitionBy(query, part).orderBy(F.desc("score"), *keys)
    each = scored.withColumn("own", F.row_number().over(w)).where(F.col("own") <= k)
    got = each.groupBy(query, *keys).agg(F.round(F.sum(1 / (c + F.col("own"))), 8).alias("score"), F.array_sort(F.collect_set(part)).alias("parts"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), *keys)))


def hierarchical(documents: DataFrame, chunk_ranks: DataFrame, children: DataFrame, query: str, doc: str, chunk: str, limit: int = 20, c: int = 60) -> DataFrame:
    """Documents ranked by the fused rank of their own score and their best chunk's, each followed by its chunks, cut at `limit` rows.

    documents: query, doc, score; chunk_ranks: query, doc, chunk, rank; children: doc, chunk. Ties go to the better own rank, then the
    better chunk (10,000 where there is none), then the smaller id. Chunks stand in the order of their rank, absent ones last."""
    semantic = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))
    best = chunk_ranks.groupBy(query, doc).agg(F.min("rank").alias("best_chunk"))
    d = documents.withColumn("semantic_rank", semantic).join(best, [query, doc], "left")
    d = d.withColumn("fusion", F.lit(1.0) / (c + F.col("semantic_rank")) + F.coalesce(F.lit(1.0) / (c + F.col("best_chunk")), F.lit(0.0)))
    d = d.withColumn("document_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("fusion"), "semantic_rank", F.coalesce("best_chunk", F.lit(10000)), doc)))
    d = d.where(F.col("document_rank") <= limit).select(query, doc, "document_rank", "semantic_rank", "best_chunk")  # each is a row of its own, so no later one is reached
    opened = d.join(children.select(doc, chunk), doc).join(chunk_ranks.select(query, chunk, F.col("rank").alias("chunk_rank")), [query, chunk], "left")
    nth = F.row_number().over(Window.partitionBy(query, doc).orderBy(F.coalesce("chunk_rank", F.lit(10000)), chunk))
    opened = opened.withColumn("expansion_rank", nth).where(F.col("expansion_rank") < limit)
    kind = dict(children.dtypes)[chunk]
    parents = d.select(query, doc, F.lit(None).cast(kind).alias(chunk), F.lit("document").alias("kind"), "document_rank", F.lit(0).alias("expansion_rank"))
    every = parents.unionByName(opened.select(query, doc, chunk, F.lit("chunk").alias("kind"), "document_rank", "expansion_rank"))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("document_rank", "expansion_rank"))).where(F.col("rank") <= limit)
