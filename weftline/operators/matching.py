"""Matching of solutions by shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_tokens, normalize
from ..shared import durable
from .joins import split_join

STOPWORDS = ["客户", "方案", "系统", "能力", "需要", "进行", "the", "and", "for"]


def solution_query_text(opportunities: DataFrame, pains: DataFrame, impacts: DataFrame, case: str) -> DataFrame:
    """case, query: the texts of suitable opportunities (by position), each followed by its pains' in the order of their ids' list, then all
    impacts (by position); parts joined by spaces, empty ones left out. Cases without a suitable opportunity have no row.

    opportunities: case, position, text, suitable, pain_ids; pains: case, pain, text; impacts: case, position, text."""
    fine = opportunities.where("suitable")
    own = fine.select(case, F.col("position").alias("a"), F.lit(0).alias("b"), "text")
    named = fine.select(case, F.col("position").alias("a"), F.posexplode("pain_ids").alias("b", "pain")).join(pains.withColumnRenamed("text", "t"), [case, "pain"]).select(case, "a", (F.col("b") + 1).alias("b"), F.col("t").alias("text"))
    last = impacts.join(fine.select(case).distinct(), case, "left_semi").select(case, F.lit(1 << 40).cast("long").alias("a"), F.col("position").cast("int").alias("b"), "text")
    every = own.withColumn("a", F.col("a").cast("long")).unionByName(named.withColumn("a", F.col("a").cast("long"))).unionByName(last).where("text <> ''")
    return every.groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "text"))), lambda x: x["text"]), " ").alias("query"))


def match_solutions(queries: DataFrame, catalogue: DataFrame, query: str, text: str, solution: str, content: str, k: int = 5, least: float = 0.05, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """query, solution, score, matched, rank: half the overlap, three tenths of the Jaccard index and a fifth if the query contains the whole
    solution text; at least `least`; ties by place in the catalogue (column place). Pairs meet by a shared token, so no pair is left out that scores."""
    # texts that are alike have the same scores: each is one query, and of a solution's text the first k places are all that a list can hold
    asked, own = queries.select(query, F.col(text).alias("_text")), catalogue.select(solution, "place", F.col(content).alias("_content"))
    texts = asked.select("_text").distinct().select("_text", match_tokens("_text", stopwords).alias("t"), normalize("_text").alias("nq"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("_content").orderBy("place"))).where(F.col("_n") <= k)
    contents = own.select("_content").distinct().select("_content", match_tokens("_content", stopwords).alias("u"), normalize("_content").alias("nc"))
    q, c = durable(texts.withColumn("nt", F.size("t")), "query-texts"), durable(contents.withColumn("nu", F.size("u")), "solution-texts")
    # a token may be in most texts of either side: its rows are dealt over parts
    hits = split_join(q.select("_text", "nt", F.explode("t").alias("w")), c.select("_content", "nu", F.explode("u").alias("w")), "w", ["_text"], ["_content"])
    pairs = hits.groupBy("_text", "_content").agg(F.count("*").alias("n"), F.max("nt").alias("nt"), F.max("nu").alias("nu"))
    # the texts themselves are compared for the pairs alone that share a token
    p = pairs.join(q.select("_text", "nq"), "_text").join(c.select("_content", "nc"), "_content")
    score = 0.5 * (F.col("n") / F.least("nt", "nu")) + 0.3 * (F.col("n") / (F.col("nt") + F.col("nu") - F.col("n"))) + F.when(F.contains("nq", "nc"), 0.2).otherwise(0.0)
    s = p.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).where(F.col("score") >= least).select("_text", "_content", "score")
    # a text's list has its best k contents by their first places, or rows of these; the others stand behind k rows
    lead = s.join(first.where("_n = 1").select("_content", F.col("place").alias("lead")), "_content")
    lead = lead.withColumn("_n", F.row_number().over(Window.partitionBy("_text").orderBy(F.desc("score"), "lead"))).where(F.col("_n") <= k)
    ranked = lead.select("_text", "_content", "score").join(first.drop("_n"), "_content")
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("_text").orderBy(F.desc("score"), "place"))).where(F.col("rank") <= k)
    # what matched is told for the best alone, in the order of the query
    told = best.join(q.select("_text", "t"), "_text").join(c.select("_content", "u"), "_content")
    told = told.select("_text", solution, "score", F.filter("t", lambda w: F.array_contains("u", w)).alias("matched"), "rank")
    return asked.join(durable(told, "matched-texts"), "_text").select(query, solution, "score", "matched", "rank")
