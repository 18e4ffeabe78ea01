"""Candidate generators: rankings of text views under filters, documents opened to their chunks, and unions of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fusion

#: A generator's lists as (filter, view). `all`: the first generation's filters on whole-corpus statistics; `eligible`: an index of
#: the eligible units alone. `opened`: the documents of the document view, each opened to its chunks.
GENERATORS = {
    "G0": [("all", "chunk")],
    "G1": [("eligible", "chunk")],
    "G2": [("all", "enriched")],
    "G3": [("all", "opened")],
    "G4": [("all", "chunk"), ("all", "opened")],
    "G5": [("eligible", "chunk"), ("eligible", "opened")],
    "G6": [("eligible", "enriched"), ("eligible", "opened")],
}
#: Whatever their own lists, these generators fuse the lists of the first of them.
FUSED_ALIKE = ["G4", "G5", "G6"]
#: The place of what has no rank.
ABSENT = 10_000


def opened(ranked: DataFrame, children: DataFrame, depth: int) -> DataFrame:
    """rankings with the document view's rows opened to chunks as view `opened`: by the chunk's own rank under the same filter and method
    (absent last), then id. Lists end at `depth` chunks."""
    keyed = ranked.withColumn("list", F.struct("filter", "method", "q"))
    parents = keyed.where("view = 'document'").select("list", "doc", "rank")
    own = keyed.where("view = 'chunk'").select("list", "chunk", "rank")
    got = fusion.children_of(parents, children, own, "list", "doc", "chunk").where(F.col("rank") <= depth)
    got = got.select("list.filter", F.lit("opened").alias("view"), "list.method", "list.q", "doc", "chunk", "rank")
    return ranked.where("view <> 'document'").unionByName(got)


def generated(lists: DataFrame, depth: int, c: int = 60) -> DataFrame:
    """(variant, method, q, doc, chunk, rank) of all generators for both methods and their fusion, from opened(rankings).

    A union goes by the better of a chunk's ranks; where two chunks have the same, that of the opened documents stands first. Fusion adds
    1 / (c + rank) of both methods' lists, to 8 places; ties go to the smaller document and chunk."""
    made: dict[tuple[str, str], list[str]] = {}
    for name, parts in GENERATORS.items():
        for part in parts:
            made.setdefault(part, []).append(name)
    users = F.lit(None).cast("array<string>")
    for (kind, view), names in made.items():
        users = F.when((F.col("filter") == kind) & (F.col("view") == view), F.array(*map(F.lit, names))).otherwise(users)
    each = lists.withColumn("variant", F.explode(users))
    by = ["variant", "method", "q", "doc", "chunk"]
    one = each.groupBy(*by).agg(F.min(F.when(F.col("view") != "opened", F.col("rank"))).alias("own"), F.min(F.when(F.col("view") == "opened", F.col("rank"))).alias("by_document"))
    absent = lambda x: F.coalesce(x, F.lit(ABSENT))
    order = [F.least("own", "by_document"), absent("by_document"), absent("own"), "chunk"]
    single = one.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "method", "q").orderBy(*order))).where(F.col("rank") <= depth).select(*by, "rank")
    fused = single.where(~F.col("variant").isin(FUSED_ALIKE[1:])).groupBy("variant", "q", "doc", "chunk").agg(F.round(F.sum(F.lit(1.0) / (c + F.col("rank"))), 8).alias("score"))
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "q").orderBy(F.desc("score"), "doc", "chunk"))).where(F.col("rank") <= depth)
    alike = F.when(F.col("variant") == FUSED_ALIKE[0], F.array(*map(F.lit, FUSED_ALIKE))).otherwise(F.array("variant"))
    fused = fused.select(F.explode(alike).alias("variant"), F.lit("hybrid_v1").alias("method"), "q", "doc", "chunk", "rank")
    return single.unionByName(fused)


def item_places(ranked: DataFrame, gold: DataFrame, variants: dict[str, str]) -> DataFrame:
    """A row an expected item and method: current_rank, prefilter_rank, enriched_rank and dual_rank (the variants' names by column),
    n_ineligible_ahead and sibling_ahead in the current variant.

    ranked: variant, method, q, doc, chunk, item, rank, eligible; gold: q, item, doc, chunk (null for a document). What is not in a list
    has all its ineligible rows ahead; another chunk of an expected chunk's document is a sibling."""
    by = ["method", "q", "item"]
    w = Window.partitionBy("method", "q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    now = ranked.where(F.col("variant") == variants["current_rank"]).withColumn("ahead", F.coalesce(F.sum((~F.col("eligible")).cast("long")).over(w), F.lit(0)))
    ahead = now.groupBy(*by).agg(F.min_by("ahead", "rank").alias("ahead"))
    ranks = ranked.groupBy(*by).agg(*[F.min(F.when(F.col("variant") == v, F.col("rank"))).alias(name) for name, v in variants.items()])
    whole = now.groupBy("method", "q").agg(F.count_if(~F.col("eligible")).alias("all_ineligible"))
    # the best two chunks of a document tell the best one that is not the expected chunk
    best = now.groupBy("method", "q", "doc").agg(F.min(F.struct("rank", "chunk")).alias("first"), F.min("rank").alias("best"))
    second = now.join(best.select("method", "q", "doc", F.col("best").alias("b")), ["method", "q", "doc"]).where("rank > b").groupBy("method", "q", "doc").agg(F.min("rank").alias("second"))
    methods = ranked.select("method").distinct()
    items = gold.select("q", "item", "doc", "chunk").distinct().join(F.broadcast(methods))  # three methods
    j = items.join(ranks, by, "left").join(ahead, by, "left").join(whole, ["method", "q"], "left").join(best, ["method", "q", "doc"], "left").join(second, ["method", "q", "doc"], "left")
    sibling = F.when(F.col("first.chunk") == F.col("chunk"), F.col("second")).otherwise(F.col("first.rank"))
    return j.select(
        *by, "doc", "chunk", *variants, F.coalesce("ahead", "all_ineligible", F.lit(0)).alias("n_ineligible_ahead"),
        F.coalesce(F.col("chunk").isNotNull() & (sibling < F.coalesce("current_rank", F.lit(ABSENT))), F.lit(False)).alias("sibling_ahead"),
    )
