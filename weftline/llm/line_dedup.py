"""Cross-site boilerplate lines by distinct-site spread.

Lines are \\n-separated and compared without surrounding white space; blank lines are kept as they are. For every line
hash, HyperLogLog sketches of the sites that hold the line are merged by aggregation. Lines whose estimate is within a
factor `band` of the threshold get an exact count of distinct sites; the others are certain. A line on at least `sites`
sites is boilerplate: it stays where it occurs first (least doc_id, then position) and goes everywhere else.

A row is known by its doc_id and two hashes of its text, so rows with a null or a repeated doc_id lose their own lines alone.

DataFrame functions only. A null text stays null, an empty one empty; a null site is a site of its own. Rows that repeat a
doc_id with the same text lose the same lines and count once. First is the least doc_id (null before all others), of rows with one
doc_id and differing texts the one with the least hash, then the position. Extra columns stay as they are, and may have any names but
those beginning with `_wl_`. The row of a text that loses all its lines stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable, release

#: Boilerplate lines of so many at most are sent to all tasks; beyond that, occurrences meet them by hash, hot hashes salted.
BROADCAST_LINES = 1_000_000
#: Parts into which the occurrences of a line are dealt.
SALTS = 64
#: Distinct sites from which a line is boilerplate.
SITES = 6
#: log2 of a sketch's buckets: about 2 % standard error, far within BAND.
LG_K = 11
BAND = 1.5


def _row() -> Column:
    """What tells rows apart; the second hash starts from another seed."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    site = F.coalesce(F.col("source").cast("string"), F.lit("\x00none"))
    lined = docs.select(_row().alias("_wl_row"), site.alias("_wl_site"), F.posexplode(F.split("text", "\n")).alias("_wl_pos", "_wl_line"))
    bare = F.btrim("_wl_line", F.lit(" \t\r\x0b\x0c"))
    full = lined.select("_wl_row", "_wl_site", "_wl_pos", bare.alias("_wl_bare")).where(F.length("_wl_bare") > 0)
    return full.select("_wl_row", "_wl_site", "_wl_pos", F.xxhash64("_wl_bare").alias("_wl_h"))


def boilerplate(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """_wl_h and _wl_first (row, position) of every line on at least `sites` distinct sites, as a written table."""
    lines = _lines(docs)
    # one row a line and site first, so that a line repeated within a site updates no sketch
    spread = lines.groupBy("_wl_h", "_wl_site").agg(F.min(F.struct("_wl_row", "_wl_pos")).alias("_wl_first"))
    merged = spread.groupBy("_wl_h").agg(F.hll_sketch_agg("_wl_site", F.lit(lg_k)).alias("_wl_sketch"), F.min("_wl_first").alias("_wl_first"))
    told = durable(merged.select("_wl_h", "_wl_first", F.hll_sketch_estimate("_wl_sketch").alias("_wl_about")).where(F.col("_wl_about") >= sites / band), "spread")
    near = told.where(F.col("_wl_about") < sites * band).select("_wl_h")
    # occurrences near the threshold: one row a line and site before anything is counted, so a frequent line is no hot key
    exact = _met(lines, near).select("_wl_h", "_wl_site").groupBy("_wl_h", "_wl_site").agg(F.lit(1).alias("_wl_x")).groupBy("_wl_h").agg(F.count("*").alias("_wl_n"))
    sure = told.join(exact, "_wl_h", "left").where(F.coalesce(F.col("_wl_n"), F.col("_wl_about")) >= sites)
    out = durable(sure.select("_wl_h", "_wl_first"), "boilerplate")
    release(told)
    return out


def _met(lines: DataFrame, told: DataFrame) -> DataFrame:
    """lines with what is told of their hash (a row a hash, of a written table), those alone of which something is told."""
    if told.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(told), "_wl_h")
    salt: Column = F.pmod(F.xxhash64("_wl_row", "_wl_pos"), F.lit(SALTS))
    each = told.withColumn("_wl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("_wl_salt", salt.cast("int")).join(each, ["_wl_h", "_wl_salt"]).drop("_wl_salt")


def remove_boilerplate(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """docs with boilerplate lines taken from text, and _wl_lines, _wl_removed: lines there were, lines taken."""
    common = boilerplate(docs, sites, lg_k, band)
    found = _met(_lines(docs), common).where(~F.struct("_wl_row", "_wl_pos").eqNullSafe(F.col("_wl_first")))
    gone = found.groupBy("_wl_row").agg(F.collect_set("_wl_pos").alias("_wl_gone"))  # at most a document's lines
    gone = gone.select(F.col("_wl_row.id").alias("_wl_id"), F.col("_wl_row.a").alias("_wl_a"), F.col("_wl_row.b").alias("_wl_b"), "_wl_gone")
    own = _row()
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_wl_id"]) & (own["a"] == gone["_wl_a"]) & (own["b"] == gone["_wl_b"]), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_wl_gone", i))
    text = F.when(F.col("_wl_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], count.alias("_wl_lines"), F.coalesce(F.size("_wl_gone"), F.lit(0)).cast("long").alias("_wl_removed"))
