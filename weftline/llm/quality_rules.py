"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words are what white space separates. Every word and pair of neighbouring words falls into one of BUCKETS buckets by
xxhash64. Two multinomials over the buckets are counted: one over all documents (raw), one over a trusted target. A
document's verdict is the mean over its n-grams of log(target / raw): kept if it is at least `threshold`. Weights are whole
millionths, so sums do not depend on order. Beside it stand plain counts, of which two make the base rule (fewer than 20
words, or over 30 % of them in repeated 8-word windows).

DataFrame functions only. Null and empty texts have no words and fail the base rule. An empty target gives every bucket
the same target share; an empty corpus gives an empty table. Rows that repeat each give a row and each count. Only doc_id
and text are read, so extra columns cannot clash. Long texts are scored whole: arrays are as long as the text has words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
#: Added to every bucket's count, as a share of the multinomial's mean count.
SMOOTHING = 0.01
THRESHOLD = -0.05
#: Bits of the filter that tells which documents may be of the target: 2 MB.
FILTER_BITS = 1 << 24
_WS = " \t\n\x0b\x0c\r"


def words(text: str = "text") -> Column:
    bare = F.btrim(text, F.lit(_WS))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>"))


def _worded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("w", words())


def _hashed(d: DataFrame) -> DataFrame:
    """d with hw, the hashes of the words in w, and h2, those of each word with its next."""
    d = d.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    return d.withColumn("h2", _joined("hw", 1))


def _joined(h: str, step: int) -> Column:
    """The hash of each element with the one `step` places on (of itself, where there is none)."""
    return F.zip_with(h, F.slice(h, F.lit(1 + step), F.size(h)), lambda x, y: F.xxhash64(x, y))


def ngrams() -> Column:
    """Hashes of all words and of all pairs of neighbours, from hw and h2."""
    return F.concat("hw", F.slice("h2", F.lit(1), F.greatest(F.size("hw") - 1, F.lit(0))))


def _may_be(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose id may be among ids: all that are, and few others while ids are fewer than FILTER_BITS.

    What is broadcast are the filter's words, FILTER_BITS / 64 rows at most."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bit = lambda s: F.expr(f"shiftleft(1L, cast({s} % 64 as int))")
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit("slot")).alias("bits"))
    d = docs.select("doc_id", "text", slot.alias("slot")).withColumn("word", F.shiftright("slot", 6))
    return d.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit("slot")) != 0).select("doc_id", "text")


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """b, n: n-grams of each bucket."""
    w = docs.select(words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    # one row an n-gram, so that hashing into buckets and counting are compiled
    each = _hashed(w).select(F.explode(ngrams()).alias("g")).select(F.pmod("g", F.lit(buckets)).cast("int").alias("b"))
    return each.groupBy("b").agg(F.count("*").alias("n"))


def multinomials(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> dict[int, tuple[int, int]]:
    """bucket -> (count over all documents, count over the target). At most `buckets` entries of either come to the driver.

    target_ids (doc_id) may be of any size; rows that repeat count once. Documents without an id are not of the target.
    Only texts that may be of the target are shuffled, to meet their ids."""
    docs = docs.select("doc_id", "text")
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    # the join is the same at all sizes: a broadcast of ids would be one of unknown size
    target = _may_be(docs, ids).join(ids.hint("merge"), "doc_id", "left_semi")
    both = _counts(docs, buckets).select("b", "n", F.lit(0).cast("long").alias("m")).unionByName(_counts(target, buckets).select("b", F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    return {r.b: (r.n, r.m) for r in both.groupBy("b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}


def weights(counts: dict[int, tuple[int, int]], buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[int]:
    """log(target share / raw share) of each bucket in millionths."""
    raw, target = sum(n for n, _ in counts.values()), sum(m for _, m in counts.values())
    out = []
    for b in range(buckets):
        n, m = counts.get(b, (0, 0))
        p = (m + smoothing * max(1, target) / buckets) / (max(1, target) * (1 + smoothing))
        q = (n + smoothing * max(1, raw) / buckets) / (max(1, raw) * (1 + smoothing))
        out.append(round(1e6 * math.log(p / q)) if target else 0)
    return out


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, hw, h2 (hashes of words and pairs), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    d = _worded(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_WS))) > 0)
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # windows of eight words from pairs of fours, those from pairs of twos
    d = _hashed(d).withColumn("h4", _joined("h2", 2))
    d = d.withColumn("h", F.slice(_joined("h4", 4), F.lit(1), F.greatest(F.size("hw") - 7, F.lit(0))))
    # most texts repeat no window; only for the others are the windows sorted
    tagged = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), tagged))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter(F.transform("s", lambda x, i: F.when(same(x, F.get("s", i + 1)) | same(x, F.get("s", i - 1)), x["i"])), lambda x: x.isNotNull())
    d = d.withColumn("at", F.when(F.col("s").isNotNull(), F.array_sort(again)))
    # every window covers eight words, less what the next one covers as well
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(8), F.coalesce(F.get("at", i + 1) - x, F.lit(8)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.select(
        "doc_id", "hw", "h2", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def judge(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr_millionths (per n-gram)."""
    table = weights(multinomials(docs, target_ids, buckets), buckets, smoothing)
    # a literal of known size, folded to an array when the plan is made
    weight = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    # one row an n-gram again; a document's rows are summed where they arise, so one row a document is shuffled
    stats = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    each = base_rules(docs).withColumn("row", F.monotonically_increasing_id()).select("row", *stats, F.explode_outer(ngrams()).alias("g"))
    d = each.groupBy("row", *stats).agg(F.coalesce(F.sum(F.get(weight, F.pmod("g", F.lit(buckets)).cast("int")).cast("long")), F.lit(0)).alias("total"))
    d = d.withColumn("llr_millionths", F.when(F.col("n_words") > 0, F.floor(F.col("total") / (2 * F.col("n_words") - 1))).otherwise(F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("llr_millionths") >= round(threshold * 1e6))
    return d.select(*stats, kept.alias("kept"), "llr_millionths")
