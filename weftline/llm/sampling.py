"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Labels whose counts are sent to all tasks at most.
FEW_LABELS = 10_000


def fold(key, n: int):
    """crc32 of the key's text modulo n."""
    return F.crc32(F.col(key).cast("string")) % n if isinstance(key, str) else F.crc32(key.cast("string")) % n


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int) -> list[tuple]:
    """At most per_label keys for each label, as (key, label) pairs on the driver; labels in ascending order, keys in that of a hash.

    Counting comes first; a label's share then sets a hash bound that lets about twice per_label rows through, so no task
    sorts more, and the driver gets no more, than a small multiple of per_label a label."""
    rows = rows.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").distinct()
    counts = rows.groupBy("y").agg(F.count("*").alias("n"))
    held = counts.limit(FEW_LABELS + 1).collect()
    if len(held) <= FEW_LABELS:  # else labels are many and none is most of the rows' key
        counts = F.broadcast(rows.sparkSession.createDataFrame(held, counts.schema))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_label + 50) / F.col("n"))
    near = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("k"), 33)).join(counts, "y").where(F.col("h") <= share * (1 << 31)).orderBy("y", "h", "k").select("k", "y").collect()
    taken: dict = {}
    out = []
    for r in near:
        taken[r.y] = taken.get(r.y, 0) + 1
        if taken[r.y] <= per_label:
            out.append((r.k, r.y))
    return out


def rows_of(docs: DataFrame, key: str, chosen: list[tuple], label_name: str, label_type: str) -> DataFrame:
    """The documents of a bounded sample with the sampled label; the sample is broadcast, its bound being known."""
    spark = docs.sparkSession
    picked = spark.createDataFrame(chosen, f"{key} {dict(docs.dtypes)[key]}, {label_name} {label_type}")
    return docs.join(F.broadcast(picked), key)
