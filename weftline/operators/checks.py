"""Table checks: duplicate keys, manifests, differences, unsafe values, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str, line: str) -> DataFrame:
    """Every later occurrence of a key with its line and the first one's."""
    first = df.groupBy(key).agg(F.min(line).alias("first_line"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(first, key).where(F.col(line) > F.col("first_line")).select(key, "first_line", F.col(line).alias("line"))


def manifest(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n_rows"))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and three order-free combinations of row hashes (120 bits of each row's SHA-256): a sum and two exclusive ors.

    A value goes in with its length, a null as a sign of its own, so neither nulls nor where a value ends can be mistaken."""
    mark = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(c).cast("string"), F.lit(":"), c))
    row = F.sha2(F.concat(*[mark(F.col(c).cast("string")) for c in columns]), 256)
    part = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("long")
    return df.select(part(1).alias("a"), part(16).alias("b")).agg(F.count("*").alias("n_rows"), F.sum(F.col("a") % 1_000_000_007).alias("hash_sum"), F.bit_xor("a").alias("hash_xor"), F.bit_xor("b").alias("hash_xor2"))


def diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each differing column of each key; a key of one side differs in all its columns."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key, "full")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]))
    return j.select(key, F.explode(unlike).alias("column"))


def unsafe_values(df: DataFrame, key: str, text: str, marks: list[str]) -> DataFrame:
    """Rows that hold a mark (case-folded), each with all its marks in the order given."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in marks]))
    return df.select(key, found.alias("marks")).where(F.size("marks") > 0)


def keep_first(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def coverage(df: DataFrame, dimensions: list[str], user: str) -> DataFrame:
    """Rows and distinct users of every value of every dimension, in one pass."""
    sets = [[F.col(d)] for d in dimensions]
    got = df.groupingSets(sets, *dimensions).agg(F.count("*").alias("n_rows"), F.count_distinct(F.col(user)).alias("n_users"), F.grouping_id().alias("g"))
    which = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(dimensions) for x in ((1 << len(dimensions)) - 1 - (1 << (len(dimensions) - 1 - i)), d)]), F.col("g").cast("int"))
    return got.select(which.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n_rows", "n_users")


def opaque_ids(df: DataFrame, key: str, prefix: str, salt: str, version: str) -> DataFrame:
    """key, opaque id, and whether another key has the same."""
    named = df.select(key, F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:{version}:"), F.col(key).cast("string")), 256), 1, 16)).alias("opaque_id"))
    clash = named.groupBy("opaque_id").agg((F.count_distinct(F.col(key)) > 1).alias("clashes"))
    return named.join(clash, "opaque_id").select(key, "opaque_id", "clashes")


def unknown_ids(df: DataFrame, id: str, known: DataFrame, known_id: str) -> DataFrame:
    """Ids that are not known, whatever their case and outer spaces, with their rows."""
    folded = lambda c: F.lower(F.trim(F.col(c)))
    used = df.groupBy(folded(id).alias("id")).agg(F.count("*").alias("n_rows"))
    return used.join(known.select(folded(known_id).alias("id")).distinct(), "id", "left_anti")
