"""Joins that Spark has no operator for, as equi-joins: overlapping lists under several filters, dates within intervals.

Keys may be hot on either side. split_join deals the rows of a hot key over parts on both sides; which keys are hot is
counted first, and there are at most 2 * HOT of them however many the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable

#: A key is hot if more than one in HOT rows of a side have it.
HOT = 2_000
#: Rows of a key that are never too many for a task.
LEAST = 1_000
#: Ids of a class stand together in pieces of about so many.
PIECE = 500
#: So many ids, in the buckets of their date on all levels, and so many pairs of classes at most are sent to all tasks.
BROADCAST_IDS = 4_000_000
BROADCAST_PAIRS = 50_000
#: Of all pairs of a row of either side, so many fall to a task.
PAIRS_A_TASK = 200_000_000


def split_join(left: DataFrame, right: DataFrame, key: str, left_by: list[str], right_by: list[str], hot: int = HOT, least: int = LEAST) -> DataFrame:
    """Inner join on key. A hot key's rows are dealt over a x b parts: left rows go to one of a and meet all b, right rows likewise.

    left_by, right_by: columns that tell a side's rows apart, by which they are dealt. Rows without a key join nothing. Both sides are read twice: once to count their keys."""
    n_left, n_right = left.groupBy(key).agg(F.count("*").alias("_l")), right.groupBy(key).agg(F.count("*").alias("_r"))
    share_l, share_r = (max(least, -(-(df.agg(F.sum(c)).first()[0] or 0) // hot)) for df, c in ((n_left, "_l"), (n_right, "_r")))
    much = n_left.join(n_right, key).where((F.col("_l") > share_l) | (F.col("_r") > share_r))
    dealt = F.broadcast(much.select(key, F.ceil(F.col("_l") / share_l).cast("int").alias("_a"), F.ceil(F.col("_r") / share_r).cast("int").alias("_b")))
    far = lambda df: df.join(dealt, key, "left")
    part = lambda n, by: F.when(F.col(n) > 1, F.pmod(F.xxhash64(*by), F.col(n)).cast("int")).otherwise(0)  # noqa: E731  the same in every attempt
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    a = far(left).withColumn("_i", part("_a", left_by)).withColumn("_j", every("_b")).drop("_a", "_b")
    b = far(right).withColumn("_j", part("_b", right_by)).withColumn("_i", every("_a")).drop("_a", "_b")
    # written keys of few values make small files of many rows: by their size Spark would send these whole through the driver
    return a.join(b.hint("merge"), [key, "_i", "_j"]).drop("_i", "_j")


@dataclass
class Overlap:
    """A filter that holds if the asked list and the document's share an element.

    asks: whether a query filters at all (else it holds); lacks: whether a document passes without any element (null: it does not)."""

    name: str
    asked: Column
    have: Column
    asks: Column
    lacks: Column | None = None


_ANY, _NONE, _SEPARATOR = "*", "-", "\x1f"


def _product(lists: list[Column]) -> Column:
    """All ways of taking one element of each array<string>, as arrays."""
    def longer(heads: Column, more: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(more, lambda x: F.concat(head, F.array(x)))))

    out = F.transform(lists[0], lambda x: F.array(x))
    for more in lists[1:]:
        out = longer(out, more)
    return out


def overlap_join(queries: DataFrame, documents: DataFrame, filters: list[Overlap], query_id: str, document_id: str, holds: Column | None = None) -> DataFrame:
    """Pairs of a query and a document that pass all filters and `holds`, a condition on the pair's columns.

    Queries that ask the same, and documents that have the same lists, are one row each while lists are compared. An inverted index over
    combinations does that: a document stands under every combination of one element of each filtered list, for each set of filters that
    some query uses; a query looks its own combinations up. So all filters are met by one equi-join. Lists that share several elements
    meet several times; what counts is the least one shared. Then lists are opened to their queries and documents again, so only
    pairs that pass all filters are ever made. Lists are compared as text; null elements share nothing. The two sides' column names
    must differ."""
    text = lambda c: F.array_sort(F.transform(F.array_distinct(F.array_compact(c)), lambda x: F.concat(F.lit("="), x.cast("string"))))
    none, n = F.array().cast("array<string>"), range(len(filters))
    asks = [F.when(F.coalesce(f.asks, F.lit(False)), F.coalesce(text(f.asked), none)).alias(f"_ask{i}") for i, f in enumerate(filters)]
    lacks = [F.lit(False) if f.lacks is None else F.coalesce(f.lacks, F.lit(False)) for f in filters]
    have = [F.when(lacks[i], F.array(F.lit(_NONE))).otherwise(F.coalesce(text(f.have), none)).alias(f"_have{i}") for i, f in enumerate(filters)]
    sign = lambda name: F.concat_ws(_SEPARATOR, *[F.coalesce(F.array_join(f"{name}{i}", "\x1e"), F.lit(_ANY)) for i in n])
    q, d = queries.select("*", *asks).withColumn("_q", sign("_ask")), documents.select("*", *have).withColumn("_d", sign("_have"))
    asked, index = (df.groupBy(s).agg(*[F.first(f"{name}{i}").alias(f"{name}{i}") for i in n]) for df, s, name in ((q, "_q", "_ask"), (d, "_d", "_have")))
    asked = asked.withColumn("_pattern", F.concat(*[F.when(F.col(f"_ask{i}").isNull(), "0").otherwise("1") for i in n]))
    used = sorted(r["_pattern"] for r in asked.select("_pattern").distinct().collect())  # at most two to the number of filters
    keys = [F.when(F.col(f"_ask{i}").isNull(), F.array(F.lit(_ANY))).otherwise(F.concat(f"_ask{i}", F.array(F.lit(_NONE))) if f.lacks is not None else F.col(f"_ask{i}")) for i, f in enumerate(filters)]
    asked = asked.withColumn("_combo", F.explode(_product(keys))).withColumn("_key", F.concat_ws(_SEPARATOR, "_pattern", F.array_join("_combo", _SEPARATOR))).drop("_pattern")

    def keyed(p: str) -> Column:
        lists = [F.col(f"_have{i}") if p[i] == "1" else F.array(F.lit(_ANY)) for i in n]
        return F.transform(_product(lists), lambda c: F.concat_ws(_SEPARATOR, F.lit(p), F.array_join(c, _SEPARATOR)))

    index = index.withColumn("_key", F.explode(F.concat(*[keyed(p) for p in used]) if used else none))
    asked, index = durable(asked, "lists-asked"), durable(index, "lists-indexed")  # split_join reads both twice
    met = split_join(asked, index, "_key", ["_q"], ["_d"])
    for i in n:
        one = F.get("_combo", F.lit(i))
        met = met.where(one.isin(_ANY, _NONE) | (one == F.array_min(F.array_intersect(f"_ask{i}", f"_have{i}"))))
    met = durable(met.select("_q", "_d"), "lists-met")
    mine = split_join(met, q.select(*queries.columns, "_q"), "_q", ["_d"], [query_id])
    got = split_join(mine, d.select(*documents.columns, "_d"), "_d", [query_id], [document_id])
    got = got if holds is None else got.where(holds)
    return got.drop("_q", "_d")


def class_of(columns: list) -> Column:
    """A digest of columns that decide together; rows that agree in all of them are of one class (nulls agree with nulls)."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))


def class_pairs(queries: DataFrame, documents: DataFrame, filters: list[Overlap], holds: Column) -> DataFrame:
    """Distinct (qc, dc) whose rows pass overlap_join's filters and `holds`; the sides have their class beside the columns it is made of."""
    asked, had = durable(queries.dropDuplicates(["qc"]), "query-classes"), durable(documents.dropDuplicates(["dc"]), "document-classes")
    pairs = overlap_join(asked, had, filters, "qc", "dc", holds)
    return durable(pairs.select("qc", "dc"), "class-pairs")


def open_classes(pairs: DataFrame, queries: DataFrame, documents: DataFrame, query_id: str, document_id: list[str]) -> DataFrame:
    """Pairs of classes opened to their queries and documents; hot classes are dealt over parts."""
    mine = split_join(pairs, queries, "qc", ["dc"], [query_id])
    return split_join(mine, documents, "dc", [query_id], document_id).drop("qc", "dc")


def sent_join(left: DataFrame, right: DataFrame, on: list[str], small: bool, left_by: list[str], right_by: list[str]) -> DataFrame:
    """Inner join on columns of which some may be hot on both sides: the right side goes to all tasks if it is small, else keys are dealt."""
    if small:
        return left.join(F.broadcast(right), on)
    key = F.struct(*on).alias("_on")
    return split_join(left.withColumn("_on", key), right.select(key, *[c for c in right.columns if c not in on]), "_on", left_by, right_by).drop("_on")


def _pieces(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, _ids: the ids of each group, null ones and repeats included, in pieces of about PIECE."""
    much = F.broadcast(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > PIECE))  # a PIECE-th of the rows at most
    part = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / PIECE)), F.lit(0))
    without = F.array_repeat(F.lit(None).cast(rows.schema[key].dataType), F.count_if(F.col(key).isNull()).cast("int"))
    return rows.join(much, by, "left").groupBy(*by, part.alias("_part")).agg(F.concat(F.collect_list(key), without).alias("_ids")).drop("_part")


_UNDATED = "-"


def _dated(days: Days, queries: DataFrame, at: str) -> DataFrame:
    """queries with `_key`, the buckets of their date; one without a date is within all intervals, and has a bucket of its own."""
    return days.looked_up(queries, at).unionByName(queries.where(F.col(at).isNull()).withColumn("_key", F.lit(_UNDATED)))


def _cut(days: Days, intervals: DataFrame, start: str, end: str) -> DataFrame:
    return days.cut(intervals, start, end).unionByName(intervals.withColumn("_key", F.lit(_UNDATED)))


def dated_pairs(queries: DataFrame, documents: DataFrame, pairs: DataFrame, at: str, start: str, end: str, query_id: str, document_id: str, by: list[str] | None = None, but: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id) of all rows whose classes (qc, dc) are among `pairs` and whose dates meet: start <= at <= end, null is open.

    by: further columns of documents that come along. but: pairs of ids that are left out.
    Only pairs that are in the result are ever made, and none is shuffled: ids stand in pieces under their class and bucket of days, pieces
    are joined, and a task opens both lists of a joined row as its last step; a document has the ids that it is not to be paired with
    beside its own. Work before that grows with rows and pairs of classes."""
    days, ends, by = Days.of(queries, at), F.struct(start, end).alias("_ends"), by or []
    mine = durable(_pieces(_dated(days, queries.select("qc", at, query_id), at), ["qc", "_key"], query_id).withColumnRenamed("_ids", "_mine"), "query-pieces")
    told = documents.select("dc", *by, ends, document_id)
    if but is not None:
        without = but.groupBy(F.col(document_id).alias("_of")).agg(F.collect_set(query_id).alias("_but"))
        told = told.join(without, F.col(document_id) == F.col("_of"), "left").select("dc", *by, "_ends", F.struct(F.col(document_id).alias("_d"), "_but").alias(document_id))
    told = _pieces(told, ["dc", *by, "_ends"], document_id)
    tasks = queries.count() * documents.count() // PAIRS_A_TASK
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, tasks))
    told = _cut(days, told, f"_ends.{start}", f"_ends.{end}").select("dc", *by, "_key", "_ids").repartition(tasks, "_key", "_ids")  # few bytes make many pairs
    met = sent_join(told, pairs, ["dc"], pairs.count() <= BROADCAST_PAIRS, ["_key", "_ids"], ["qc"])
    few = (mine.agg(F.sum(F.size("_mine"))).first()[0] or 0) <= BROADCAST_IDS
    met = sent_join(met, mine, ["qc", "_key"], few, ["dc", "_ids"], ["_mine"])
    opened = met.select("_mine", *by, F.explode("_ids").alias(document_id))
    if but is None:
        return opened.select(F.explode("_mine").alias(query_id), document_id, *by)
    opened = opened.select(F.explode("_mine").alias(query_id), document_id, *by).where(~F.coalesce(F.array_contains(f"{document_id}._but", F.col(query_id)), F.lit(False)))
    return opened.select(query_id, F.col(f"{document_id}._d").alias(document_id), *by)


def dated_totals(queries: DataFrame, documents: DataFrame, pairs: DataFrame, at: str, start: str, end: str, by: list[str]) -> DataFrame:
    """queries by n, the number of documents in each group (columns `by`, which a class has in common) that dated_pairs would pair them with.

    No pair is made: documents are counted by class and bucket of days, counts are added up by class of queries, and a date by its buckets."""
    days, ends = Days.of(queries, at), F.struct(start, end).alias("_ends")
    counts = documents.groupBy("dc", *by, ends).agg(F.count("*").alias("n"))
    counts = _cut(days, counts, f"_ends.{start}", f"_ends.{end}").groupBy("dc", *by, "_key").agg(F.sum("n").alias("n"))
    met = sent_join(counts, pairs, ["dc"], pairs.count() <= BROADCAST_PAIRS, ["_key"], ["qc"]).groupBy("qc", "_key", *by).agg(F.sum("n").alias("n"))
    on = F.struct("qc", at).alias("_on")  # dates may be null
    told = _dated(days, queries.select("qc", at).distinct(), at).join(met, ["qc", "_key"]).groupBy(on, *by).agg(F.sum("n").alias("n"))
    return queries.withColumn("_on", on).join(told, "_on").drop("_on")


@dataclass
class Days:
    """A hierarchy of buckets of days, numbered from the first point's; a bucket of a level holds two of the one below."""

    lo: int
    hi: int

    @classmethod
    def of(cls, points: DataFrame, at: str) -> Days:
        span = points.agg(F.min(_day(at)).alias("lo"), F.max(_day(at)).alias("hi")).first()
        return cls(0, -1) if span["lo"] is None else cls(span["lo"], span["hi"])

    @property
    def levels(self) -> int:
        return max(0, self.hi - self.lo + 1).bit_length()

    def cut(self, intervals: DataFrame, start: str, end: str) -> DataFrame:
        """intervals with `_key`, the fewest buckets that make up each: two of a level at most. Empty ones have no row."""
        a = F.greatest(F.lit(0), F.coalesce(_day(start) - self.lo, F.lit(0)))
        b = F.least(F.lit(self.hi - self.lo + 1), F.coalesce(_day(end) - self.lo + 1, F.lit(self.hi - self.lo + 1)))  # the first day after it
        cut = intervals.withColumn("_from", a).withColumn("_to", b).where("_from < _to")

        def taken(level: int) -> Column:
            size = 1 << level
            left, right = F.ceil(F.col("_from") / size).cast("int"), F.floor(F.col("_to") / size).cast("int")
            bucket = lambda i: F.concat(F.lit(f"{level}:"), i.cast("string"))
            odd = lambda n: F.pmod(n, F.lit(2)) == 1
            return F.array(F.when((left < right) & odd(left), bucket(left)), F.when((left < right) & odd(right), bucket(right - 1)))

        steps = F.array(*[taken(i) for i in range(self.levels + 1)])
        return cut.withColumn("_key", F.explode(F.array_compact(F.flatten(steps)))).drop("_from", "_to")

    def looked_up(self, points: DataFrame, at: str) -> DataFrame:
        """points with `_key`, their bucket on every level; those without a date have no row."""
        n = _day(at) - self.lo
        return points.where(F.col(at).isNotNull()).withColumn("_key", F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.shiftright(n, i).cast("string")) for i in range(self.levels + 1)])))


def _day(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date"))


def interval_join(intervals: DataFrame, start: str, end: str, points: DataFrame, at: str, by: tuple[str, str]) -> DataFrame:
    """Pairs of an interval and a point with start <= at <= end; dates, both ends inclusive, a null end is open.

    An interval is cut into the fewest buckets of a hierarchy, and a point looks up its bucket on every level. So all is met by one
    equi-join on level and bucket, long intervals have few buckets, and no pair is met twice. by: the columns that tell intervals, and
    points, apart. Points without a date and
    intervals that end before they start meet nothing."""
    days = Days.of(points, at)
    return split_join(days.looked_up(points, at), days.cut(intervals, start, end), "_key", [by[1]], [by[0]]).drop("_key")


def interval_totals(intervals: DataFrame, start: str, end: str, points: DataFrame, at: str, value: str) -> DataFrame:
    """intervals with n, first, last and total: the number of points within, their first and last date, and the sum of a column of theirs.

    The same pairs as interval_join's, of which none is made: points are added up by day, then by bucket, and an interval adds up the few
    buckets that it is cut into. Intervals with the same ends are one while that is done. An interval without a point has no row."""
    days = Days.of(points, at)
    daily = points.groupBy(at).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    buckets = days.looked_up(daily, at).groupBy("_key").agg(F.sum("n").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.sum("total").alias("total"))
    ends = F.struct(start, end).alias("_ends")
    cut = days.cut(intervals.select(start, end).distinct(), start, end)
    told = cut.join(F.broadcast(buckets), "_key")  # at most two buckets a day
    told = told.groupBy(ends).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("total").alias("total"))
    return intervals.withColumn("_ends", ends).join(told, "_ends").drop("_ends")
