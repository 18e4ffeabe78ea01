"""Reading and writing JSON lines with checks."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines: file, text and two keys; splits: the number of lines before each part of a file that a task reads by itself).

    Tasks count the lines of their parts; sums over the parts before give the first number of each, so no file goes through one task and
    no line is shuffled. number_of() turns keys into line numbers, for as many lines as are asked about."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.groupBy("file", "_b").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return lines, splits.select("file", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def number_of(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """lines with `line`, the number within the file from 1 on, blank lines counted."""
    return lines.join(splits, ["file", "_b"]).withColumn("line", F.col("_before") + F.col("_i") - F.col("_first") + 1).drop("_b", "_i", "_first", "_before")


_NUMBERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _problems(value: object, kind: T.DataType, path: str, field: T.StructField | None, unknown: list[str], invalid: list[str]) -> None:
    """Adds the paths of fields that the type does not know, and of values that it does not allow."""
    if value is None:
        return
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            invalid.append(path)
            return
        at = lambda name: f"{path}.{name}" if path else name
        unknown += [at(k) for k in value if k not in kind.names]
        for f in kind.fields:
            if value.get(f.name) is None:
                if not f.nullable:
                    invalid.append(at(f.name))
            else:
                _problems(value[f.name], f.dataType, at(f.name), f, unknown, invalid)
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            invalid.append(path)
            return
        for i, x in enumerate(value):
            if x is None and not kind.containsNull:
                invalid.append(f"{path}[{i}]")
            _problems(x, kind.elementType, f"{path}[{i}]", field, unknown, invalid)
    elif isinstance(kind, T.MapType):
        if not isinstance(value, dict):
            invalid.append(path)
            return
        for k, x in value.items():
            _problems(x, kind.valueType, f"{path}.{k}", field, unknown, invalid)
    else:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if isinstance(kind, T.StringType):
            ok = isinstance(value, str)
        elif isinstance(kind, T.BooleanType):
            ok = isinstance(value, bool)
        elif type(kind) in _NUMBERS:
            ok = number and isinstance(value, int) and -(1 << (_NUMBERS[type(kind)] - 1)) <= value < 1 << (_NUMBERS[type(kind)] - 1)
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            ok = number
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            ok = isinstance(value, str) and _dated(value, isinstance(kind, T.DateType))
        else:
            ok = True
        if not ok or field is not None and field.metadata.get("enum") and value not in field.metadata["enum"]:
            invalid.append(path)


def _dated(text: str, day: bool) -> bool:
    try:
        (datetime.date if day else datetime.datetime).fromisoformat(text)
    except ValueError:
        return False
    return True


def _reasons(schema: T.StructType):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                try:
                    value = json.loads(text)
                except ValueError:
                    out.append("bad JSON" if text.startswith("{") else "not an object")
                    continue
                unknown, invalid = [], []
                if isinstance(value, dict):
                    _problems(value, schema, "", None, unknown, invalid)
                    out.append(f"unknown field: {','.join(unknown)}" if unknown else f"invalid field: {','.join(invalid)}" if invalid else None)
                else:
                    out.append("not an object")
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records by schema, rejected lines: file, line, text, reason) of JSON lines; blank lines and a leading byte-order mark are skipped.

    A line is rejected if it is no JSON object, if a field that must not be null is missing, if a value is of another type or none of its
    field's metadata `enum`, or if a field is unknown: at any depth, by its path (a.b[0].c; unknown fields are told first). `line` is the
    number within the file, blank lines counted, for files that many tasks read as well."""
    lines, splits = numbered_lines(spark, path)
    text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    told = lines.select("file", "_b", "_i", text.alias("text")).where(F.length("text") > 0).withColumn("_reason", _reasons(schema)("text"))
    free = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    good = told.where("_reason is null").select(F.from_json("text", free, {"mode": "PERMISSIVE"}).alias("_j")).select("_j.*")
    bad = number_of(told.where("_reason is not null"), splits)
    return good, bad.select("file", F.col("line").cast("long").alias("line"), "text", F.col("_reason").alias("reason"))


def require_records(good: DataFrame, rejected: DataFrame) -> DataFrame:
    """good, or an error that names a rejected line, or that there is no record at all. Two small jobs."""
    first = rejected.limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}: line {first[0].line}: {first[0].reason}: {first[0].text[:80]}")
    if good.isEmpty():
        raise ValueError("no valid record")
    return good


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order. What was at path is deleted first, so a job that fails leaves nothing there."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_folders(files: DataFrame, path: str) -> None:
    """Each row (folder, name, value) as the file path/folder/name, which tasks write in place; whoever writes it again writes the same.

    Spark's own writer makes, renames and sets the rights of a folder and two files for each of many small ones, which takes far longer."""
    uri = re.sub(r"^file:/+", "file:///", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder, name, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system.create_dir(f"{root}/{folder}")
                with system.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    texts = files.select(*[F.col(c).cast("string").alias(c) for c in ("folder", "name", "value")])
    texts.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root)  # there may be no file


def read_folders(spark: SparkSession, path: str, names: list[str], place: str = r"([^/]+)/([^/]+)$") -> DataFrame:
    """folder and one column a name (without its ending): the text of that file in the folder, null where there is none.

    path: a folder of such folders at any depth, which tasks list, or a glob, which the driver expands; files fit a task each. place: a pattern of a file's path with its folder and name. All are listed and read in one
    pass, and a folder has as many rows as it has files."""
    conf, name = spark.conf, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    kept = conf.get(name)
    conf.set(name, str(8 * spark.sparkContext.defaultParallelism))  # else a task for each folder, up to 10,000
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    finally:
        conf.set(name, kept)
    files = files.select("value", F.col("_metadata.file_path").alias("_f"))
    at = files.select(F.regexp_extract("_f", place, 1).alias("folder"), F.regexp_extract("_f", place, 2).alias("_name"), "value").where(F.col("folder") != "")
    return at.groupBy("folder").agg(*[F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n.rsplit(".", 1)[0]) for n in names])
