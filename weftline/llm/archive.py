"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: `payloads` (address, payload: the bytes once for each distinct SHA-256
and length) and `records` (one row a record: its exact header block, the address of its payload, the payload's size).
Original records come back through the join on the address; each payload is hashed again on reading, and a mismatch
fails the read. Of records with equal payloads of at least min_bytes, the one with the least page_id is a response and
the others are revisits that refer to it; smaller payloads are stored once too, but all their records are responses.

Each row of pages is a record with a WARC-Record-ID of its own: the page_id and the number of the row, so rows that repeat a page_id or
have none are told apart. write_warc() lays an archive out as WARC files, and read_warc() parses such files back from their bytes.

A null html is an empty payload, a null url an empty target. Of several rows with the same payload and least page_id, the first by url and
row is the response; null page_ids come last. Extra columns are not stored. An empty table makes an empty archive. A payload has to fit a
task's memory, as its row does. Any payload may have any number of records: what is sent to all tasks is the small rows of the commonest ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import split_join
from ..shared import durable
from .components import _spread

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of all records unless the caller has one; an archive of the same pages is then the same bytes.
DATE = "2024-01-01T00:00:00Z"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("payload").to_pylist()
        sha1 = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]
        address = [hashlib.sha256(x).hexdigest() + f"-{len(x)}" for x in raw]
        keep = [batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sha1, pa.string()), pa.array(address, pa.string()), pa.array([len(x) for x in raw], pa.int64())], names=[*batch.schema.names, "payload_digest", "address", "payload_bytes"])


def _kind(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = DATE) -> None:
    """Write a record for each row of pages (page_id, url, html) to the archive in folder, which must be new."""
    id_type = _kind(pages, "page_id")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    tagged = rows.mapInArrow(_digests, f"page_id {id_type}, url string, payload binary, payload_digest string, address string, payload_bytes long")
    # each distinct payload once: copies are dropped before the shuffle as far as a task sees them, and by address after it
    tagged.select("address", "payload").dropDuplicates(["address"]).write.parquet(f"{folder}/payloads")
    heads = durable(tagged.drop("payload").withColumn("row", F.monotonically_increasing_id()), "heads")
    own = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url", "row")
    first = heads.groupBy("address").agg(F.min(own).alias("least"))
    joined = _spread(heads, first, "address", "inner")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("row") != F.col("least.row"))
    marked = joined.select("page_id", "row", "url", "address", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("least.page_id")).alias("refers_to"), F.when(revisit, F.col("least.row")).alias("refers_row"))
    encoded = lambda c: F.coalesce(F.url_encode(c.cast("string")), F.lit(""))
    name = lambda c, row: F.concat(F.lit("<urn:page:"), encoded(c), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"), "row")), F.concat(F.lit("WARC-Date: "), F.lit(date)), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""))]
    lines += [F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to"), "refers_row")), F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: " + PROFILE)), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(revisit_length(), F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"))]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))  # null lines are left out
    marked.select("page_id", head.alias("header"), "address", "payload_bytes").write.parquet(f"{folder}/records")


def revisit_length():
    return F.col("record_type") == "revisit"


def _field(name: str):
    return F.nullif(F.regexp_extract("header", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for address, x in zip(batch.column("address").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if hashlib.sha256(x).hexdigest() + f"-{len(x)}" != address:
                raise ValueError(f"payload {address} is not what its address says")
            digests.append(base64.b32encode(hashlib.sha1(x).digest()).decode())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "sha1"])


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records, payloads = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/payloads")
    return records, payloads.mapInArrow(_verified, "address string, payload binary, sha1 string")


def _told(got: DataFrame, id_type: str) -> list:
    """record_type, payload_digest and refers_to, as the header says; an error if the digest is not that of the payload."""
    said = F.regexp_extract("header", r"WARC-Payload-Digest: sha1:(\w+)", 1)
    ref = F.regexp_extract("header", r"(?m)^WARC-Refers-To: <urn:page:([^:>]*):[0-9]+>\r?$", 1)
    digest = F.when(said == F.col("sha1"), said).otherwise(F.raise_error(F.concat(F.lit("digest of a record differs from its payload: "), "address")))
    return [_field("WARC-Type").alias("record_type"), digest.alias("payload_digest"), F.nullif(F.url_decode(ref), F.lit("")).cast(id_type).alias("refers_to")]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header, payload_bytes, record_type, payload_digest, refers_to: of every record, with its payload verified where it lies."""
    records, checked = _read(spark, folder)
    measured = durable(checked.select("address", "sha1", F.octet_length("payload").cast("long").alias("measured")), "measured")
    got = _spread(records, measured, "address", "inner")
    return got.select("page_id", "header", F.col("measured").alias("payload_bytes"), *_told(got, _kind(records, "page_id")))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, header, payload, record_type, payload_digest, refers_to, record (the bytes as they stand in a WARC file).

    The payload of a revisit is the one it refers to; its record, as the format has it, holds the headers alone."""
    records, checked = _read(spark, folder)
    got = split_join(records, checked, "address", ["header"], ["address"])
    crlf = F.encode(F.lit("\r\n\r\n"), "utf-8")
    body = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "utf-8")).otherwise(F.col("payload"))
    return got.select("page_id", "header", "payload", *_told(got, _kind(records, "page_id")), F.concat(F.encode("header", "utf-8"), body, crlf).alias("record"))


def write_warc(spark: SparkSession, folder: str, out: str, records_per_file: int = 10_000) -> None:
    """The archive's records as WARC files of at most records_per_file records. Payloads have to be text in UTF-8, as html is."""
    text = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "utf-8")
    read_archive(spark, folder).select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(out)


def _records(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, content) of each record of a WARC file; content is as long as the header says."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end].decode()
        if not header.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        size = next(int(x.split(":", 1)[1]) for x in header.split("\r\n") if x.lower().startswith("content-length:"))
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not as long as it says")
        yield header, data[end : end + size]
        at = end + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, header, record_id, record_type, refers_to (a record id), target, payload_digest, content of every record, parsed from bytes.

    A file has to fit a task's memory. A file that is cut or has other bytes between records is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                heads, contents = zip(*_records(data), strict=True) if data else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(heads), pa.string()), pa.array(heads, pa.string()), pa.array(contents, pa.binary())], names=["file", "header", "content"])

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, header string, content binary")
    return got.select("file", "header", *[_field(n).alias(c) for n, c in (("WARC-Record-ID", "record_id"), ("WARC-Type", "record_type"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target"), ("WARC-Payload-Digest", "payload_digest"))], "content")
