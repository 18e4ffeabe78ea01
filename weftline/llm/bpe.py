"""Byte-level BPE through a global shuffle of distinct pre-tokens, and decoding by the token-byte table.

Encoding has three steps. (1) Each run of documents (a *sheaf*: one Arrow batch, at most SHEAF_BYTES of text) is
split into pre-tokens; what leaves the task is every distinct pre-token of the sheaf once, in buckets by its
hash, and for each document the positions as compact references to them. (2) Buckets meet by shuffle, so equal
pre-tokens of all sheaves are in one bucket, and each distinct pre-token is merged once. Frequent pre-tokens are
no hot key: a sheaf sends each at most once. (3) Ids go back to their sheaf and are set in by position.

Nulls and empty texts have no ids. Rows that repeat (also with the same doc_id) each give a row. Extra columns
do not pass. An empty table gives an empty table. Very long texts make a sheaf of their own.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import small_batches, tidy

#: Distinct pre-tokens that a task holds with their ids.
KNOWN = 1_000_000
#: Bytes of text whose distinct pre-tokens leave a task together.
SHEAF_BYTES = 6 << 20


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a tiktoken file (base64, space, rank); its size is the vocabulary's."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_coders: dict = {}


def _coder(name: str, ranks: dict[bytes, int], pattern: str):
    import tiktoken

    if name not in _coders:
        _coders[name] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[name]


def _splitter(pattern: str):
    import regex

    # White space as Unicode has it, which is what the pattern's own engine takes \s for.
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def _pack(refs: np.ndarray) -> bytes:
    """References in one byte below 255, two more below 65,535 more, four more beyond."""
    a = np.minimum(refs, 255).astype(np.uint8)
    rest = refs[refs >= 255] - 255
    b = np.minimum(rest, 65535).astype(np.uint16)
    c = (rest[rest >= 65535] - 65535).astype(np.uint32)
    return np.array([len(a), len(b)], np.uint32).tobytes() + a.tobytes() + b.tobytes() + c.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, m = np.frombuffer(data, np.uint32, 2)
    refs = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    rest = np.frombuffer(data, np.uint16, m, 8 + n).astype(np.int64)
    far = np.frombuffer(data, np.uint32, -1, 8 + n + 2 * m)
    rest[rest == 65535] += far
    refs[refs == 255] += rest
    return refs


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 3)


def _open(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


LINES = "sheaf long, mark long, doc_id long, refs binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PARTS = "sheaf long, mark long, bucket int, refs binary, lens binary, words binary"


def _sheaves(pattern: str, buckets: int, lines: bool):
    """Rows of LINES, one a document, or of PARTS, one a bucket of a sheaf. Both passes number a sheaf's pre-tokens alike; mark tells if they did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        findall = _splitter(pattern).findall
        part, made = TaskContext.get().partitionId(), 0

        def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            sheaf, made = part << 32 | made, made + 1
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__
            refs = [np.fromiter(map(number.__getitem__, findall(text or "")), np.int64) for _, text in held]
            names = list(number)
            seen = np.array([len(names), sum(map(len, refs))], np.int64)
            mark = xxhash.xxh64_intdigest(seen.tobytes() + "\x00".join(names[:: max(1, len(names) // 4096)]).encode()) >> 1
            if lines:
                # frequent first, so that most references take one byte
                counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *refs]), minlength=len(names))
                place = np.empty(len(counts), np.int64)
                place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
                n = len(held)
                order = np.argsort(-counts, kind="stable").astype(np.uint32)
                # the first row of a sheaf also holds which pre-token has which place
                packed = [_squeeze_bytes(_pack(place[r])) for r in refs]
                ids = [*(d for d, _ in held), None]
                yield pa.RecordBatch.from_arrays([pa.array([sheaf] * (n + 1), pa.int64()), pa.array([mark] * (n + 1), pa.int64()), pa.array(ids, pa.int64()), pa.array([*packed, b"order" + _squeeze(order)], pa.binary())], names=["sheaf", "mark", "doc_id", "refs"])
                return
            coded = [w.encode() for w in names]
            of = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in coded), np.int64, len(coded))
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    own = sorted(by[cut[b] : cut[b + 1]].tolist(), key=coded.__getitem__)  # like words side by side squeeze well
                    lens = np.array([len(coded[i]) for i in own], np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([sheaf], pa.int64()), pa.array([mark], pa.int64()), pa.array([b], pa.int32()), pa.array([_squeeze(np.array(own, np.uint32))], pa.binary()), pa.array([_squeeze(lens)], pa.binary()), pa.array([_squeeze_bytes(b"".join(coded[i] for i in own))], pa.binary())], names=["sheaf", "mark", "bucket", "refs", "lens", "words"])

        held, size = [], 0
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((d, text))
                size += len(text or "")
                if size >= SHEAF_BYTES:
                    yield from close(held)
                    held, size = [], 0
        if held:
            yield from close(held)

    return run


def _squeeze_bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 3)


def _merge(name: str, ranks, pattern: str):
    """Distinct pre-tokens of a bucket to their ids, each merged once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _coder(name, ranks.value, pattern)._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            lens, ids = [], []
            for sizes, words in zip(batch.column("lens").to_pylist(), batch.column("words").to_pylist(), strict=True):
                got, at, words = [], 0, _open(words)
                for n in np.frombuffer(_open(sizes), np.uint32).tolist():
                    w, at = words[at : at + n], at + n
                    if (x := known.get(w)) is None:
                        if len(known) >= KNOWN:  # a bucket of more distinct pre-tokens than a task should hold merges some again
                            known.clear()
                        x = known[w] = np.array(one(w), np.uint32).tobytes()
                    got.append(x)
                lens.append(_squeeze(np.fromiter(map(len, got), np.uint32, len(got)) // 4))
                ids.append(_squeeze_bytes(b"".join(got)))
            yield pa.RecordBatch.from_arrays([batch.column("sheaf"), batch.column("mark"), batch.column("refs"), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], names=["sheaf", "mark", "refs", "lens", "ids"])

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lens[i]] for all i, end to end."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1])]


def _set_in(docs: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    if set(docs["mark"]) | set(parts["mark"]) != set(docs["mark"].iloc[:1]):
        raise ValueError("the documents differed between two passes over them")
    is_order = docs["refs"].map(lambda x: x[:5] == b"order")
    order = np.frombuffer(_open(docs["refs"][is_order].iloc[0][5:]), np.uint32).astype(np.int64)
    join = lambda c: np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(_open(x), np.uint32) for x in parts[c]]])
    number, lens, ids = join("refs").astype(np.int64), join("lens").astype(np.int64), join("ids").view(np.int32)
    starts, length = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    starts[number], length[number] = np.cumsum(lens) - lens, lens
    starts, length = starts[order], length[order]
    docs = docs[~is_order]
    out = []
    for x in docs["refs"]:
        refs = _unpack(_open(x))
        out.append(_gather(ids, starts[refs], length[refs]))
    return pd.DataFrame({"doc_id": docs["doc_id"], "ids": out})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, stored: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text, without special tokens.

    With digests, the ids are decoded in the task that has set them in, and DIGESTS stands in place of the ids.

    Documents are read twice. stored: they come straight from files, in the same order each time; else they are written to
    the shared folder first."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(ranks)  # its bound is the vocabulary
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not stored:
        from ..shared import durable

        texts = durable(texts, "bpe-texts")
    name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    words = texts.mapInArrow(tidy(_sheaves(pattern, n, False)), PARTS).repartition(n, "bucket")
    merged = words.mapInArrow(tidy(_merge(name, shared, pattern)), "sheaf long, mark long, refs binary, lens binary, ids binary")
    lines = texts.mapInArrow(tidy(_sheaves(pattern, n, True)), LINES)
    if digests:
        table = token_table(ranks)
        tables = spark.sparkContext.broadcast((table, ragged([b"%d," % i for i in range(len(table[2]))])))
        run, schema = lambda docs, parts: _digests(_set_in(docs, parts), *tables.value), DIGESTS
    else:
        run, schema = _set_in, "doc_id long, ids array<int>"
    return lines.groupBy("sheaf").cogroup(merged.groupBy("sheaf")).applyInPandas(run, schema)


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, with start and length by id."""
    size = max(ranks.values(), default=-1) + 1
    by_id = [b""] * size
    for token, i in ranks.items():
        by_id[i] = token
    return ragged(by_id)


def ragged(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lens) - lens, lens


def _decoded(runs: list[np.ndarray], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """The bytes of each run of ids."""
    values, starts, lens = table
    return (_gather(values, starts[r], lens[r]).tobytes() for r in runs)


def _digests(encoded: pd.DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray], decimals: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    """Digests of the ids, by the decimals of each with a comma, and of their bytes."""
    runs = list(encoded["ids"])
    said = [hashlib.sha256(x[:-1]).hexdigest() for x in _decoded(runs, decimals)]
    return pd.DataFrame({"doc_id": encoded["doc_id"], "n_tokens": [len(r) for r in runs], "ids_sha256": said, "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in _decoded(runs, table)]})


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, decoded binary: the token-byte table (one row an id, bounded by the vocabulary) joined by id in each task."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            off, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            raw = list(_decoded([flat[off[i] : off[i + 1]] for i in range(len(col))], shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return encoded.mapInArrow(tidy(run), "doc_id long, decoded binary")
