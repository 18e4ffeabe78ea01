"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing.

A encodes space + text by a byte-level BPE vocabulary, B encodes text by a piece model that puts the space in front itself.
Where both give back the bytes of space + text, each token is an interval of bytes. All A and B tokens of a block of
documents are sorted by start; the running maximum of their ends breaks them into groups where a start reaches it, which is
at the offsets where tokens of both end. Within a group, every A token is paired with the B tokens whose bytes it overlaps.

Counts of id pairs over the corpus: each *sheaf* (a run of documents, SHEAF_BYTES of text) sends each of its distinct pairs
once, with its number of documents there, so a frequent pair is no hot key; sums and each A id's highest go back to the
sheaves, where documents refer to pairs by number.

Texts that are null, empty, or that either tokenizer does not give back whole have no tokens: no groups, all counts zero.
Each row is a document of its own, rows that repeat or have a null doc_id too. Extra columns do not pass. An empty table gives
an empty table. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable
from .memory import small_batches, tidy

#: Bytes of text whose distinct pairs leave a task together, and those that are laid out at a time.
SHEAF_BYTES = 6 << 20
BLOCK_BYTES = 1 << 20
_U = np.uint64


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file (JSON), whose ids have to be in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    # the characters that stand for bytes: printable ones for themselves, the others from U+0100 on in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {x["content"] for x in told["added_tokens"] if x["special"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    merged = [told["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    if merged != list(range(256, 256 + len(merged))):
        raise ValueError("ids are not in the order of the merges")
    return ranks


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of each piece by id."""
    import re

    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Tokenizers:
    """A: ranks of a byte-level BPE and the pattern before it; B: a piece model's bytes. Sent to tasks, which open them once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.pattern, self.model = pattern, model
        self.a = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.a[i] = token
        self.b = piece_bytes(model)
        self.name = hashlib.sha256(repr((self.a, pattern)).encode() + model).hexdigest()


_open: dict[str, tuple] = {}


def _coders(t: Tokenizers):
    import sentencepiece
    import tiktoken

    if t.name not in _open:
        a = tiktoken.Encoding("given", pat_str=t.pattern, mergeable_ranks={x: i for i, x in enumerate(t.a) if x}, special_tokens={})
        _open[t.name] = (a, sentencepiece.SentencePieceProcessor(model_proto=t.model), pa.array(t.a, pa.binary()), pa.array(t.b, pa.binary()))
    return _open[t.name]


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The entries of ids end to end, and where each begins (one more for the end)."""
    got = table.take(pa.array(ids, pa.int32()))
    at = np.frombuffer(got.buffers()[1], np.int32, len(got) + 1, got.offset * 4) if len(got) else np.zeros(1, np.int32)
    return memoryview(got.buffers()[2] or b"").cast("B"), at


def coalesce(starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the intervals by start (A before B), and the number of each one's group in that order."""
    order = np.lexsort((kind, starts))
    first, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = first[1:] >= reach[:-1]
    return order, np.cumsum(new) - 1


class Block:
    """The tokens of some texts: ids and bounds of all A and of all B tokens, text by text (at_a, at_b), groups and links."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        a_coder, b_coder, a_bytes, b_bytes = _coders(t)
        said = [text or "" for text in texts]
        a = [a_coder.encode_to_numpy(" " + x).astype(np.int32) if x else np.zeros(0, np.int32) for x in said]
        b = [np.array(x, np.int32) for x in b_coder.encode(said, num_threads=1)] if said else []
        raw = [(" " + x).encode() if x else b"" for x in said]
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(x) for x in ids])
            data, at = _joined(table, np.concatenate([np.zeros(0, np.int32), *ids]))
            cut = at[np.concatenate([[0], ends]).astype(np.int64)].tolist()
            for i, x in enumerate(raw):
                if x is not None and data[cut[i] : cut[i + 1]] != x:
                    raw[i] = None
        none = np.zeros(0, np.int32)
        a, b = [x if raw[i] else none for i, x in enumerate(a)], [x if raw[i] else none for i, x in enumerate(b)]
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in (a, b))
        # bytes are numbered through all texts, so no group and no link crosses from one text into another
        self.a_at, self.b_at = _joined(a_bytes, self.a)[1].astype(np.int64), _joined(b_bytes, self.b)[1].astype(np.int64)
        kind = np.concatenate([np.zeros(len(self.a), np.int8), np.ones(len(self.b), np.int8)])
        starts, ends = np.concatenate([self.a_at[:-1], self.b_at[:-1]]), np.concatenate([self.a_at[1:], self.b_at[1:]])
        self.order, self.group = coalesce(starts, ends, kind)
        self.kind = kind[self.order]
        # within a group, the tokens of one kind follow those of the other
        self.order = self.order[np.argsort(self.group * 2 + self.kind, kind="stable")]
        self.kind = kind[self.order]
        self.at = self.at_a + self.at_b  # the same tokens in that order, text by text
        heads = np.flatnonzero(np.diff(self.group, prepend=-1)) if len(self.group) else np.zeros(0, np.int64)
        self.n_groups = np.diff(np.searchsorted(heads, self.at))
        # the B tokens that each A token overlaps are neighbours
        low = np.searchsorted(self.b_at[1:], self.a_at[:-1], "right")
        many = np.searchsorted(self.b_at[:-1], self.a_at[1:], "left") - low
        self.link_a = np.repeat(np.arange(len(self.a)), many)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(low - np.cumsum(many) + many, many)
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(many)])[self.at_a])

    def pairs(self) -> np.ndarray:
        """A id << 32 | B id of each link."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)

    def said(self, table: pa.Array, n_a: int) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text. table: each id (B's after A's) with each of the signs , | ; behind it."""
        id_ = np.where(self.kind == 0, 0, n_a) + np.concatenate([self.a, self.b])[self.order]
        sign = np.full(len(id_), 2)
        if len(id_) > 1:
            same = self.group[1:] == self.group[:-1]
            sign[:-1] = np.where(same, np.where(self.kind[1:] == self.kind[:-1], 0, 1), 2)
        data, at = _joined(table, id_ * 3 + sign)
        cut = at[self.at].tolist()
        return [bytes(data[x : max(x, y - 1)]) for x, y in zip(cut, cut[1:], strict=False)]


def _signed(n_a: int, n_b: int) -> pa.Array:
    return pa.array([b"%d%s" % (i, s) for n in (n_a, n_b) for i in range(n) for s in (b",", b"|", b";")], pa.binary())


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(d)
            texts.append(text)
            held += len(text or "")
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


GROUPS = "array<struct<start: long, end: long, a: array<int>, b: array<int>>>"


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id, groups: of each document, its groups in order with their bounds in the bytes of space + text and both ids."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizers)  # its bound is that of the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _blocks(batches):
            k, out = Block(shared.value, texts), []
            of, heads = k.order, np.flatnonzero(np.diff(k.group, prepend=-1))
            value = np.concatenate([k.a, k.b])[of]
            start, end = np.concatenate([k.a_at[:-1], k.b_at[:-1]])[of], np.concatenate([k.a_at[1:], k.b_at[1:]])[of]
            last = np.append(heads[1:], len(of))
            for i in range(len(ids)):
                base = start[k.at[i]] if k.at[i] < k.at[i + 1] else 0
                g = range(*np.searchsorted(heads, k.at[i : i + 2]).tolist())
                cut = [(heads[j], heads[j] + int((k.kind[heads[j] : last[j]] == 0).sum()), last[j]) for j in g]
                out.append([{"start": start[x] - base, "end": end[z - 1] - base, "a": value[x:y], "b": value[y:z]} for x, y, z in cut])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id long, groups {GROUPS}")


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(b"".join(x.tobytes() for x in arrays), 3)


def _halves(data: bytes, kinds: tuple) -> list[np.ndarray]:
    """The arrays of equal length that were squeezed together."""
    import zstandard

    raw = zstandard.decompress(data)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: A row a document, with its distinct pairs as numbers in the sheaf and how often it links each; and a row a sheaf (doc is
#: false), with its distinct pairs and the number of its documents that hold each.
LAID = "sheaf long, doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary"


def _lay(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part, made = shared.value, TaskContext.get().partitionId(), 0
        table = _signed(len(t.a), len(t.b))
        number, docs, held = pd.Index([], dtype="int64"), np.zeros(0, np.int64), 0

        def close() -> pa.RecordBatch:
            pair = number.to_numpy()
            row = [part << 32 | made, False, None, None, None, None, None, None, _squeeze((pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), docs.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kind, strict=True)], schema=kind)

        kind = pa.schema([("sheaf", pa.int64()), ("doc", pa.bool_()), *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("refs", pa.binary())])
        for ids, texts in _blocks(batches, min(size, BLOCK_BYTES)):
            k, n = Block(t, texts), len(ids)
            code, own = pd.factorize(k.pairs())
            at = number.get_indexer(own)
            new = at < 0
            at[new] = len(number) + np.arange(new.sum())
            number = number.append(pd.Index(own[new], dtype="int64"))
            of = np.repeat(np.arange(n), k.n_links)
            held_by, keys = pd.factorize(of * max(1, len(own)) + code)
            times = np.bincount(held_by, minlength=len(keys)).astype(np.int32)
            holder, refs = keys // max(1, len(own)), at[keys % max(1, len(own))].astype(np.int32)
            docs = np.concatenate([docs, np.zeros(new.sum(), np.int64)]) + np.bincount(refs, minlength=len(number))
            cut = np.searchsorted(holder, np.arange(n + 1))  # a text's pairs were met one after another
            packed = [_squeeze(refs[x:y], times[x:y]) if x < y else b"" for x, y in zip(cut, cut[1:], strict=False)]
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in k.said(table, len(t.a))]
            cols = [[part << 32 | made] * n, [True] * n, ids, np.diff(k.at_a), np.diff(k.at_b), k.n_groups, k.n_links, digests, packed]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, kind, strict=True)], schema=kind)
            held += sum(len(x or "") for x in texts)
            if held >= size:
                yield close()
                number, docs, held, made = pd.Index([], dtype="int64"), np.zeros(0, np.int64), 0, made + 1
        if held or len(number):
            yield close()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sheaf, refs in zip(batch.column("sheaf").to_pylist(), batch.column("refs").to_pylist(), strict=True):
            a, b, n = _halves(refs, (np.int32, np.int32, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), sheaf)), pa.array(np.arange(len(a), dtype=np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["sheaf", "i", "a", "b", "n"])


COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    total[pairs["i"]], best[pairs["i"]] = pairs["total"], pairs["best"]
    sums = []
    for x in docs["refs"]:
        refs, times = _halves(x, (np.int32, np.int32)) if x else (np.zeros(0, np.int32),) * 2
        sums.append((int(best[refs] @ times.astype(np.int64)), int(total[refs] @ times.astype(np.int64))))
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
    out["n_best"], out["count_sum"] = [x for x, _ in sums], [y for _, y in sums]
    out["groups_sha256"] = docs["groups_sha256"]
    return out


def link_counts(docs: DataFrame, tokenizers: Tokenizers, sheaf_bytes: int = SHEAF_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents as in COUNTS; and a, b, total, best: each id pair, the documents that link it, and whether no pair of a has more.

    Texts are encoded once; what documents need later is written to the shared folder in packed form."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizers)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    laid = durable(rows.mapInArrow(tidy(_lay(shared, sheaf_bytes)), LAID), "aligned")
    each = laid.where("not doc").select("sheaf", "refs").mapInArrow(tidy(_unpacked), "sheaf long, i int, a int, b int, n int")
    # an A id has no more pairs than B has ids
    summed = each.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("total"))
    pairs = durable(summed.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("a"))), "pairs")
    back = each.join(pairs, ["a", "b"]).select("sheaf", "i", "total", F.col("best").cast("int").alias("best"))
    told = laid.where("doc").drop("doc").groupBy("sheaf").cogroup(back.groupBy("sheaf")).applyInPandas(_told, COUNTS)
    return told, pairs
