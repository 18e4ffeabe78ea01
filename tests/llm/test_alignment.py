"""Token alignment against a plain walk over both tokenizers' own output, and edge cases of its parts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import alignment, queries

TEXTS = [
    "The quick brown fox.", "naïve café — résumé", "  two  spaces\tand\n\nlines ", "", None, "<|endoftext|> is text", "<s> </s> <unk>", "日本語のテキスト", "😀😃 emoji", "▁low line", "a", " ", "1234567 3.14", "don't you're", "﷽ ligature ﬁ",
]


@pytest.fixture(scope="module")
def known():
    P = queries.tokenizers()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return alignment.Tokenizers(alignment.byte_level_ranks(P.path("byte_bpe_50k.json")), P.PATTERN, f.read())


def plain(texts):
    """(A tokens, B tokens, groups, links) of each text, by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    P = queries.tokenizers()
    a_coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain_bytes} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain_bytes)}
    out = []
    for text in texts:
        a, b = [], []
        if text:
            e = a_coder.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            pieces = [(i, b_coder.id_to_piece(i)) for i in b_coder.encode(text)]
            b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in pieces]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        spans = []
        for tokens in (a, b):
            at, rows = 0, []
            for i, x in tokens:
                rows.append((at, at + len(x), i))
                at += len(x)
            spans.append(rows)
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append(tuple([i for s, t, i in rows if low <= s and t <= cut] for rows in spans))
            low = cut
        links = [(i, j) for s, t, i in spans[0] for u, v, j in spans[1] if s < v and u < t]
        out.append((spans[0], spans[1], groups, links))
    return out


def check(rows, got):
    told = plain([t for _, t in rows])
    count = Counter(p for *_, links in told for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    want = []
    for (d, _), (a, b, groups, links) in zip(rows, told):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    assert sorted(map(repr, (tuple(g) for g in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("sheaf", [alignment.SHEAF_BYTES, 100])
def test_alignment_against_a_plain_walk(spark, known, sheaf):
    r = random.Random(2)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choice(["alpha", "Beta", "γάμμα", "x=1;", "the", "of", "日本"]) for _ in range(r.randint(1, 40)))) for i in range(60)]
    rows += [(100, rows[20][1]), (None, rows[21][1]), (7000, "word " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    got, pairs = alignment.link_counts(df, known, sheaf)
    check(rows, got.collect())
    assert pairs.groupBy("a", "b").count().where("count > 1").count() == 0


def test_groups_and_their_bounds(spark, known):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r.groups for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    for (d, text), (a, b, groups, _) in zip(rows, plain([t for _, t in rows])):
        assert [(g.a, g.b) for g in got[d]] == [tuple(x) for x in groups]
        if groups:
            assert [g.start for g in got[d]] == [0, *(g.end for g in got[d][:-1])] and got[d][-1].end == len((" " + text).encode())
    assert len(got[0]) > 3 and got[3] == [] and got[4] == []


def test_coalescing_by_hand():
    # A: 0-3 3-4 4-9, B: 0-2 2-4 4-6 6-9
    starts, ends, kind = np.array([0, 3, 4, 0, 2, 4, 6]), np.array([3, 4, 9, 2, 4, 6, 9]), np.array([0, 0, 0, 1, 1, 1, 1])
    order, group = alignment.coalesce(starts, ends, kind)
    assert starts[order].tolist() == [0, 0, 2, 3, 4, 4, 6] and group.tolist() == [0, 0, 0, 0, 1, 1, 1]


def test_no_documents(spark, known):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(none, known)[0].count() == 0 and alignment.align(none, known).count() == 0


def test_registered_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_alignment(spark, str(tmp_path))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", "string")]
    check(rows, got.collect())
