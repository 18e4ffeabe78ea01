"""Rows that repeat an id or have none, bytes of archives, and what the registered queries return."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import archive, line_dedup, queries, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_lines(rows, sites):
    """What stays of each row, by its place in the list; equal rows lose the same lines."""
    seen = {}
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if bare(x):
                seen.setdefault(bare(x), set()).add(s)
    common = {x for x, s in seen.items() if len(s) >= sites}
    return common, {(i, t): sum(bare(x) in common for x in (t or "").split("\n")) for i, t, _ in rows}


def test_lines_go_by_row_and_not_by_id(spark):
    menu = "menu home"
    rows = [(None, f"A0\nA1\n{menu}", "s0"), (None, f"B0\n{menu}\nB2", "s1"), (None, "C0\nC1\nC2", "s2"), (100, f"{menu}\nx\nunique line", "s3"), (100, f"p\nunique too\n{menu}", "s4"), (100, f"p\nunique too\n{menu}", "s4")]
    rows += [(200 + i, f"{menu}\nown {i}", f"t{i}") for i in range(6)] + [(None, None, "s0"), (None, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("id", F.lit("clash"))
    got = line_dedup.remove_boilerplate(df).collect()
    assert len(got) == len(rows)
    told = Counter((r.doc_id, r.text) for r in got)
    first = [r for r in got if r.text and menu in r.text.split("\n")]
    assert len(first) == 1 and first[0].doc_id is None  # null ids come before all others
    for i, text, _ in rows:
        left = None if text is None else "\n".join(x for x in text.split("\n") if x != menu)
        assert told[(i, left)] or told[(i, text)], (i, text)  # nothing but the menu is lost
    assert sum(r._wl_removed for r in got) == sum((t or "").split("\n").count(menu) for _, t, _ in rows) - 1


def test_random_lines_against_brute_force(spark):
    r = random.Random(9)
    words = [f"line {i}" for i in range(30)]
    rows = [(r.choice([None, *range(25)]), "\n".join(r.choice(words + [f"own {k}", " ", "line 1 "]) for _ in range(r.randint(1, 6))), f"s{r.randint(0, 9)}") for k in range(200)]
    common, count = plain_lines(rows, 4)
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=4).collect()
    kept = Counter(x.strip() for g in got for x in g.text.split("\n") if x.strip() in common)
    # each common line stays once; equal rows count as one, so it may stay in all of them
    copies = Counter((i, t) for i, t, _ in rows)
    assert set(kept) == common and all(n <= max(copies.values()) for n in kept.values())
    own = Counter(x.strip() for _, t, _ in rows for x in t.split("\n") if x.strip() and x.strip() not in common)
    assert Counter(x.strip() for g in got for x in g.text.split("\n") if x.strip() and x.strip() not in common) == own


def test_archive_bytes_are_parsed_back(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>\r\n\r\nWARC/1.1 no header"), (None, "http://n/", "<p>x</p>"), (None, "http://n/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (1, "http://c/", "é\n"), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    archive.write_archive(df, folder)
    held = archive.read_archive(spark, folder).collect()
    names = [line for r in held for line in r.header.split("\r\n") if line.startswith("WARC-Record-ID: ")]
    assert len(names) == len(rows) == len(set(names))  # every record has one, and its own
    archive.write_warc(spark, folder, f"file://{tmp_path}/w", records_per_file=2)
    back = archive.read_warc(spark, f"file://{tmp_path}/w/*.txt").collect()
    assert Counter((r.header, bytes(r.content) + b"\r\n\r\n") for r in back) == Counter((r.header, bytes(r.record)[len(r.header.encode()) :]) for r in held)
    ids = {r.record_id: r for r in back}
    for r in back:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        if r.refers_to:
            assert ids[r.refers_to].record_type == "response" and ids[r.refers_to].payload_digest == r.payload_digest
    assert {r.page_id: r.refers_to for r in held if r.record_type == "revisit"} == {None: 1, 1: 1}
    index = archive.read_index(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == Counter((r.page_id, len(r.payload), r.payload_digest, r.record_type, r.refers_to) for r in held)
    (tmp_path / "w/cut.txt").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(Exception, match="not as long"):
        archive.read_warc(spark, f"file://{tmp_path}/w/cut.txt").collect()


def test_empty_archive(spark, tmp_path):
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert archive.read_archive(spark, f"file://{tmp_path}/e").count() == 0 == archive.read_index(spark, f"file://{tmp_path}/e").count()


def test_url_rules_by_either_join(spark, monkeypatch):
    rows = [(i, f"http://site{i % 7}.example.{['net', 'org', 'com'][i % 3]}/{['fr', 'de', 'en'][i % 5 % 3]}/{i}") for i in range(300)] + [(900, None), (901, "no scheme"), (902, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(map(tuple, url_rules.judge(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()))
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, url_rules.judge(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect())) == want
    assert len(want) == len(rows)


def test_contracts_of_registered_queries(spark, tmp_path):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
    good = lambda: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, good() if i % 2 else "!! " + " ".join(w.upper() for w in good().split()), "en", "s", 1) for i in range(120)] + [(None, good(), "en", "s", 1), (500, None, "en", None, None), (501, "", None, "s", 0), (502, "123 456", "en", "s", 7)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("i1", " ".join(good().split()[:12])), ("i2", rows[1][1])], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    crc = lambda i, n: zlib.crc32(str(i).encode()) % n
    for name, n, out in (("op3_quality", 5, 0), ("op9_toxicity", 4, 2), ("op1_language_id", 3, 1)):
        got = queries.QUERIES[name](spark, d).collect()
        assert len(got) == len(rows), name
        for g in got:
            assert g.held_out is (g.doc_id is not None and crc(g.doc_id, n) == out) and 0 <= g.score <= 1
            if name != "op1_language_id":
                assert g.predicted == int(g.score >= 0.3)
            else:
                assert g.lang_pred == ("und" if g.doc_id in (500, 501, 502) else "en")
    got = {g.doc_id: g for g in queries.op2_decontaminate(spark, d).collect()}
    assert len(got) == len(rows) and got[1].contaminated and got[1].n_items == 1 and got[1].n_hit == 30 and got[500].n_words == 0
    four = {g.doc_id: g for g in queries.op4_quality_rules(spark, d).collect()}
    assert four[500].n_words == 0 and four[500].base_failed and not four[500].kept and four[1].n_words == 30
    five = queries.op5_jaccard_join(spark, d).collect()
    assert {g.doc_id for g in five} == {i for i, *_ in rows if i is not None} and all(g.component_id <= g.doc_id for g in five)
    ten = {g.doc_id: g for g in queries.op10_byte_bpe(spark, d).collect()}
    assert len(ten) == len(rows) and ten[500].n_tokens == 0 == ten[501].n_tokens
