"""Edge cases and brute-force comparisons of the text operators on small fixtures."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import archive, bpe, components, decontaminate, jaccard, language, line_dedup, quality_model, quality_rules, queries, toxicity, url_rules

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeghilmnoprstu") for _ in range(R.randint(2, 7))) for _ in range(120)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [text(60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s1"), (21, base[1] + " tail end", "en", "s2"), (22, " ".join(base[2].split()[:50]), "en", "s0"), (22, " ".join(base[2].split()[:50]), "en", "s0")]
    rows += [(30, None, None, None), (31, "", "en", "s0"), (32, "  \n\t ", "en", "s0"), (33, "one two", "en", "s1"), (34, "one two", "fr", "s1"), (35, text(5000), "en", "s0"), (None, text(9), "en", "s0")]
    # columns whose names clash with those the operators make
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n int, component_id string")


LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_jaccard_against_all_pairs(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOW))
        sets[r.doc_id] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    least = {i: i for i in sets}
    for _ in range(5):
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    least[a] = min(least[a], least[b])
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert got[20][1] == 0 and got[34][1] == 33 and got[31] == (0, 31)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_large_block_in_pieces(spark, monkeypatch):
    base = text(60).split()
    rows = [(i, " ".join(base[:i % 40 + 3] + [f"v{i}"] + base[i % 40 + 3 :])) for i in range(60)] + [(100 + i, text(40)) for i in range(5)]
    monkeypatch.setattr(jaccard, "PIECE", 7)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[100 + i] == 100 + i for i in range(5))


def test_jaccard_counts_and_gives_all_links(spark, monkeypatch):
    base = text(60).split()
    rows = [(i, " ".join(base[: i % 40 + 3] + [f"v{i}"] + base[i % 40 + 3 :])) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (51, rows[3][1]), (60, " ".join(base[:48])), (61, text(40)), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, w in ((i, (t or "").split()) for i, t in rows)}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    n = Counter(i for p in want for i in p)
    assert len(want) > 100
    for piece in (jaccard.PIECE, 7):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
        assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i in sets}
        forest = jaccard.near_duplicates(df, links=False)
        assert {r.doc_id: r.component_id for r in forest.collect()} == {i: r.component_id for i, r in got.items()} and forest.columns == ["doc_id", "n_shingles", "component_id"]
        links, members = ([tuple(r) for r in x.collect()] for x in jaccard.pairs(df))
        of = {}
        for i, rep in members:
            of.setdefault(rep, []).append(i)
        said = [(min(x, y), max(x, y)) for a, b in links for x in of[a] for y in of[b]] + [(x, y) for c in of.values() for x in c for y in c if x < y]
        assert sorted(said) == sorted(want)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (5, 4)], "a long, b long")
    assert {r.node: r.component for r in components.components(e).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_components_of_a_chain_and_a_hub(spark):
    n = 3000
    chain = [(i + 1, i) for i in range(n)]  # each edge in another place, so tasks see pieces of it
    hub = [(10_000, 10_001 + i) for i in range(n)]
    R.shuffle(chain)
    e = spark.createDataFrame(chain + hub + [(50_001, 50_000)], "a long, b long").repartition(40)
    got = {r.node: r.component for r in components.components(e).collect()}
    assert len(got) == 2 * n + 4 and {got[i] for i in range(n + 1)} == {0} and {got[10_000 + i] for i in range(n + 1)} == {10_000} and got[50_001] == 50_000
    assert components.components(e.limit(0)).count() == 0


def test_decontaminate_against_windows(spark, docs):
    some = docs.where("doc_id in (0, 5)").orderBy("doc_id").collect()
    long, short = " ".join(some[0].text.split()[10:35]).upper() + "!", " ".join(some[1].text.split()[3:6])
    bench = [(1, long), (2, short), (3, None), (4, " .,- "), (5, long), (6, text(12))]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pat.findall((t or "").translate(LOW))
    for r in docs.collect():
        w, hit, items = split(r.text), set(), set()
        for i, t in bench:
            x = split(t)
            n = min(10, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    items.add(str(i))
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g["items"], g.contaminated) == (len(w), len(hit), sorted(items), bool(hit)), r.doc_id
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == docs.select("doc_id").distinct().count()


def test_language(spark):
    a, b = ["lo re mi ta so", "mi ta lo so re"] * 3, ["kunz wex brog pfuk", "brog kunz pfuk wex"] * 3
    rows = [(i, t, "aa") for i, t in enumerate(a)] + [(i + 50, t, "bb") for i, t in enumerate(b)] + [(90, None, "aa"), (91, "12 34 !", "bb"), (92, "", None), (93, "wex kunz", None), (93, "wex kunz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df).collect()
    said = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and [said[i] for i in (0, 50, 90, 91, 92, 93)] == ["aa", "bb", "und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    m = language.Model({"x": ["abcab"]}, 100)
    phrases, _ = language._parse(m, ["abcabcab"], {})
    assert phrases[0, 0] == 3  # abcab | cab | the separator after each text
    # no language and no text is left out for its number or length, and extra columns do not clash
    many = spark.createDataFrame([(i, " ".join(chr(0x3400 + 40 * (i % 80) + R.randrange(40)) for _ in range(60 if i else 20_000)), f"l{i % 80:02d}") for i in range(400)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language.fit(many)
    assert model.langs == [f"l{i:02d}" for i in range(80)] and len(model.symbols) > 3000
    assert all(r.lang_pred == r.lang for r in language.predict(many, model).join(many.select("doc_id", "lang"), "doc_id").collect())
    assert language.identify(df.limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["abcd", "".join(chr(0x4E00 + i) for i in range(700))])
def test_language_phrases_against_naive_longest_matches(letters):
    word = lambda: "".join(R.choice(letters) for _ in range(R.randint(1, 5)))
    samples = {lang: [" ".join(word() for _ in range(150)) for _ in range(3)] for lang in "xyz"}
    m = language.Model(samples, 10_000)
    texts = [" ".join(word() for _ in range(n)) + tail for n, tail in ((1, ""), (40, " 12 Q!"), (200, "É"), (90, ""))] + ["", None, "..."] + [samples["y"][1]]
    phrases, size = language._parse(m, texts, {})
    for k, lang in enumerate(m.langs):
        held = bytes(language._codes("\n".join(samples[lang]), m.symbols))
        for i, t in enumerate(texts):
            low, codes = (t or "").lower(), []
            for c in low + "\n":
                if c.isalpha():
                    codes += m.symbols.get(c, (m.width - 1,))
                elif not codes or codes[-1]:
                    codes.append(0)
            n = 0
            for at in range(0, len(codes), language.STRETCH):
                part, j = bytes(codes[at : at + language.STRETCH]), 0
                while j < len(part):
                    e = j + 1
                    while e <= len(part) and part[j:e] in held:
                        e += 1
                    j, n = max(j + 1, e - 1), n + 1
            if any(c.isalpha() for c in low):
                assert phrases[k, i] == n, (lang, i)
    assert size[4] == size[5] == size[6] == 0


def test_bpe_round_trip_and_ids(spark, docs):
    import tiktoken

    P = queries.tokenizers()
    ranks = bpe.load_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    more = spark.createDataFrame([(70, "It's  a test\n\n    x \x1c y\x85z 12ab½ <|endoftext|> \U0001f600 "), (71, " "), (71, " ")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    enc = bpe.encode(df, ranks, P.PATTERN)
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(tok.encode_ordinary(r.text or ""))) for r in df.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in enc.collect()) == want
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(enc, ranks).collect()) == Counter((r.doc_id, r.text or "") for r in df.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    said = Counter(tuple(r) for r in bpe.encode(df, ranks, P.PATTERN, digests=True).collect())
    assert said == Counter((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(tok.decode_bytes(list(ids)))) for d, ids in want.elements())


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  menu home \n\nown {i}", f"s{i}") for i in range(7)] + [(50, "menu home", None), (51, None, "s1"), (52, "", "s1")] + [(60 + i, "few sites", "s1") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(3))
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(df).collect()}
    assert len(got) == len(rows) and "line" in df.columns
    assert got[0].text == rows[0][1] and got[3].text == "own 3\n\nown 3" and got[3]._wl_removed == 1
    assert got[50].text == "" and got[51].text is None and got[52].text == "" and got[60].text == "few sites"


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (2, None, None), (4, "u\r\nv", ""), (5, "http://c/", "é" * 5000), (1, "http://b/", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("clash"))
    archive.write_archive(df, f"file://{tmp_path}/a")
    got = archive.read_archive(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == 6 and spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == 3
    by = Counter((r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in got)
    assert by == Counter([(3, "<p>x</p>", "revisit", 1), (1, "<p>x</p>", "response", None), (1, "<p>x</p>", "revisit", 1), (2, "", "response", None), (4, "", "revisit", 2), (5, "é" * 5000, "response", None)])
    for r in got:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
    archive.write_archive(df, f"file://{tmp_path}/b", min_bytes=1)
    assert {r.page_id: r.record_type for r in archive.read_archive(spark, f"file://{tmp_path}/b").collect()}[4] == "response"


def test_quality_rules_counts(spark, docs):
    rows = [(80, " ".join(["a b c d e f g h i j"] * 4) + "\nx # $\nx # $\n \n"), (81, "é   z")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = quality_rules.judge(df, spark.createDataFrame([(0,), (1,)], "doc_id long")).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    for r in df.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        g = by[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (g.base_failed and g.kept)


def test_quality_rules_target_is_all_good_documents(spark, tmp_path):
    # every document is good, so target and raw shares agree in every bucket, however many labels there are
    df = spark.range(4200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some own w"), F.col("id").cast("string")).alias("text"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id", F.lit(1).alias("quality")).union(spark.createDataFrame([(7, 1), (None, 1)], "doc_id long, quality int")).write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op4_quality_rules(spark, str(tmp_path)).where("llr_millionths <> 0").count() == 0


def test_quality_rules_score_by_brute_force(spark):
    rows = [(i, text(40)) for i in range(12)] + [(50, ""), (51, None), (52, text(40)), (52, text(25))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = [1, 2, 5, 52, 999]
    buckets, smoothing = 64, 0.01
    got = quality_rules.judge(df, spark.createDataFrame([(i,) for i in [*target, 5, None]], "doc_id long"), buckets=buckets).collect()
    every = sorted({w for _, t in rows for w in (t or "").split()})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for _, t in rows for a, b in zip((t or "").split(), (t or "").split()[1:], strict=False)})
    h2 = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = lambda t: [h[w] % buckets for w in (t or "").split()] + [h2[h[a], h[b]] % buckets for a, b in zip((t or "").split(), (t or "").split()[1:], strict=False)]
    raw, own = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        own.update(grams(t) if i in target else [])
    share = lambda c, b: (c[b] + smoothing * c.total() / buckets) / (c.total() * (1 + smoothing))
    weight = [round(1e6 * math.log(share(own, b) / share(raw, b))) for b in range(buckets)]
    want = Counter((i, math.floor(sum(weight[b] for b in grams(t)) / len(grams(t))) if grams(t) else 0) for i, t in rows)
    assert Counter((r.doc_id, r.llr_millionths) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr_millionths >= round(quality_rules.THRESHOLD * 1e6)) for r in got)


def test_quality_model_training_is_plain_ftrl():
    import numpy as np
    import pandas as pd

    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(30)]
    y = [r.randint(0, 1) for _ in texts]
    log_dim, alpha, beta, l1, l2 = 10, 0.3, 1.0, 0.02, 0.02
    got, bias = quality_model._train(pd.DataFrame({"text": texts, "label": y}), log_dim, 3, alpha, beta, l1, l2)
    z, n = Counter(), Counter()

    def weight(i):
        if i == "bias":
            return -z[i] / ((beta + math.sqrt(n[i])) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for t, label in zip(texts, y, strict=True):
            f, _own = quality_model.features(quality_model.Tokens([t.encode()]), log_dim)
            c = Counter(f.tolist())
            x = {i: k / math.sqrt(len(f)) for i, k in c.items()} | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    assert bias == pytest.approx(weight("bias"), abs=1e-9) and np.allclose(got, [weight(i) for i in range(1 << log_dim)], atol=1e-9)


def test_quality_model(spark):
    rows = [(i, text(30)) for i in range(60)] + [(100 + i, "!! ".join(text(30).upper().split())) for i in range(60)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)] + [(7, None)], "doc_id long, label int")
    got = {r.doc_id: r for r in quality_model.classify(df, df, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == 1 for i in range(50, 60)) and all(got[100 + i].predicted == 0 for i in range(50, 60))
    assert {r.score for r in quality_model.classify(df, df, labels.limit(0)).collect()} == {0.5}


def test_toxicity_neighbours_are_exact(spark):
    bad = ["grub", "snot", "fool"]
    rows = [(i, text(30)) for i in range(150)] + [(1000 + i, text(15) + " " + " ".join(R.choice(bad) for _ in range(R.randint(1, 4))) + " " + text(9)) for i in range(150)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows if i < 5000 and i % 5], "doc_id long, label int")
    index = toxicity.fit(df, df, labels, k=5)
    got = {r.doc_id: r for r in toxicity.score(df, index).collect()}
    assert {b.encode() for b in bad} <= set(index.vocabulary.terms)
    # all 60 were right while a list of learned words had a vote; neighbours alone get most of these texts, whose words are all common
    assert sum(got[i].predicted == (i >= 1000) for i, _ in rows if i < 5000 and i % 5 == 0) >= 50
    q = index.weigh(index.vocabulary.matrix([(t or "").encode() for _, t in rows]))
    full = q.round(12) @ index.rows.T
    for n, (i, _) in enumerate(rows):
        want = sorted(((-round(c, 9), int(e)) for c, e in zip(full[n], index.ids, strict=True) if c > 1e-9))[:5]
        assert [-c for c, _ in want] == pytest.approx([e.cosine for e in got[i].evidence], abs=1e-8)
    none = {r.score for r in toxicity.score(df, toxicity.fit(df, df, labels.limit(0))).collect()}
    assert len(none) == 1 and max(none) < toxicity.THRESHOLD


def test_mined_url_rules_by_brute_force(spark):
    from fractions import Fraction
    from itertools import combinations

    r = random.Random(4)
    made = [(sorted(r.sample("abcdef", r.randint(1, 4))), r.choice(["allow", "block", "block"])) for _ in range(60)]
    made = [(x, "allow" if "a" in x and r.random() < 0.9 else v) for x, v in made] + [(["a", "z"], None)]
    df = spark.createDataFrame(made, "items array<string>, verdict string")
    support, confidence = 0.08, 0.7
    known = [(frozenset(x), v) for x, v in made if v]
    rules = {}
    for n in range(1, 5):
        for c in combinations("abcdef", n):
            c = frozenset(c)
            have = [v for x, v in known if c <= x]
            for v in ("allow", "block"):
                k = have.count(v)
                if k >= support * len(known) and k and Fraction(k, len(have)) >= Fraction(7, 10):
                    rules[c, v] = (k / len(have), k / len(known))
    got = url_rules.mine(df, support, confidence)
    assert {(frozenset(x.tokens), x.verdict): (round(x.confidence, 9), round(x.support, 9)) for x in got.collect()} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in rules.items()}
    lasting = {k: v for k, v in rules.items() if not any(s < k[0] and w == k[1] and x[0] >= v[0] for (s, w), x in rules.items())}
    kept = url_rules.pruned(got)
    assert {(frozenset(x.tokens), x.verdict) for x in kept.collect()} == set(lasting) and len(lasting) < len(rules)
    best = {tuple(x["items"]): (x.mined, tuple(x.mined_tokens)) for x in url_rules.match(df, kept).collect()}
    for x, _ in made:
        fits = sorted((-a, -b, -len(k), sorted(k), v) for (k, v), (a, b) in lasting.items() if k <= set(x))
        assert best.get(tuple(x)) == ((fits[0][4], tuple(fits[0][3])) if fits else None)


def test_url_rules(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block")]
    rows = [(1, "http://x.example.org/es/1"), (2, "https://EXAMPLE.org/fr?q"), (3, "http://a.com/de/5#t"), (4, None), (5, "no scheme"), (6, "http://example.org"), (7, "http://a.net/de/9"), (7, "http://a.net/de/9")]
    rows += [(100 + i, f"http://h{i}.com/de/{i}") for i in range(20)]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")), rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].host, got[2].path, got[2].rule) == ("example.org", "/fr", "org/") and got[3].verdict == "block"
    assert (got[4].host, got[5].path, got[4].verdict) == ("", "", "allow") and got[6].rule is None
    assert got[7].rule is None and got[7].verdict == "block" and set(got[7].mined_tokens) <= {"p:0:de", "p:1:9"}


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import tiktoken

    import corpus_pipeline as p

    base = [text(60) for _ in range(9)]
    rows = [(i, base[i % 9] if i < 9 else base[0] + " " + text(3), "en" if i % 2 else None, f"s{i % 8}") for i in range(12)]
    rows = [(i, f"menu of all\n{t}\n12 own {i}", lang, site) for i, t, lang, site in rows]
    rows += [(20, None, "en", "s1"), (21, "12 - 34", "en", "s2"), (22, "", "en", None), (None, base[3] + " " + text(2), "en", "s1"), (None, text(30), None, None), (4, rows[4][1], "en", "s4"), (5, "menu of all", "en", "s3"), (30, base[5] + "\n" + base[6][:40], "en", None)]
    rows += [(40 + i, "kunz brog " * 3 + text(3).upper(), "xx", "s0") for i in range(3)]
    bench = [(1, " ".join(base[3].split()[5:20])), (2, "own 7"), (3, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_x", F.lit("extra"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, frames = {}, docs
    for name, stage in p.STAGES:
        frames = stage(spark, frames, str(tmp_path))
        frames.write.parquet(f"{tmp_path}/{name}")
        frames = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in frames.collect()]
        if name != "tokens":
            assert frames.columns == p.COLUMNS
    C = Counter
    # language: whatever has a letter stays
    want = [(i, t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)]
    assert C((r[0], r[1], r[3]) for r in seen["language"]) == C(want) and {r[2] for r in seen["language"]} <= {"en", "xx"}
    # lines of six sites or more stay in their first place only
    sites, first = {}, {}
    for i, t, s in want:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                sites.setdefault(line.strip(), set()).add(s)
                first.setdefault(line.strip(), []).append((i is not None, i or 0, n))
    common = {k for k, v in sites.items() if len(v) >= 6}
    assert common == {"menu of all"}
    place = {k: min(x for x in first[k] if x[0]) for k in common}
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if x.strip() not in common or (i is not None, i or 0, n) == place[x.strip()])) for i, t, s in want]
    assert C((r[0], r[1]) for r in seen["lines"]) == C(cut) and all(r[4] == len(r[1]) for r in seen["lines"])
    # near duplicates, all pairs
    sets = {}
    for i, t in cut:
        w = _words(t)
        if i is not None:
            sets.setdefault(i, []).append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    least = {i: i for i in sets}
    for _ in range(6):
        for a, xs in sets.items():
            for b, ys in sets.items():
                if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in xs for y in ys):
                    least[a] = min(least[a], least[b])
    kept = [(i, t) for i, t in cut if i is None or least[i] == i]
    assert C((r[0], r[1]) for r in seen["near_duplicates"]) == C(kept) and len(kept) < len(cut)
    # contaminated texts
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [pat.findall(t.translate(LOW)) for _, t in bench if t]
    windows = [{tuple(x[j : j + min(10, len(x))]) for j in range(len(x) - min(10, len(x)) + 1)} for x in items]

    def clean(t):
        w = pat.findall(t.translate(LOW))
        return not any(tuple(w[j : j + n]) in win for x, win in zip(items, windows, strict=True) for n in (min(10, len(x)),) for j in range(len(w) - n + 1))

    left = [(i, t) for i, t in kept if clean(t)]
    assert C((r[0], r[1]) for r in seen["decontaminate"]) == C(left) and len(left) < len(kept) and any(i is None for i, _ in left) and sum(i is None for i, _ in kept) == 2
    # tokens
    P = queries.tokenizers()
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert C(seen["tokens"]) == C((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t in left for ids in (tok.encode_ordinary(t),))
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality_rules.judge(docs, labels.select("doc_id")).count() == 0
    assert quality_model.classify(docs, docs, labels).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, docs, labels)).count() == 0
    assert line_dedup.remove_boilerplate(docs).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    P = queries.tokenizers()
    assert bpe.encode(docs, bpe.load_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).count() == 0
    # repeated rows give a row each, extra columns do not clash, very long texts are read whole
    rows = [(i, text(30)) for i in range(40)] + [(100 + i, "!! ".join(text(30).upper().split())) for i in range(40)] + [(7, text(30)), (7, text(30)), (900, text(60_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(1)).withColumn("row", F.lit(2))
    known = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(40)], "doc_id long, label int")
    assert quality_model.classify(df, df, known).count() == len(rows)
    got = toxicity.score(df, toxicity.fit(df, df, known, k=3)).collect()
    assert len(got) == len(rows) and all(r.evidence for r in got)
    assert quality_rules.judge(df, known.where("label = 0").select("doc_id")).count() == len(rows)
    assert queries.op6_warc is not None and line_dedup.remove_boilerplate(df.withColumn("source", F.lit("s"))).count() == len(rows)


def test_toxicity_cosine_is_over_all_terms(spark):
    bad = ["grub", "snot", "fool"]
    rows = [(i, text(30)) for i in range(60)] + [(1000 + i, text(20) + " " + " ".join(bad[: 1 + i % 3])) for i in range(60)]
    # a near copy of a labelled clean text, rare words that no example holds, and a text of only such words
    rows += [(2000, rows[1][1] + " kwyjibo zzyzx zzyzx"), (2001, "kwyjibo qqq"), (2002, rows[1][1] + " kwyjibo zzyzx zzyzx"), (2003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = [(i, int(i >= 1000)) for i, _ in rows if i < 2000 and i % 4]
    for common in (toxicity.COMMON, 3):  # frequencies held by tasks, and by the join
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "COMMON", common)
            m.setattr(toxicity, "DENSE", 40)
            m.setattr(toxicity, "BLOCK", 8)
            got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, df, spark.createDataFrame(known, "doc_id long, label int"), k=5)).collect()}
        terms = {i: Counter(t.split()) for i, t in rows}
        n = Counter(w for c in terms.values() for w in c)
        vec = {i: {w: math.log1p(c) * (math.log((len(rows) + 1) / (n[w] + 1)) + 1e-9) for w, c in t.items()} for i, t in terms.items()}
        norm = {i: math.sqrt(sum(x * x for x in v.values())) or 1 for i, v in vec.items()}
        for i, _ in rows:
            all_cos = {e: sum(x * vec[e].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[e] for e, _ in known}
            want = sorted(((-round(c, 9), e) for e, c in all_cos.items() if c > 1e-9))[:5]
            assert [-c for c, _ in want] == pytest.approx([e.cosine for e in got[i].evidence], abs=1e-8), i
            assert len({c for c, _ in want}) < len(want) or [e for _, e in want] == [e.example for e in got[i].evidence]
        assert got[2000].evidence[0].example == 1 and got[2001].evidence == []
