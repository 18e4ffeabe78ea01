"""Chunking, views and checks of a corpus: sections, greedy packing, inherited columns, scopes, manifests, violations, leaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id, token_estimate

# --- chunks --------------------------------------------------------------------------------------------------------


def tidy_lines(c) -> Column:
    """Lines without outer white space and without blank ones."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"^[\s\x1c-\x1f\x85 　]+|[\s\x1c-\x1f\x85 　]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sections(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, place, title, body: a section a `## ` heading with its text; what stands before the first heading goes. Without a heading (or
    without any text under one) the whole text is the section Overview. Bodies are tidied (see tidy_lines), empty ones go."""
    parts = F.split(F.concat(F.lit("\n"), F.col(content)), r"\n##\s+(?=\S)")
    x = docs.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_c"), F.posexplode(parts).alias("place", "_p"))
    head = F.trim(F.regexp_extract("_p", r"^([^\n]*)", 1))
    named = x.where("place > 0").select(key, F.col("place").cast("long").alias("place"), F.regexp_replace(head, r"^\s+|\s+$", "").alias("title"), tidy_lines(F.regexp_replace("_p", r"^[^\n]*", "")).alias("body")).where("body <> ''")
    whole = docs.where(F.col(content).isNotNull()).join(named.select(key).distinct(), key, "left_anti").select(key, F.lit(1).cast("long").alias("place"), F.lit("Overview").alias("title"), tidy_lines(content).alias("body"))
    return named.unionByName(whole)


_SENTENCE_END = re.compile(r"(?<=[。！？!?;；.])")


def _packed(pieces: list[str], most: int) -> Iterator[str]:
    """Pieces joined by spaces for as long as they fit; one that is too long by itself is cut at its last space in the second half, or at the limit."""
    held = ""
    for piece in pieces:
        joined = f"{held} {piece}" if held else piece
        if len(joined) <= most:
            held = joined
            continue
        if held:
            yield held
        while len(piece) > most:
            cut = piece.rfind(" ", 0, most)
            cut = cut if cut >= most // 2 else most
            head, piece = piece[:cut].strip(), piece[cut:].strip()
            yield head
            if len(piece) <= most and piece:
                yield piece
                piece = ""
        held = piece
    if held:
        yield held


def _cut(title: list[str], body: list[str], most: int, least: int) -> list[tuple[str, str]]:
    """(title, chunk) of one document's sections in order."""
    out: list[tuple[str, str]] = []
    for t, b in zip(title, body, strict=True):
        parts = [b] if len(b) <= most else list(_packed([s.strip() for s in _SENTENCE_END.split(b) if s.strip()], most))
        for part in parts:
            if not part:
                continue
            if out and out[-1][0] == t and len(part) < least and len(out[-1][1]) + 2 + len(part) <= most:
                out[-1] = (t, out[-1][1] + "\n" + part)  # a short one joins the chunk before it in its section
            else:
                out.append((t, part))
    return out


def chunk_documents(docs: DataFrame, key: str, content: str, most: int = 900, least: int = 120) -> DataFrame:
    """key, chunk_index, chunk_id, section, content, token_estimate. Only packing, which goes by what was packed before, is done in Python."""
    if not 0 < least <= most:
        raise ValueError("chunk sizes must be positive, the least no larger than the most")
    kind = dict(docs.dtypes)[key]
    s = sections(docs, key, content).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "title", "body"))).alias("s"))
    lists = s.select(key, F.transform("s", lambda x: x["title"]).alias("titles"), F.transform("s", lambda x: x["body"]).alias("bodies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(k, i, t, c) for k, ts, bs in zip(df[key], df["titles"], df["bodies"], strict=True) for i, (t, c) in enumerate(_cut(list(ts), list(bs), most, least))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "section", "content"])

    got = lists.mapInPandas(run, f"{key} {kind}, chunk_index long, section string, content string")
    return got.select(key, "chunk_index", chunk_id(F.col(key), F.col("chunk_index"), F.col("content")).alias("chunk_id"), "section", "content", token_estimate(F.col("content")).cast("long").alias("token_estimate"))


def inherit(chunks: DataFrame, docs: DataFrame, key: str, columns: list[str], title: str) -> DataFrame:
    """chunks with columns of their document and the citation label `title - section`."""
    return chunks.join(docs.select(key, F.col(title).alias("_title"), *columns), key).withColumn("citation_label", F.concat_ws(" - ", "_title", "section")).drop("_title")


def derive_scope(docs: DataFrame, chunks: DataFrame, document_overrides: DataFrame, chunk_overrides: DataFrame, doc: str, chunk: str) -> DataFrame:
    """chunk, doc, scope_type, primary, applicable, inherited, widened: a document with one solution is solution_specific, others have an
    override; a chunk has its document's scope unless overridden. widened: its solutions go beyond its document's (an error).

    docs: doc, solutions; overrides: doc or chunk, scope_type, primary, applicable."""
    d = docs.join(document_overrides.select(doc, F.struct("scope_type", "primary", "applicable").alias("_o")), doc, "left")
    single = F.struct(F.lit("solution_specific").alias("scope_type"), F.get("solutions", F.lit(0)).alias("primary"), F.col("solutions").alias("applicable"))
    d = d.select(doc, F.when(F.size("solutions") == 1, single).otherwise(F.col("_o")).alias("_d"))
    c = chunks.select(doc, chunk).join(d, doc).join(chunk_overrides.select(chunk, F.struct("scope_type", "primary", "applicable").alias("_c")), chunk, "left")
    s = F.coalesce("_c", "_d")
    return c.select(chunk, doc, s["scope_type"].alias("scope_type"), s["primary"].alias("primary"), s["applicable"].alias("applicable"), F.col("_c").isNull().alias("inherited"), (F.size(F.array_except(s["applicable"], F.col("_d.applicable"))) > 0).alias("widened"))


# --- views ---------------------------------------------------------------------------------------------------------


def _line(label: str, c: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.nullif(c, F.lit("")))


def enriched_chunk_text() -> Column:
    """title, summary, section (left out if empty) and content of a chunk, a line each."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Summary: "), "summary"), _line("Section", F.col("section")), F.concat(F.lit("Content: "), "content"))


def document_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Summary: "), "summary"), F.concat(F.lit("Document Type: "), "document_type"), F.concat(F.lit("Content: "), "content"))


def context_view_text(names: dict[int, str]) -> Column:
    """A chunk's text with its document's scope, solutions by name, industries and tags; what is empty is left out."""
    called = F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    name = lambda s: F.coalesce(F.element_at(called, s), s.cast("string"))
    return F.concat_ws(
        "\n", F.concat(F.lit("Document Title: "), "title"), F.concat(F.lit("Document Summary: "), "summary"), F.concat(F.lit("Document Type: "), "document_type"), F.concat(F.lit("Scope Type: "), "scope_type"), F.concat(F.lit("Citation Label: "), "citation_label"), _line("Section Heading", F.col("section")),
        _line("Primary Solution Name", name(F.col("primary_solution"))), _line("Applicable Solution Names", F.array_join(F.transform("applicable", name), ", ")), _line("Industries", F.array_join("industries", ", ")), _line("Tags", F.array_join("tags", ", ")), F.concat(F.lit("Chunk Content: "), "content"),
    )


def document_level(docs: DataFrame, chunks: DataFrame, doc: str, chunk: str) -> DataFrame:
    """One pseudo-chunk a document, with its text view and its chunk ids in ascending order."""
    own = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(chunk)).alias("children"))
    return docs.join(own, doc, "left").select(doc, F.concat(F.col(doc).cast("string"), F.lit("#doc-000")).alias("chunk_id"), document_text().alias("text"), F.coalesce("children", F.array().cast(f"array<{dict(chunks.dtypes)[chunk]}>")).alias("children"))


def with_children_text(docs: DataFrame, chunks: DataFrame, doc: str, chunk: str) -> DataFrame:
    """doc and its title, summary and type with all children's sections and contents in the order of their ids."""
    own = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(chunk, F.col("section").alias("s"), F.col("content").alias("c")))).alias("k"))
    j = docs.join(own, doc, "left")
    listed = lambda f, sep: F.array_join(F.filter(F.transform("k", lambda x: F.trim(x[f])), lambda v: v != ""), sep)
    return j.select(doc, F.concat_ws("\n", F.concat(F.lit("Document Title: "), "title"), F.concat(F.lit("Document Summary: "), "summary"), F.concat(F.lit("Document Type: "), "document_type"), _line("Child Citation Labels", listed("s", " | ")), _line("Child Chunk Contents", listed("c", " || "))).alias("text"))


def authoring_packet(docs: DataFrame, chunks: DataFrame, doc: str, chunk: str, scope: list[str]) -> DataFrame:
    """doc, packet: its chunks in order, each with whether its scope columns differ from the document's."""
    differs = F.lit(False)
    for c in scope:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_of_document_{c}"))
    j = chunks.join(docs.select(doc, *[F.col(c).alias(f"_of_document_{c}") for c in scope]), doc)
    own = j.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("chunk"), differs.alias("differs")))).alias("chunks"))
    return own.select(doc, "chunks", F.size(F.filter("chunks", lambda x: x["differs"])).alias("n_differing"))


def payload_consistency(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, state of every row whose content projection is not the same in both versions: changed, removed or added."""
    sign = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    a, b = sign(old), sign(new).withColumnRenamed("h", "g")
    j = a.join(b, key, "full")
    return j.select(key, F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "removed").when(F.col("h") != F.col("g"), "changed").alias("state")).where("state is not null")


# --- checks --------------------------------------------------------------------------------------------------------


def build_manifest(docs: DataFrame, chunks: DataFrame, kind: str, solutions: str, order: str) -> DataFrame:
    """One row: documents, chunks, documents a type (sorted by type), and all solutions as first seen by `order` and place."""
    types = docs.groupBy(kind).agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))), lambda x: F.concat_ws(":", x[kind], x["n"].cast("string"))), ",").alias("types"))
    seen = docs.select(F.col(order).alias("_o"), F.posexplode(solutions).alias("_i", "_s")).groupBy("_s").agg(F.min(F.struct("_o", "_i")).alias("at"))
    first = seen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_s"))), lambda x: x["_s"].cast("string")), ",").alias("solutions"))  # a row a solution
    n = docs.agg(F.count("*").alias("n_documents")).join(chunks.agg(F.count("*").alias("n_chunks")))
    return n.join(types).join(first)  # one row each


def document_issues() -> Column:
    """Ordered issues of a document: title, summary, content, effective_from, effective_until, created_at, updated_at, source_uri."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    uri = F.col("source_uri")
    named = {
        "summary_too_short": F.length("summary") < 8, "http_uri": F.lower(uri).rlike("^https?://"), "foreign_uri": uri.contains("://") & ~F.lower(uri).rlike("^https?://") & ~F.lower(uri).startswith("synthetic://"), "absolute_uri": uri.startswith("/"),
        "escaping_uri": F.array_contains(F.split(uri, "/"), ".."), "dates_reversed": F.col("effective_until") < F.col("effective_from"), "content_is_title": fold("content") == fold("title"), "updated_before_created": F.col("updated_at") < F.col("created_at"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def corpus_checks(docs: DataFrame, chunks: DataFrame, known: DataFrame, types: list[str]) -> DataFrame:
    """check, id, n of every violation. docs: doc, document_type, solutions, tags, status; chunks: chunk, doc, document_type, solutions, tags, status,
    chunk_index; known: solution, selected."""
    rows = lambda df, name, i, n: df.select(F.lit(name).alias("check"), i.cast("string").alias("id"), n.cast("long").alias("n"))
    one = F.lit(1)
    out = [rows(df.groupBy(k).agg(F.count("*").alias("n")).where("n > 1"), f"repeated_{k}", F.col(k), F.col("n")) for df, k in ((docs, "doc"), (chunks, "chunk"))]
    spark = docs.sparkSession
    want = spark.createDataFrame([(t,) for t in types], "document_type string")
    out.append(rows(want.join(docs.select("document_type").distinct(), "document_type", "left_anti"), "missing_type", F.col("document_type"), one))
    used = docs.select("doc", "document_type", F.explode(F.array_distinct("solutions")).alias("solution")).join(known, "solution", "left")
    per = used.groupBy("doc").agg(F.count_if(F.col("selected").isNull()).alias("unknown"), F.count_if(~F.col("selected")).alias("beyond"))
    out += [rows(per.where("unknown > 0"), "unknown_solution", F.col("doc"), F.col("unknown")), rows(per.where("beyond > 0"), "solution_out_of_scope", F.col("doc"), F.col("beyond"))]
    rare = used.where("document_type <> 'solution'").groupBy("solution").agg(F.count_distinct("doc").alias("n"))
    out.append(rows(known.where("selected").join(rare, "solution", "left").where("coalesce(n, 0) < 2"), "solution_in_too_few_documents", F.col("solution"), F.coalesce("n", F.lit(0))))
    p = chunks.join(docs.select("doc", *[F.col(c).alias(f"_{c}") for c in ("document_type", "solutions", "tags", "status")], F.lit(True).alias("_d")).dropDuplicates(["doc"]), "doc", "left")
    out.append(rows(p.where("_d is null"), "orphan_chunk", F.col("chunk"), one))
    for c in ("document_type", "solutions", "tags", "status"):
        out.append(rows(p.where(F.col("_d") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))), f"{c}_mismatch", F.col("chunk"), one))
    at = chunks.groupBy("doc").agg(F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.count("*").alias("n"), F.count_distinct("chunk_index").alias("d"))
    out.append(rows(at.where("lo <> 0 or hi <> n - 1 or d <> n"), "chunk_index_gap", F.col("doc"), F.col("n")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def case_checks(cases: DataFrame, gold: DataFrame, forbidden: DataFrame, docs: DataFrame, chunks: DataFrame, case: str) -> DataFrame:
    """check, id, n: impossible minimum hits, unknown expected or forbidden documents, unknown chunks, chunks beyond the expected documents.

    cases: case, minimum_hits; gold: case, item, kind, doc, chunk; forbidden: case, doc."""
    rows = lambda df, name: df.groupBy(case).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.col(case).cast("string").alias("id"), "n")
    n = gold.groupBy(case).agg(F.count("*").alias("_n"))
    hard = cases.join(n, case, "left").where(F.col("minimum_hits") > F.coalesce("_n", F.lit(0)))
    named = gold.where("kind = 'document'").select(case, "doc")
    c = gold.where("kind = 'chunk'")
    beyond = c.join(named.select(case).distinct(), case, "left_semi").join(named, [case, "doc"], "left_anti")
    unknown = c.join(chunks.select("chunk").distinct(), "chunk", "left_anti")
    out = rows(hard, "impossible_minimum_hits").unionByName(rows(named.unionByName(forbidden.select(case, "doc")).join(docs.select("doc").distinct(), "doc", "left_anti"), "unknown_document")).unionByName(rows(unknown, "unknown_chunk")).unionByName(rows(beyond, "chunk_beyond_expected_documents"))
    return out


def case_identity_checks(cases: DataFrame, sources: DataFrame, known: DataFrame, case: str) -> DataFrame:
    """check, id, n: repeated case ids, source cases that are not known, solutions that are unknown or not among those selected.

    cases: case, source_case, solutions (all a case names); sources: source_case; known: solution, selected."""
    rows = lambda df, name, n: df.select(F.lit(name).alias("check"), F.col(case).cast("string").alias("id"), n.cast("long").alias("n"))
    again = cases.groupBy(case).agg(F.count("*").alias("n")).where("n > 1")
    stray = cases.join(sources.select("source_case").distinct(), "source_case", "left_anti").groupBy(case).agg(F.count("*").alias("n"))
    used = cases.select(case, F.explode(F.array_distinct("solutions")).alias("solution")).distinct().join(known, "solution", "left")
    per = used.groupBy(case).agg(F.count_if(F.col("selected").isNull()).alias("unknown"), F.count_if(~F.col("selected")).alias("beyond"))
    out = rows(again, "repeated_case", F.col("n")).unionByName(rows(stray, "unknown_source_case", F.col("n")))
    return out.unionByName(rows(per.where("unknown > 0"), "unknown_solution", F.col("unknown"))).unionByName(rows(per.where("beyond > 0"), "solution_out_of_scope", F.col("beyond")))


def inheritance_checks(docs: DataFrame, chunks: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """check, id, n: chunks whose column differs from their document's (lists as sets), and counts of the manifest that are wrong.

    docs: doc and columns; chunks: chunk, doc and columns; manifest: one row with n_documents and n_chunks. n of a count is the true one."""
    kinds, p = dict(docs.dtypes), chunks.join(docs.select("doc", *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates(["doc"]), "doc")
    own = lambda c: F.array_sort(F.array_distinct(c)) if kinds[c.lstrip("_")].startswith("array") else F.col(c)
    wrong = F.array_compact(F.array(*[F.when(~own(c).eqNullSafe(own(f"_{c}")), F.lit(f"{c}_mismatch")) for c in columns]))
    out = p.select(F.explode(wrong).alias("check"), F.col("chunk").cast("string").alias("id"), F.lit(1).cast("long").alias("n"))
    for name, df in (("n_documents", docs), ("n_chunks", chunks)):
        told = manifest.select(F.lit(1).alias("_k"), F.col(name).alias("told"))
        got = df.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1)).join(told, "_k").where("n <> told")
        out = out.unionByName(got.select(F.lit(f"{name}_mismatch").alias("check"), F.lit("manifest").alias("id"), "n"))
    return out


def case_coverage(cases: DataFrame, by: list[str]) -> DataFrame:
    """dimension, value, n: cases of every value of every column in `by`, in one pass."""
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]))
    return cases.select(x.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def label_checks(labels: DataFrame, template: DataFrame, modes: list[str], doc: str) -> DataFrame:
    """doc, issues of every document whose label record does not fit the template: place, chunks in order, allowed modes.

    labels and template: doc, place, chunks (array of ids in order); labels also default_mode and modes (array, null: none)."""
    t = template.select(doc, F.col("place").alias("_place"), F.col("chunks").alias("_chunks"))
    j = labels.join(t, doc, "full")
    allowed = F.array(*map(F.lit, modes))
    named = {
        "not_in_template": F.col("_place").isNull(), "not_labelled": F.col("place").isNull(), "place_moved": F.col("place") != F.col("_place"), "chunks_differ": ~F.col("chunks").eqNullSafe(F.col("_chunks")) & F.col("place").isNotNull() & F.col("_place").isNotNull(),
        "default_mode_not_allowed": F.col("place").isNotNull() & ~F.coalesce(F.array_contains(allowed, F.col("default_mode")), F.lit(False)), "override_not_allowed": F.exists("modes", lambda m: m.isNotNull() & ~F.array_contains(allowed, m)),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return j.select(doc, issues.alias("issues")).where(F.size("issues") > 0)


def label_counts(labels: DataFrame) -> DataFrame:
    """level, mode, n: documents by default mode, chunks by override."""
    d = labels.groupBy(F.col("default_mode").alias("mode")).agg(F.count("*").alias("n")).select(F.lit("document").alias("level"), "mode", "n")
    c = labels.select(F.explode("modes").alias("mode")).where("mode is not null").groupBy("mode").agg(F.count("*").alias("n")).select(F.lit("chunk").alias("level"), "mode", "n")
    return d.unionByName(c)


def seed_checks(cases: DataFrame, references: DataFrame, case: str, least: dict[str, int], reference_least: dict[str, int]) -> DataFrame:
    """case, issues of every case or reference that lacks its other half or has fewer entries in a list than asked; least: array column -> count.

    cases also has unverified_note (boolean)."""
    j = cases.withColumn("_c", F.lit(True)).join(references.withColumn("_r", F.lit(True)), case, "full")
    marks = [F.when(F.col("_c").isNull(), F.lit("reference_without_case")), F.when(F.col("_r").isNull(), F.lit("case_without_reference")), F.when(F.col("_c") & ~F.coalesce("unverified_note", F.lit(False)), F.lit("no_unverified_note"))]
    few = lambda flag, c, n: F.when(F.col(flag) & (F.coalesce(F.size(c), F.lit(0)) < n), F.lit(f"too_few:{c}"))
    marks += [few("_c", c, n) for c, n in least.items()] + [few("_r", c, n) for c, n in reference_least.items()]
    return j.select(case, F.array_compact(F.array(*marks)).alias("issues")).where(F.size("issues") > 0)


def scan_leaks(texts: DataFrame, key: str, text: str, markers: list[str], ids: DataFrame, id: str, pattern: str) -> DataFrame:
    """key, kind, found: markers (few, as substrings) and ids (any number) that occur in a text. Ids are looked up among the parts of the
    text that have an id's shape (pattern), so nothing is compared with everything."""
    has = texts.select(key, F.explode(F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(m)), F.lit(m)) for m in markers]))).alias("found")).select(key, F.lit("marker").alias("kind"), "found")
    shaped = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("found"))
    leaked = shaped.join(ids.select(F.col(id).cast("string").alias("found")).distinct(), "found", "left_semi").select(key, F.lit("id").alias("kind"), "found")
    return has.unionByName(leaked)


def find_ids(texts: DataFrame, key: str, text: str, ids: DataFrame, id: str, most_bytes: int = 32 << 20) -> DataFrame:
    """key, found: every id that occurs in a text as a substring, inside longer runs of letters or digits too, once a row.

    One automaton over all ids reads each text once, whatever their number (Aho-Corasick). Ids of more than most_bytes are dealt by hash
    into parts of about that size, and the texts are read once for each part; no task holds more than one part's automaton. Null and
    empty ids and texts give nothing."""
    spark = texts.sparkSession
    known = ids.select(F.col(id).cast("string").alias("found")).where("found <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("found") + 8)).first()[0] or 0
    parts, kind, out = max(1, -(-size // most_bytes)), dict(texts.dtypes)[key], None
    for part in range(parts):
        mine = [r.found for r in (known if parts == 1 else known.where(F.pmod(F.xxhash64("found"), F.lit(parts)) == part)).collect()]  # about most_bytes
        got = texts.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(_searching(spark.sparkContext.broadcast(mine), key), f"{key} {kind}, found string")
        out = got if out is None else out.unionByName(got)
    return out


def _searching(ids, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        search = ahocorasick.Automaton()
        for x in ids.value:
            search.add_word(x, x)
        search.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if ids.value else []):
                hit = sorted({x for _, x in search.iter(text or "")})
                at += [i] * len(hit)
                found += hit
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "found"])

    return run


def gold_isolation(payloads: DataFrame, key: str, json: str, gold: list[str]) -> DataFrame:
    """key, leaked: gold fields among the keys of each payload (a JSON object)."""
    return payloads.select(key, F.array_join(F.array_sort(F.array_intersect(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, gold)))), ",").alias("leaked")).where("leaked <> ''")


def unsafe_reasons(c: str, secrets: list[str], prefixes: list[str], runtime: list[str]) -> Column:
    """Kinds of unsafe content in a value: secret (case-folded), absolute_path (as it begins), runtime_marker (case-folded)."""
    low = F.lower(F.coalesce(F.col(c), F.lit("")))
    any_ = lambda marks, col: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(col, F.lower(m)))
    path = F.lit(False)
    for p in prefixes:
        path |= F.startswith(F.coalesce(F.col(c), F.lit("")), F.lit(p))
    return F.array_compact(F.array(F.when(any_(secrets, low), F.lit("secret")), F.when(path, F.lit("absolute_path")), F.when(any_(runtime, low), F.lit("runtime_marker"))))
