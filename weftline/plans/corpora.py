"""Queries of reading, chunking, corpus views and corpus checks, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_tokens, normalize
from ..operators import checks, context, corpus, matching, vectors
from ..shared import fresh_path
from ..sources import read_jsonl as read_lines
from ..sources import write_jsonl as write_lines
from . import roles
from .roles import SQL
from .roles import table as _t

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("lang", T.StringType(), True), T.StructField("n_chars", T.LongType(), False)])


def read_jsonl(spark, d):
    """Lines of all documents, some of them spoiled by their id: how many are read, and how many rejected for which reason."""
    path = fresh_path(spark, "lines")
    i = F.col("doc_id") % 9
    fine = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    line = F.when(i == 0, F.concat(F.lit("{\"doc_id\": "), F.col("doc_id").cast("string"))).when(i == 1, F.lit("[1, 2]")).when(i == 2, F.to_json(F.struct("doc_id", "lang"))).when(i == 3, F.to_json(F.struct("doc_id", "lang", "n_chars", F.lit(1).alias("extra")))).when(i == 4, F.lit("  ")).when(i == 5, F.to_json(F.struct(F.lit("x").alias("doc_id"), "lang", "n_chars"))).otherwise(fine)
    _t(spark, d, "documents").select(line.alias("value")).write.text(path)
    good, bad = read_lines(spark, path, SCHEMA)
    return good.select(F.lit("read").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n_lines"))


NESTED = T.StructType([
    T.StructField("doc_id", T.LongType(), False), T.StructField("kind", T.StringType(), True, {"enum": ["note", "case"]}),
    T.StructField("scope", T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("sizes", T.ArrayType(T.IntegerType(), False))]), False),
])


def rejected_lines(spark, d):
    """Lines of nested records in files of their own, spoiled by their id: file, number and reason of each that is rejected."""
    path, i = fresh_path(spark, "nested"), F.col("doc_id") % 11
    scope = F.concat(F.lit('{"lang":"en","sizes":['), F.when(i == 2, '1,"x",3').when(i == 3, "1,null").otherwise("1,2"), F.lit("]"), F.when(i == 4, ',"more":{"a":1}').otherwise(""), F.lit("}"))
    line = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"kind":"'), F.when(i == 5, "memo").otherwise("note"), F.lit('","scope":'), F.when(i == 6, "[1]").when(i == 7, '{"sizes":[]}').otherwise(scope), F.lit("}"))
    rows = _t(spark, d, "documents").select((F.col("doc_id") % 16).alias("k"), "doc_id", F.when(i == 8, "").when(i == 9, "{oops").otherwise(line).alias("value"))
    rows.repartition("k").sortWithinPartitions("k", "doc_id").select("k", "value").write.partitionBy("k").text(path)
    _, bad = read_lines(spark, path, NESTED)
    return bad.select(F.regexp_extract("file", "k=([0-9]+)", 1).cast("long").alias("k"), "line", "reason")


def find_ids(spark, d):
    """Part numbers of three digits and more that occur anywhere in page sources, inside longer numbers too."""
    ids = _t(spark, d, "part").where("p_partkey >= 100").select(F.col("p_partkey").cast("string").alias("id"))
    return corpus.find_ids(_t(spark, d, "pages"), "page_id", "html", ids, "id")


def write_jsonl(spark, d):
    path = fresh_path(spark, "written")
    for _ in range(2):  # the second write replaces the first
        write_lines(_t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    good, bad = read_lines(spark, path, T.StructType([T.StructField("s_suppkey", T.LongType(), False), T.StructField("s_name", T.StringType(), False), T.StructField("s_nationkey", T.IntegerType(), False)]))
    return good.unionByName(bad.select(F.lit(None).cast("long").alias("s_suppkey"), F.col("text").alias("s_name"), F.lit(None).cast("int").alias("s_nationkey")))


def _docs(spark, d):
    """A row a document of the scope role, with dates and addresses."""
    first = roles.chunks(spark, d).where("chunk % 3 = 0")
    return first.select("doc", "title", "summary", "document_type", "scope_type", "primary_solution", "applicable", "excluded", "industries", "tags", "status", "content", "effective_from", "effective_until", F.expr("CASE doc % 8 WHEN 0 THEN 'http://x/y' WHEN 1 THEN 'ftp://x' WHEN 2 THEN '/abs' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'synthetic://v2/x' ELSE 'notes/x.md' END").alias("source_uri"))


_DOCS = f"""{SQL}, docs AS (SELECT doc, title, summary, document_type, scope_type, primary_solution, applicable, excluded, industries, tags, status, content, effective_from, effective_until, CASE doc % 8 WHEN 0 THEN 'http://x/y' WHEN 1 THEN 'ftp://x' WHEN 2 THEN '/abs' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'synthetic://v2/x' ELSE 'notes/x.md' END AS source_uri FROM chunks WHERE chunk % 3 = 0)"""


def build_manifest(spark, d):
    docs = _docs(spark, d).withColumn("applicable", F.transform("applicable", lambda x: x + F.col("doc") % 3))
    return corpus.build_manifest(docs, roles.chunks(spark, d), "document_type", "applicable", "doc")


def document_checks(spark, d):
    """Documents with their issues; some dates, titles and summaries are spoiled by the id."""
    x = _docs(spark, d).withColumn("summary", F.when(F.col("doc") % 5 == 0, "short").otherwise(F.col("summary"))).withColumn("content", F.when(F.col("doc") % 7 == 0, F.concat(F.lit(" "), F.upper("title"), F.lit("  "))).otherwise(F.col("content")))
    x = x.withColumn("effective_until", F.when(F.col("doc") % 11 == 0, F.date_sub("effective_from", 1)).otherwise(F.col("effective_until"))).withColumn("created_at", F.lit(10)).withColumn("updated_at", F.when(F.col("doc") % 13 == 0, 9).otherwise(10))
    return x.select("doc", F.array_join(corpus.document_issues(), ",").alias("issues")).where("issues <> ''")


def _spoiled(spark, d):
    """Chunks as a check would meet them: some without their document, some that differ from it, some repeated or out of line."""
    c = roles.chunks(spark, d).select("chunk", F.when(F.col("chunk") % 41 == 0, -F.col("doc")).otherwise(F.col("doc")).alias("doc"), F.when(F.col("chunk") % 43 == 0, "other").otherwise(F.col("document_type")).alias("document_type"), F.col("document_applicable").alias("solutions"), F.when(F.col("chunk") % 47 == 0, F.array(F.lit("x"))).otherwise(F.col("tags")).alias("tags"), F.when(F.col("chunk") % 53 == 0, "x").otherwise(F.col("status")).alias("status"), F.when(F.col("chunk") % 59 == 0, 7).otherwise(F.col("chunk") % 3).alias("chunk_index"))
    return c.unionByName(c.where("chunk % 61 = 0"))


def corpus_checks(spark, d):
    docs = roles.chunks(spark, d).where("chunk % 3 = 0").select("doc", "document_type", F.col("document_applicable").alias("solutions"), "tags", "status")
    docs = docs.where("document_type <> 'case_study' or doc % 2 = 0").unionByName(docs.where("doc % 67 = 0"))
    known = spark.createDataFrame([(0, True), (1, True), (2, False), (4, True), (9, True)], "solution long, selected boolean")
    return corpus.corpus_checks(docs, _spoiled(spark, d), known, ["solution", "capability", "case_study", "commercial_rule", "readiness"])


def case_checks(spark, d):
    want, bad = roles.gold(spark, d)
    docs, chunks = roles.chunks(spark, d).where("chunk % 3 = 0 and doc % 10 <> 3").select("doc"), roles.chunks(spark, d).where("chunk % 10 <> 4")
    return corpus.case_checks(roles.cases(spark, d).withColumn("minimum_hits", F.col("minimum_hits") + 1), want, bad, docs, chunks, "q")


def case_identity_checks(spark, d):
    """Cases with a source by their number, some of them twice; solutions 0 to 4 are known, without 3 selected."""
    c = roles.cases(spark, d).select("q", (F.col("q") % 13).alias("source_case"), F.array_union("scope", F.array_union("forbidden", F.array(F.col("q") % 7))).alias("solutions"))
    known = spark.createDataFrame([(i, i != 3) for i in roles.SOLUTIONS], "solution long, selected boolean")
    sources = spark.createDataFrame([(i,) for i in range(13) if i != 5], "source_case long")
    return corpus.case_identity_checks(c.unionByName(c.where("q % 20 = 0")), sources, known, "q")


def inheritance_checks(spark, d):
    """Chunks some of whose lists are spoiled by their key, and a manifest with a wrong number of chunks."""
    c = roles.chunks(spark, d).select("chunk", "doc", "document_type", "industries", "status")
    docs = c.where("chunk % 3 = 0").select("doc", "document_type", "industries", "status")
    bad = c.withColumn("industries", F.when(F.col("chunk") % 10 == 4, F.array_append("industries", "i9")).when(F.col("chunk") % 10 == 5, F.concat("industries", "industries")).otherwise(F.col("industries"))).withColumn("status", F.when(F.col("chunk") % 17 == 1, "draft").otherwise(F.col("status")))
    manifest = docs.agg(F.count("*").alias("n_documents"), (F.count("*") + 1).alias("n_chunks"))
    return corpus.inheritance_checks(docs, bad, manifest, ["document_type", "industries", "status"])


def case_coverage(spark, d):
    c = roles.cases(spark, d).select((F.col("q") % 8).alias("query_type"), (F.size("forbidden") > 0).alias("forbids"), F.size("scope").alias("scope"))
    return corpus.case_coverage(c, ["query_type", "forbids", "scope"])


def _label_rows(spark, d):
    c = roles.chunks(spark, d).groupBy("doc").agg(F.first("default_mode").alias("default_mode"), F.array_sort(F.collect_list(F.struct("chunk", "override_mode"))).alias("x"))
    return c.select("doc", F.col("doc").alias("place"), F.transform("x", lambda r: r["chunk"]).alias("chunks"), "default_mode", F.transform("x", lambda r: r["override_mode"]).alias("modes"))


def label_checks(spark, d):
    t = _label_rows(spark, d)
    labels = t.where("doc % 17 <> 0").withColumn("place", F.when(F.col("doc") % 19 == 0, F.col("place") + 1).otherwise(F.col("place"))).withColumn("chunks", F.when(F.col("doc") % 23 == 0, F.reverse("chunks")).otherwise(F.col("chunks")))
    labels = labels.withColumn("default_mode", F.when(F.col("doc") % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("default_mode"))).withColumn("modes", F.when(F.col("doc") % 31 == 0, F.array(F.lit("odd"))).otherwise(F.col("modes")))
    return corpus.label_checks(labels, t.where("doc % 37 <> 0"), ["primary_in_scope", "full_applicable_scope", "global_reusable"], "doc").withColumn("issues", F.array_join("issues", ","))


def label_counts(spark, d):
    return corpus.label_counts(_label_rows(spark, d))


def seed_checks(spark, d):
    """Conversations as cases (turns by role as lists), documents' labels as reference packs by the same number."""
    role = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("turn")))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(role("user").alias("notes"), role("assistant").alias("solutions"), F.bool_or((F.col("role") == "user") & (F.col("turn") % 4 == 2)).alias("unverified_note"))
    r = _t(spark, d, "labels").select((F.col("doc_id") % 1000).alias("conv_id"), F.array_repeat(F.lit(1), (F.col("quality") + F.col("toxic")).cast("int")).alias("traps")).groupBy("conv_id").agg(F.max("traps").alias("traps"))
    return corpus.seed_checks(c, r, "conv_id", {"notes": 2, "solutions": 2}, {"traps": 1}).withColumn("issues", F.array_join("issues", ","))


MARKERS = ["copyright", "evaluation_gold", "@"]


def scan_leaks(spark, d):
    """Markers and supplier numbers (as #nnn) inside page sources."""
    ids = _t(spark, d, "supplier").select(F.concat(F.lit("-"), F.col("s_suppkey").cast("string")).alias("id"))
    return corpus.scan_leaks(_t(spark, d, "pages"), "page_id", "html", MARKERS, ids, "id", "-[0-9]+")


def gold_isolation(spark, d):
    """Run inputs as JSON, into some of which gold has slipped."""
    c = roles.cases(spark, d).withColumn("j", F.when(F.col("q") % 3 == 0, F.to_json(F.struct("query", "minimum_hits"))).when(F.col("q") % 3 == 1, F.to_json(F.struct("query", F.col("forbidden").alias("forbidden_solution_ids"), "minimum_hits"))).otherwise(F.to_json(F.struct("query"))))
    return corpus.gold_isolation(c, "q", "j", ["minimum_hits", "forbidden_solution_ids", "expected_relevant_document_ids"])


SECRETS, PREFIXES, RUNTIME = ["api_key", "authorization", "bearer", "secret", "sk-"], ["/Users/", "/home/", "C:\\", "D:\\"], ["data/runtime/", ".env", "Hidden Reference Pack", "reference pack"]


def unsafe_reasons(spark, d):
    """Documents and urls, some with a path put before them."""
    x = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("/home/"), F.coalesce("text", F.lit("")))).when(F.col("doc_id") % 70 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" REFERENCE PACK"))).otherwise(F.col("text")).alias("v"))
    return x.select("doc_id", F.array_join(corpus.unsafe_reasons("v", SECRETS, PREFIXES, RUNTIME), ",").alias("reasons")).where("reasons <> ''")


def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(normalize("text")).alias("text_md5"))


def tokenize_for_match(spark, d):
    t = _t(spark, d, "documents").select("doc_id", match_tokens("text", ["the", "and", "for"]).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _headed(spark, d):
    """Documents with a heading before every fourth line, but for those of an id divisible by five."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return _t(spark, d, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.array_join(lines, "\n")).alias("content"))


_HEADED = "hd AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 1 THEN '## Part ' || (i - 1) || chr(10) || x ELSE x END), chr(10)) END AS content FROM documents)"


def split_sections(spark, d):
    return corpus.sections(_headed(spark, d), "doc_id", "content").select("doc_id", "place", "title", F.md5("body").alias("body_md5"))


def chunk_documents(spark, d):
    return corpus.chunk_documents(_headed(spark, d), "doc_id", "content").drop("content")


def inherit_metadata(spark, d):
    """Chunks of all documents with their document's language and a label."""
    docs = _headed(spark, d)
    c = corpus.sections(docs, "doc_id", "content").select("doc_id", F.col("place").alias("chunk_index"), F.col("title").alias("section"))
    return corpus.inherit(c, docs.withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))), "doc_id", ["lang", "source"], "title").select("doc_id", "chunk_index", "lang", "source", "citation_label")


def derive_scope(spark, d):
    c = roles.chunks(spark, d)
    docs = c.where("chunk % 3 = 0").select("doc", F.col("document_applicable").alias("solutions"))
    over = c.where("chunk % 3 = 0 and doc % 4 <> 0").select("doc", "scope_type", F.col("primary_solution").alias("primary"), F.col("document_applicable").alias("applicable"))
    own = c.where("chunk % 4 = 1").select("chunk", F.lit("solution_specific").alias("scope_type"), (F.col("doc") % 4).alias("primary"), F.array(F.col("doc") % 4).alias("applicable"))
    got = corpus.derive_scope(docs, c, over, own, "doc", "chunk")
    return got.groupBy("scope_type", "inherited", "widened").agg(F.count("*").alias("n_chunks"), F.sum(F.size("applicable")).alias("n_solutions"))


def enriched_chunk_text(spark, d):
    return roles.chunks(spark, d).withColumn("section", F.when(F.col("chunk") % 6 == 0, "").otherwise(F.col("section"))).select("chunk", corpus.enriched_chunk_text().alias("text"))


NAMES = {0: "Assist", 1: "Forecast", 3: "Search"}


def context_view_text(spark, d):
    return roles.chunks(spark, d).withColumn("citation_label", F.concat_ws(" - ", "title", "section")).select("chunk", corpus.context_view_text(NAMES).alias("text"))


def document_level_corpus(spark, d):
    x = corpus.document_level(_docs(spark, d), roles.chunks(spark, d), "doc", "chunk")
    return x.select("doc", "chunk_id", "text", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


def with_children_text(spark, d):
    return corpus.with_children_text(_docs(spark, d), roles.chunks(spark, d), "doc", "chunk")


def authoring_packet(spark, d):
    x = corpus.authoring_packet(_docs(spark, d), roles.chunks(spark, d), "doc", "chunk", ["scope_type", "primary_solution", "applicable"])
    return x.select("doc", F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk"].cast("string"), c["differs"].cast("string"))), ",").alias("chunks"), F.col("n_differing").cast("long").alias("n_differing"))


def payload_consistency(spark, d):
    a = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    b = a.where("doc_id % 10 <> 1").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("lang"))).unionByName(a.where("doc_id % 10 = 2").withColumn("doc_id", -F.col("doc_id") - 1))
    return corpus.payload_consistency(a, b, "doc_id", ["lang", "n_chars"])


def opaque_ids_both_ways(spark, d):
    """Opaque ids of all suppliers, and how many ids each of them stands for."""
    x = checks.opaque_ids(_t(spark, d, "supplier"), "s_suppkey", "s", "salt", "2.2")
    return x.groupBy("opaque_id").agg(F.min("s_suppkey").alias("s_suppkey"), F.count("*").alias("n_ids"), F.bool_or("clashes").alias("clashes"))


def hash_embedding(spark, d):
    v = _t(spark, d, "benchmark").select("item_id", vectors.hash_embedding(F.col("text"), "document", 40).alias("v"))
    return v.select("item_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(33)), 6).alias("later"), F.size("v").cast("long").alias("dim"))


def embedding_delta(spark, d):
    """Vectors of even chunks are known, for every tenth with another text."""
    c = roles.chunks(spark, d)
    old = c.where("chunk % 2 = 0").withColumn("content", F.when(F.col("chunk") % 10 == 0, "old").otherwise(F.col("content")))
    none = spark.createDataFrame([], "cache_key string, embedding double")
    _, encoded = vectors.embedding_delta(old, none, "v1", "hash", "chunk", "content")
    have, miss = vectors.embedding_delta(c, encoded.select("cache_key", F.lit(1.0).alias("embedding")), "v1", "hash", "chunk", "content")
    return have.select("chunk", F.lit(True).alias("hit")).unionByName(miss.select("chunk", F.lit(False).alias("hit")))


STOP = ["the", "and", "la", "le"]


def decompose_query(spark, d):
    x = _t(spark, d, "benchmark").select("item_id", context.decompose(F.col("text"), STOP).alias("c"))
    return x.select("item_id", F.size("c").cast("long").alias("n_clauses"), F.md5(F.array_join("c", "|")).alias("clauses_md5"))


def augment_query(spark, d):
    c = roles.cases(spark, d)
    every = {"solution_scope": "scope", "document_types": "ask_types", "industries": "ask_industries", "tags": "ask_tags"}
    variants = {"Q0": {}, "Q2_scope": dict(list(every.items())[:1]), "Q2_document_types": dict(list(every.items())[1:2]), "Q2_all": every}
    x = F.array(*[F.struct(F.lit(n).alias("variant"), context.augment(F.col("query"), p).alias("text")) for n, p in variants.items()])
    return c.select("q", F.explode(x).alias("x")).select("q", "x.*")


def request_query(spark, d):
    """Customers as requests: name, segment and a goal where there is one."""
    x = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.lit("grow")).alias("goal"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise("CRM").alias("systems"))
    return x.select("c_custkey", context.request_query("c_name", {"行业：": "c_mktsegment", "目标：": "goal", "现有系统：": "systems"}).alias("text"))


def match_solutions(spark, d):
    """Suppliers ask with the name of a part, brands and names of every fiftieth part are the catalogue."""
    q = _t(spark, d, "supplier").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    c = _t(spark, d, "part").where("p_partkey % 50 = 7").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("content"), F.col("p_partkey").alias("place"))
    got = matching.match_solutions(q, c, "s_suppkey", "text", "p_partkey", "content")
    return got.select("s_suppkey", "p_partkey", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched"), F.col("rank").cast("long").alias("rank"))


def solution_query_text(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(F.max("l_returnflag").alias("f"), F.max("l_partkey").alias("p"))
    word = F.concat(F.col("f"), F.lit("-"), F.col("p").cast("string"))
    opps = li.select("l_orderkey", F.col("n").alias("position"), word.alias("text"), (F.col("f") != "R").alias("suitable"), F.array(F.col("n") + 1, F.col("n") - 1).alias("pain_ids"))
    pains = li.where("f = 'R'").select("l_orderkey", F.col("n").alias("pain"), F.concat(F.lit("pain "), F.col("p").cast("string")).alias("text"))
    impacts = li.where("p % 10 = 0").select("l_orderkey", F.col("n").alias("position"), F.concat(F.lit("impact "), F.col("n").cast("string")).alias("text"))
    return matching.solution_query_text(opps, pains, impacts, "l_orderkey")


_NAMES = "case_identity_checks inheritance_checks rejected_lines find_ids read_jsonl write_jsonl build_manifest document_checks corpus_checks case_checks case_coverage label_checks label_counts seed_checks scan_leaks gold_isolation unsafe_reasons normalize_text tokenize_for_match split_sections chunk_documents inherit_metadata derive_scope enriched_chunk_text context_view_text document_level_corpus with_children_text authoring_packet payload_consistency opaque_ids_both_ways hash_embedding embedding_delta decompose_query augment_query request_query match_solutions solution_query_text"
QUERIES = {n: globals()[n] for n in _NAMES.split()}


def _once(items: str) -> str:
    """A list's entries, each at its first place only."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


_MATCH = "list_filter(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'for'))"
_TIDY = "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10))"
_SECTIONS = f"""{_HEADED}, pt AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS place FROM (SELECT doc_id, string_split_regex(chr(10) || content, '\\n##\\s+') AS ps FROM hd WHERE content IS NOT NULL)),
    nm AS (SELECT doc_id, place, trim(regexp_extract(p, '^([^\\n]*)', 1)) AS title, {_TIDY.format("regexp_replace(p, '^[^\\n]*', '')")} AS body FROM pt WHERE place > 0), se AS (SELECT * FROM nm WHERE body <> '' UNION ALL SELECT doc_id, 1, 'Overview', {_TIDY.format("content")} FROM hd WHERE content IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM nm WHERE body <> ''))"""
_CLAUSES = """list_filter(list_transform(list_filter(list_transform(string_split_regex(text, '[，,；;。.!?]|以及|并且|同时|但是|需要|希望'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) >= 3), lambda p: array_to_string(list_filter(regexp_extract_all(replace(lower(p), 'ß', 'ss'), '[a-z0-9]+(?:[-_][a-z0-9]+)*'), lambda t: t NOT IN ('the', 'and', 'la', 'le')), ' ')), lambda c: length(c) >= 3)"""


def _names_sql(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + f" ELSE CAST({x} AS VARCHAR) END"


_UNIT = """WITH h AS (SELECT item_id, sha256('document' || chr(31) || text) AS a FROM benchmark), g AS (SELECT item_id, a || sha256(unhex(a)) AS x FROM h), v AS (SELECT item_id, list_transform(range(40), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS INT) / CAST(255 AS DOUBLE) * 2 - 1) AS v FROM g)"""
ORACLE = {
    "read_jsonl": "SELECT CASE doc_id % 9 WHEN 0 THEN 'bad JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'invalid field: n_chars' WHEN 3 THEN 'unknown field: extra' WHEN 5 THEN 'invalid field: doc_id' ELSE 'read' END AS reason, count(*) AS n_lines FROM documents WHERE doc_id % 9 <> 4 GROUP BY 1",
    "rejected_lines": """WITH n AS (SELECT doc_id % 16 AS k, doc_id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS line, doc_id % 11 AS i FROM documents)
        SELECT k, line, CASE i WHEN 2 THEN 'invalid field: scope.sizes[1]' WHEN 3 THEN 'invalid field: scope.sizes[1]' WHEN 4 THEN 'unknown field: scope.more' WHEN 5 THEN 'invalid field: kind' WHEN 6 THEN 'invalid field: scope' WHEN 7 THEN 'invalid field: scope.lang' ELSE 'bad JSON' END AS reason FROM n WHERE i BETWEEN 2 AND 9 AND i <> 8""",
    "find_ids": "SELECT page_id, CAST(p_partkey AS VARCHAR) AS found FROM pages JOIN part ON p_partkey >= 100 AND contains(html, CAST(p_partkey AS VARCHAR))",
    "write_jsonl": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "build_manifest": f"WITH {_DOCS}, s AS (SELECT doc, list_transform(applicable, lambda x: x + doc % 3) AS a FROM docs), f AS (SELECT x, min(row(doc, i)) AS at_ FROM (SELECT doc, unnest(a) AS x, unnest(range(len(a))) AS i FROM s) GROUP BY x), t AS (SELECT document_type, count(*) AS n FROM docs GROUP BY 1) SELECT (SELECT count(*) FROM docs) AS n_documents, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT string_agg(document_type || ':' || n, ',' ORDER BY document_type) FROM t) AS types, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY at_) FROM f) AS solutions",
    "document_checks": f"""WITH {_DOCS}, x AS (SELECT doc, title, CASE WHEN doc % 5 = 0 THEN 'short' ELSE summary END AS summary, CASE WHEN doc % 7 = 0 THEN ' ' || upper(title) || '  ' ELSE content END AS content, effective_from, CASE WHEN doc % 11 = 0 THEN effective_from - 1 ELSE effective_until END AS effective_until, source_uri AS u FROM docs),
        y AS (SELECT doc, concat_ws(',', CASE WHEN length(summary) < 8 THEN 'summary_too_short' END, CASE WHEN u LIKE 'http%' THEN 'http_uri' END, CASE WHEN u LIKE 'ftp%' THEN 'foreign_uri' END, CASE WHEN u LIKE '/%' THEN 'absolute_uri' END, CASE WHEN u LIKE '%/../%' THEN 'escaping_uri' END, CASE WHEN effective_until < effective_from THEN 'dates_reversed' END, CASE WHEN lower(trim(content)) = lower(title) THEN 'content_is_title' END, CASE WHEN doc % 13 = 0 THEN 'updated_before_created' END) AS issues FROM x) SELECT * FROM y WHERE issues <> ''""",
    "corpus_checks": f"""WITH {SQL}, dd AS (SELECT doc, document_type, document_applicable AS solutions, tags, status FROM chunks WHERE chunk % 3 = 0 AND (document_type <> 'case_study' OR doc % 2 = 0)), d2 AS (SELECT * FROM dd UNION ALL SELECT doc, document_type, document_applicable, tags, status FROM chunks WHERE chunk % 3 = 0 AND doc % 67 = 0),
        c1 AS (SELECT chunk, CASE WHEN chunk % 41 = 0 THEN -doc ELSE doc END AS doc, CASE WHEN chunk % 43 = 0 THEN 'other' ELSE document_type END AS document_type, document_applicable AS solutions, CASE WHEN chunk % 47 = 0 THEN ['x'] ELSE tags END AS tags, CASE WHEN chunk % 53 = 0 THEN 'x' ELSE status END AS status, CASE WHEN chunk % 59 = 0 THEN 7 ELSE chunk % 3 END AS ci FROM chunks), c2 AS (SELECT * FROM c1 UNION ALL SELECT * FROM c1 WHERE chunk % 61 = 0),
        kn AS (SELECT * FROM (VALUES (0, true), (1, true), (2, false), (4, true), (9, true)) AS t(solution, selected)), us AS (SELECT DISTINCT doc, document_type, unnest(solutions) AS solution FROM d2), u0 AS (SELECT doc, document_type, unnest(solutions) AS solution FROM d2), dp AS (SELECT DISTINCT doc, document_type AS t2, solutions AS s2, tags AS g2, status AS st2 FROM d2), j AS (SELECT c2.*, dp.* EXCLUDE (doc), dp.doc IS NOT NULL AS has FROM c2 LEFT JOIN dp USING (doc))
        SELECT 'repeated_doc' AS "check", CAST(doc AS VARCHAR) AS id, count(*) AS n FROM d2 GROUP BY doc HAVING count(*) > 1 UNION ALL SELECT 'repeated_chunk', CAST(chunk AS VARCHAR), count(*) FROM c2 GROUP BY chunk HAVING count(*) > 1
        UNION ALL SELECT 'missing_type', t, 1 FROM (VALUES ('solution'), ('capability'), ('case_study'), ('commercial_rule'), ('readiness')) AS v(t) WHERE t NOT IN (SELECT document_type FROM d2)
        UNION ALL SELECT 'unknown_solution', CAST(doc AS VARCHAR), count(*) FROM u0 WHERE solution NOT IN (SELECT solution FROM kn) GROUP BY doc UNION ALL SELECT 'solution_out_of_scope', CAST(doc AS VARCHAR), count(*) FROM u0 JOIN kn USING (solution) WHERE NOT selected GROUP BY doc
        UNION ALL SELECT 'solution_in_too_few_documents', CAST(solution AS VARCHAR), coalesce(n, 0) FROM kn LEFT JOIN (SELECT solution, count(DISTINCT doc) AS n FROM us WHERE document_type <> 'solution' GROUP BY 1) USING (solution) WHERE selected AND coalesce(n, 0) < 2
        UNION ALL SELECT 'orphan_chunk', CAST(chunk AS VARCHAR), 1 FROM j WHERE NOT has UNION ALL SELECT 'document_type_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE has AND document_type <> t2 UNION ALL SELECT 'solutions_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE has AND solutions <> s2 UNION ALL SELECT 'tags_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE has AND tags <> g2 UNION ALL SELECT 'status_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE has AND status <> st2
        UNION ALL SELECT 'chunk_index_gap', CAST(doc AS VARCHAR), count(*) FROM c2 GROUP BY doc HAVING min(ci) <> 0 OR max(ci) <> count(*) - 1 OR count(DISTINCT ci) <> count(*)""",
    "case_checks": f"""WITH {SQL}, n AS (SELECT q, count(*) AS n FROM gold GROUP BY q), nd AS (SELECT q, doc FROM gold WHERE kind = 'document') SELECT 'impossible_minimum_hits' AS "check", CAST(q AS VARCHAR) AS id, CAST(1 AS BIGINT) AS n FROM cases LEFT JOIN n USING (q) WHERE minimum_hits + 1 > coalesce(n, 0)
        UNION ALL SELECT 'unknown_document', CAST(q AS VARCHAR), count(*) FROM (SELECT q, doc FROM nd UNION ALL SELECT q, doc FROM bad) WHERE doc NOT IN (SELECT doc FROM chunks WHERE chunk % 3 = 0 AND doc % 10 <> 3) GROUP BY q UNION ALL SELECT 'unknown_chunk', CAST(q AS VARCHAR), count(*) FROM gold WHERE kind = 'chunk' AND chunk NOT IN (SELECT chunk FROM chunks WHERE chunk % 10 <> 4) GROUP BY q
        UNION ALL SELECT 'chunk_beyond_expected_documents', CAST(q AS VARCHAR), count(*) FROM gold g WHERE kind = 'chunk' AND q IN (SELECT q FROM nd) AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.q = g.q AND nd.doc = g.doc) GROUP BY q""",
    "case_identity_checks": f"""WITH {SQL}, c0 AS (SELECT q, q % 13 AS source, list_distinct(list_concat(scope, forbidden, [q % 7])) AS sols FROM cases), c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE q % 20 = 0), u AS (SELECT DISTINCT q, unnest(sols) AS s FROM c)
        SELECT 'repeated_case' AS "check", CAST(q AS VARCHAR) AS id, count(*) AS n FROM c GROUP BY q HAVING count(*) > 1 UNION ALL SELECT 'unknown_source_case', CAST(q AS VARCHAR), count(*) FROM c WHERE source = 5 GROUP BY q UNION ALL SELECT 'unknown_solution', CAST(q AS VARCHAR), count(*) FROM u WHERE s > 4 GROUP BY q UNION ALL SELECT 'solution_out_of_scope', CAST(q AS VARCHAR), count(*) FROM u WHERE s = 3 GROUP BY q""",
    "inheritance_checks": f"""WITH {SQL}, dc AS (SELECT doc, document_type, list_sort(industries) AS ind, status FROM chunks WHERE chunk % 3 = 0), b AS (SELECT chunk, doc, document_type, CASE WHEN chunk % 10 = 4 THEN list_sort(list_distinct(list_append(industries, 'i9'))) ELSE list_sort(industries) END AS ind, CASE WHEN chunk % 17 = 1 THEN 'draft' ELSE status END AS status FROM chunks),
        j AS (SELECT b.chunk, b.document_type <> dc.document_type AS a, b.ind <> dc.ind AS b_, b.status <> dc.status AS c FROM b JOIN dc USING (doc))
        SELECT 'document_type_mismatch' AS "check", CAST(chunk AS VARCHAR) AS id, CAST(1 AS BIGINT) AS n FROM j WHERE a UNION ALL SELECT 'industries_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE b_ UNION ALL SELECT 'status_mismatch', CAST(chunk AS VARCHAR), 1 FROM j WHERE c
        UNION ALL SELECT 'n_chunks_mismatch', 'manifest', (SELECT count(*) FROM chunks) WHERE (SELECT count(*) FROM chunks) <> (SELECT count(*) FROM dc) + 1""",
    "case_coverage": f"WITH {SQL} SELECT 'query_type' AS dimension, CAST(q % 8 AS VARCHAR) AS value, count(*) AS n FROM cases GROUP BY 2 UNION ALL SELECT 'forbids', CASE WHEN len(forbidden) > 0 THEN 'true' ELSE 'false' END, count(*) FROM cases GROUP BY 2 UNION ALL SELECT 'scope', CAST(len(scope) AS VARCHAR), count(*) FROM cases GROUP BY 2",
    "label_checks": f"""WITH {SQL}, t AS (SELECT doc, any_value(default_mode) AS dm FROM chunks GROUP BY doc), x AS (SELECT doc, doc % 17 <> 0 AS l, doc % 37 <> 0 AS t, (SELECT count(*) FROM chunks c WHERE c.doc = t.doc) AS n FROM t)
        SELECT doc, issues FROM (SELECT doc, concat_ws(',', CASE WHEN l AND NOT t THEN 'not_in_template' END, CASE WHEN t AND NOT l THEN 'not_labelled' END, CASE WHEN l AND t AND doc % 19 = 0 THEN 'place_moved' END, CASE WHEN l AND t AND doc % 23 = 0 AND n > 1 THEN 'chunks_differ' END, CASE WHEN l AND doc % 29 = 0 THEN 'default_mode_not_allowed' END, CASE WHEN l AND doc % 31 = 0 THEN 'override_not_allowed' END) AS issues FROM x WHERE l OR t) WHERE issues <> ''""",
    "label_counts": f"WITH {SQL} SELECT 'document' AS level, m AS mode, count(*) AS n FROM (SELECT doc, any_value(default_mode) AS m FROM chunks GROUP BY doc) GROUP BY 2 UNION ALL SELECT 'chunk', override_mode, count(*) FROM chunks WHERE override_mode IS NOT NULL GROUP BY 2",
    "seed_checks": """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS notes, count(*) FILTER (role = 'assistant') AS sol, bool_or(role = 'user' AND turn % 4 = 2) AS un FROM conversations GROUP BY 1), r AS (SELECT doc_id % 1000 AS conv_id, max(quality + toxic) AS traps FROM labels GROUP BY 1), j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, c.conv_id IS NOT NULL AS c, r.conv_id IS NOT NULL AS r, notes, sol, un, traps FROM c FULL JOIN r ON c.conv_id = r.conv_id)
        SELECT * FROM (SELECT conv_id, concat_ws(',', CASE WHEN NOT c THEN 'reference_without_case' END, CASE WHEN NOT r THEN 'case_without_reference' END, CASE WHEN c AND NOT coalesce(un, false) THEN 'no_unverified_note' END, CASE WHEN c AND notes < 2 THEN 'too_few:notes' END, CASE WHEN c AND sol < 2 THEN 'too_few:solutions' END, CASE WHEN r AND coalesce(traps, 0) < 1 THEN 'too_few:traps' END) AS issues FROM j) WHERE issues <> ''""",
    "scan_leaks": "SELECT page_id, 'marker' AS kind, m AS found FROM pages, (VALUES ('copyright'), ('evaluation_gold'), ('@')) AS t(m) WHERE contains(html, m) UNION ALL SELECT DISTINCT page_id, 'id', f FROM (SELECT page_id, unnest(regexp_extract_all(html, '-[0-9]+')) AS f FROM pages) WHERE f IN (SELECT '-' || s_suppkey FROM supplier)",
    "gold_isolation": "SELECT s_suppkey AS q, CASE s_suppkey % 3 WHEN 0 THEN 'minimum_hits' ELSE 'forbidden_solution_ids,minimum_hits' END AS leaked FROM supplier WHERE s_suppkey % 3 < 2",
    "unsafe_reasons": "WITH x AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '/home/' || coalesce(text, '') WHEN doc_id % 70 = 0 THEN coalesce(text, '') || ' REFERENCE PACK' ELSE text END AS v FROM documents) SELECT * FROM (SELECT doc_id, concat_ws(',', CASE WHEN " + " OR ".join(f"contains(lower(v), '{m}')" for m in SECRETS) + " THEN 'secret' END, CASE WHEN " + " OR ".join(f"starts_with(v, '{m}')" for m in PREFIXES) + " THEN 'absolute_path' END, CASE WHEN " + " OR ".join(f"contains(lower(v), '{m.lower()}')" for m in RUNTIME) + " THEN 'runtime_marker' END) AS reasons FROM x) WHERE reasons <> ''",
    "normalize_text": "SELECT doc_id, md5(trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '…', '...'), '[\\s\\x{a0}]+', ' ', 'g'))) AS text_md5 FROM documents",
    "tokenize_for_match": f"SELECT doc_id, len(u) AS n_tokens, md5(array_to_string(u, ' ')) AS tokens_md5 FROM (SELECT doc_id, CASE WHEN t IS NULL THEN NULL ELSE {_once('t')} END AS u FROM (SELECT doc_id, {_MATCH.format('text')} AS t FROM documents))",
    "split_sections": f"WITH {_SECTIONS} SELECT doc_id, place, title, md5(body) AS body_md5 FROM se",
    "inherit_metadata": f"WITH {_SECTIONS} SELECT doc_id, place AS chunk_index, lang, source, 'Document ' || doc_id || ' - ' || title AS citation_label FROM se JOIN documents USING (doc_id)",
    "derive_scope": f"""WITH {SQL}, s AS (SELECT chunk, doc, CASE WHEN chunk % 4 = 1 THEN 'solution_specific' ELSE scope_of END AS scope_type, chunk % 4 <> 1 AS inherited, CASE WHEN chunk % 4 = 1 THEN [doc % 4] ELSE document_applicable END AS a, document_applicable AS da FROM (SELECT c.*, CASE WHEN doc % 4 = 0 THEN 'solution_specific' ELSE f.st END AS scope_of FROM chunks c JOIN (SELECT doc, scope_type AS st FROM chunks WHERE chunk % 3 = 0) f USING (doc)))
        SELECT scope_type, inherited, len(list_filter(a, lambda x: NOT list_contains(da, x))) > 0 AS widened, count(*) AS n_chunks, CAST(sum(len(a)) AS BIGINT) AS n_solutions FROM s GROUP BY ALL""",
    "enriched_chunk_text": f"WITH {SQL} SELECT chunk, 'Title: ' || title || chr(10) || 'Summary: ' || summary || chr(10) || CASE WHEN chunk % 6 = 0 THEN '' ELSE 'Section: ' || section || chr(10) END || 'Content: ' || content AS text FROM chunks",
    "context_view_text": f"WITH {SQL} SELECT chunk, concat_ws(chr(10), 'Document Title: ' || title, 'Document Summary: ' || summary, 'Document Type: ' || document_type, 'Scope Type: ' || scope_type, 'Citation Label: ' || title || ' - ' || section, 'Section Heading: ' || section, 'Primary Solution Name: ' || {_names_sql('primary_solution')}, 'Applicable Solution Names: ' || array_to_string(list_transform(applicable, lambda x: {_names_sql('x')}), ', '), CASE WHEN len(industries) > 0 THEN 'Industries: ' || array_to_string(industries, ', ') END, CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END, 'Chunk Content: ' || content) AS text FROM chunks",
    "document_level_corpus": f"WITH {_DOCS} SELECT doc, doc || '#doc-000' AS chunk_id, concat_ws(chr(10), 'Title: ' || title, 'Summary: ' || summary, 'Document Type: ' || document_type, 'Content: ' || content) AS text, (SELECT string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY chunk) FROM chunks c WHERE c.doc = docs.doc) AS children FROM docs",
    "with_children_text": f"WITH {_DOCS} SELECT doc, concat_ws(chr(10), 'Document Title: ' || title, 'Document Summary: ' || summary, 'Document Type: ' || document_type, 'Child Citation Labels: ' || (SELECT string_agg(section, ' | ' ORDER BY chunk) FROM chunks c WHERE c.doc = docs.doc), 'Child Chunk Contents: ' || (SELECT string_agg(content, ' || ' ORDER BY chunk) FROM chunks c WHERE c.doc = docs.doc)) AS text FROM docs",
    "authoring_packet": f"WITH {_DOCS}, x AS (SELECT c.doc, c.chunk, c.scope_type <> d.scope_type OR c.primary_solution IS DISTINCT FROM d.primary_solution OR c.applicable <> d.applicable AS differs FROM chunks c JOIN docs d USING (doc)) SELECT doc, string_agg(chunk || ':' || CASE WHEN differs THEN 'true' ELSE 'false' END, ',' ORDER BY chunk) AS chunks, count(*) FILTER (differs) AS n_differing FROM x GROUP BY doc",
    "payload_consistency": "SELECT doc_id, 'removed' AS state FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT doc_id, 'changed' FROM documents WHERE doc_id % 10 <> 1 AND doc_id % 7 = 0 AND lang IS NOT NULL UNION ALL SELECT -doc_id - 1, 'added' FROM documents WHERE doc_id % 10 = 2",
    "opaque_ids_both_ways": "WITH x AS (SELECT 's-' || substr(sha256('salt:2.2:' || s_suppkey), 1, 16) AS opaque_id, s_suppkey FROM supplier) SELECT opaque_id, min(s_suppkey) AS s_suppkey, count(*) AS n_ids, count(DISTINCT s_suppkey) > 1 AS clashes FROM x GROUP BY 1",
    "hash_embedding": f"{_UNIT}, n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT item_id, round(v[1] / n, 6) AS first, round(v[34] / n, 6) AS later, CAST(len(v) AS BIGINT) AS dim FROM n",
    "embedding_delta": f"WITH {SQL} SELECT chunk, chunk % 2 = 0 AND chunk % 10 <> 0 AS hit FROM chunks",
    "decompose_query": f"SELECT item_id, len(u) AS n_clauses, md5(array_to_string(u, '|')) AS clauses_md5 FROM (SELECT item_id, CASE WHEN len(c) > 0 THEN {_once('c')} ELSE [text] END AS u FROM (SELECT item_id, text, {_CLAUSES} AS c FROM benchmark))",
    "augment_query": f"WITH {SQL}, p AS (SELECT q, query, CASE WHEN len(scope) > 0 THEN 'solution_scope ' || array_to_string(scope, ' ') END AS a, CASE WHEN len(ask_types) > 0 THEN 'document_types ' || array_to_string(ask_types, ' ') END AS b, CASE WHEN len(ask_industries) > 0 THEN 'industries ' || array_to_string(ask_industries, ' ') END AS c, CASE WHEN len(ask_tags) > 0 THEN 'tags ' || array_to_string(ask_tags, ' ') END AS e FROM (SELECT * EXCLUDE (scope), CASE WHEN q % 17 = 0 THEN [] ELSE list_filter([q % 5, (q * 3 + 1) % 5, (q + 2) % 5], lambda x, i: list_position([q % 5, (q * 3 + 1) % 5, (q + 2) % 5], x) = i) END AS scope FROM cases)) SELECT q, 'Q0' AS variant, query AS text FROM p UNION ALL SELECT q, 'Q2_scope', concat_ws(' | ', query, a) FROM p UNION ALL SELECT q, 'Q2_document_types', concat_ws(' | ', query, b) FROM p UNION ALL SELECT q, 'Q2_all', concat_ws(' | ', query, a, b, c, e) FROM p",
    "request_query": "SELECT c_custkey, concat_ws(chr(10), c_name, '行业：' || c_mktsegment, CASE WHEN c_acctbal > 0 THEN '目标：grow' END, CASE WHEN c_custkey % 3 <> 0 THEN '现有系统：CRM' END) AS text FROM customer",
    "match_solutions": f"""WITH q AS (SELECT s_suppkey, {_once(_MATCH.format("p_name || ' ' || p_brand"))} AS t, lower(p_name || ' ' || p_brand) AS nq FROM supplier JOIN part ON p_partkey = s_suppkey), c AS (SELECT p_partkey, {_once(_MATCH.format("p_name || ' ' || p_type"))} AS u, lower(p_name || ' ' || p_type) AS nc FROM part WHERE p_partkey % 50 = 7),
        p AS (SELECT s_suppkey, p_partkey, t, u, nq, nc, list_filter(t, lambda x: list_contains(u, x)) AS m FROM q, c), s AS (SELECT s_suppkey, p_partkey, m, 0.5::DOUBLE * (len(m) / least(len(t), len(u))) + 0.3::DOUBLE * (len(m) / (len(t) + len(u) - len(m))) + CASE WHEN contains(nq, nc) THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS score FROM p WHERE len(m) > 0)
        SELECT s_suppkey, p_partkey, round(score, 6) AS score, array_to_string(m, ' ') AS matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, p_partkey) AS rank FROM s WHERE score >= 0.05) WHERE rank <= 5""",
    "solution_query_text": """WITH l AS (SELECT l_orderkey, l_linenumber AS n, max(l_returnflag) AS f, max(l_partkey) AS p FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey, n AS a, 0 AS b, f || '-' || p AS t FROM l WHERE f <> 'R' UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN x.n = o.n + 1 THEN 1 ELSE 2 END, 'pain ' || x.p FROM l o JOIN l x ON x.l_orderkey = o.l_orderkey AND x.f = 'R' AND (x.n = o.n + 1 OR x.n = o.n - 1) WHERE o.f <> 'R'
        UNION ALL SELECT l_orderkey, 1099511627776, n, 'impact ' || n FROM l i WHERE p % 10 = 0 AND EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = i.l_orderkey AND l.f <> 'R')) SELECT l_orderkey, string_agg(t, ' ' ORDER BY a, b) AS query FROM e GROUP BY 1""",
}
