"""All registered queries of the retrieval, evaluation, run-log and deal jobs, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_id, token_estimate, tokens
from ..operators import checks, deals, fusion, lexical, metrics, runs, vectors
from ..shared import durable
from . import corpora, dealplans, generators, modelruns, reports, retrieval, scopes

FIELDS = {"text": 1, "source": 2}
FLAGSHIP = "lexical_summary"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- roles of the tables: `documents` are the corpus, `benchmark` the queries, `labels.toxic` marks what is forbidden


def _bm25_top(spark: SparkSession, d: str, k: int, matched: bool = False) -> DataFrame:
    terms = lexical.query_terms(_t(spark, d, "benchmark"), "item_id", "text")
    return lexical.bm25_top(_t(spark, d, "documents"), "doc_id", FIELDS, terms, "item_id", k, matched)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold of the test role: documents that hold a line of the item, of 12 characters or more."""
    line = lambda t, k: _t(spark, d, t).select(k, F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 12")
    asked = durable(line("benchmark", "item_id").distinct(), "item-lines")
    asked = F.broadcast(asked) if asked.count() <= lexical.BROADCAST_TERMS else asked  # beyond that a hot line is split as Spark splits skewed joins
    return line("documents", "doc_id").join(asked, "line").select("item_id", "doc_id").distinct()


def tokenize(spark, d):
    t = _t(spark, d, "documents").select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def postings_df(spark, d):
    return lexical.postings(_t(spark, d, "documents"), "doc_id", FIELDS).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, d):
    return _bm25_top(spark, d, 5).select("item_id", "doc_id", "score")


def matched_terms(spark, d):
    return _bm25_top(spark, d, 5, matched=True).select("item_id", "doc_id", F.array_join("matched_terms", " ").alias("matched"))


def _scores(spark, d):
    bad = _t(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("forbidden")).distinct()
    ranked = _bm25_top(spark, d, 5).select("item_id", "doc_id", "rank").join(bad, "doc_id", "left")
    return metrics.case_scores(_t(spark, d, "benchmark").select("item_id"), ranked, _gold(spark, d), ["item_id"], "item_id", "doc_id")


def case_scores(spark, d):
    return _scores(spark, d).withColumn("reasons", F.array_join("reasons", ",")).drop("boundary_violation", "request_error")


def lexical_summary(spark, d):
    s = metrics.method_summary(_scores(spark, d).withColumn("method", F.lit("lexical")), ["item_id"])
    return s.withColumn("reasons", F.array_join("reasons", ","))


def reason_counts(spark, d):
    return metrics.reason_counts(_scores(spark, d).withColumn("method", F.lit("lexical")), ["method"])


def recall_ceiling(spark, d):
    cases = _t(spark, d, "benchmark").select("item_id", (1 + F.col("item_id") % 7).alias("minimum_hits"))
    return metrics.recall_ceiling(_gold(spark, d), cases, "item_id", "doc_id")


def expected_ranks(spark, d):
    return metrics.expected_ranks(_gold(spark, d), _bm25_top(spark, d, 20), [], "item_id", "doc_id")


def cosine_topk(spark, d):
    e = _t(spark, d, "embeddings")
    got = vectors.cosine_topk(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return got.select("query_id", "rank", F.round("score", 4).alias("score"))


def validate_vectors(spark, d):
    e = _t(spark, d, "embeddings").withColumn("ok", vectors.valid("embedding", 64))
    return e.groupBy("label", "ok").agg(F.count("*").alias("n_vectors"))


def normalize_vectors(spark, d):
    """Vectors at unit length; those of every seventh id have been zeroed and have none."""
    e = _t(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.transform("embedding", lambda x: x * 3)))
    v = e.select("vec_id", vectors.normalized("embedding").alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


def rrf_many(spark, d):
    """Two lists of event types a user: by count and by total value."""
    e = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    lists = {"count": lexical.top(e, "user_id", [F.desc("n"), "event_type"], 3), "value": lexical.top(e, "user_id", [F.desc("v"), "event_type"], 3)}
    return fusion.rrf(lists, "user_id", "event_type", k=5).select("user_id", "event_type", F.round("score", 6).alias("score"), "rank", "count_rank", "value_rank")


def parent_child_topk(spark, d):
    """Customers of a nation by balance, opened to at most two orders each by price."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("p"), "c_acctbal")
    ranked = lexical.top(c, "q", [F.desc("c_acctbal"), "p"], 10)
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("o"), "o_totalprice")
    own = ranked.select("q", "p").join(o, "p").select("q", "o", "o_totalprice")
    ranks = lexical.top(own, "q", [F.desc("o_totalprice"), "o"], 20)
    return fusion.children_of(ranked, o.select("p", "o"), ranks, "q", "p", "o", 2)


# --- run log: events are runs; the user's remainder names the model, the event type the node


def _runs(spark, d):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    cost = runs.request_cost((k * 1000).cast("decimal(18,0)"), (k * 100).cast("decimal(18,0)"), F.lit("0.3").cast("decimal(9,3)"), F.lit("1.2").cast("decimal(9,3)")).cast("double")
    return e.select("event_id", "ts", F.col("event_type").alias("node"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("latency"), k.alias("tokens"), cost.alias("cost"), (F.col("value") < 450).alias("fast"), (k < 90).alias("small"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string"))).alias("error_type"))


def budget_cutoff(spark, d):
    """Five thousand tokens a (node, model); hours are summed first, rows are gone through only where a group stops."""
    kept = runs.budget_cutoff(_runs(spark, d).withColumn("cost", F.col("tokens")), ["node", "model"], ["ts", "event_id"], 5000, bucket=F.date_trunc("hour", "ts"))
    return kept.groupBy("node", "model").agg(F.count("*").alias("n_run"), F.sum("tokens").alias("tokens"))


def best_by_dimension(spark, d):
    m = _runs(spark, d).groupBy("model").agg(F.round(F.avg("latency"), 4).alias("latency"), F.round(F.avg("tokens"), 4).cast("double").alias("tokens"))
    return runs.best_by_dimension(m, ["latency", "tokens"], "model")


# --- checks


def duplicate_keys(spark, d):
    docs = _t(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id")
    return checks.duplicate_keys(docs, "key", "doc_id")


def manifest(spark, d):
    return checks.manifest(_t(spark, d, "documents"), "source")


def content_hash(spark, d):
    return checks.content_hash(_t(spark, d, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


def diff_tables(spark, d):
    a, b = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), _t(spark, d, "documents")
    b = b.where("doc_id % 10 <> 3").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source", (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("long")).alias("n_chars"))
    return checks.diff(a, b, "doc_id", ["lang", "source", "n_chars"])


MARKS = ["rights reserved", "@", "akia", "password", "secret"]


def unsafe_values(spark, d):
    return checks.unsafe_values(_t(spark, d, "documents"), "doc_id", "text", MARKS).withColumn("marks", F.array_join("marks", ","))


def chunk_ids(spark, d):
    """Lines as chunks, with ids and token estimates."""
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return x.select("doc_id", F.col("i").cast("long").alias("i"), chunk_id(F.col("doc_id"), F.col("i"), F.col("content")).alias("chunk_id"), token_estimate(F.col("content")).cast("long").alias("token_estimate"))


# --- more of run logs, scopes, checks and deals


def run_manifest_counts(spark, d):
    return runs.manifest_counts(_runs(spark, d), "node", F.col("fast") & F.col("small"))


def latency_summary(spark, d):
    return runs.latency_summary(_runs(spark, d), "model")


def provider_status(spark, d):
    return runs.provider_status(_runs(spark, d), "model")


def usage_totals(spark, d):
    return runs.usage_totals(_runs(spark, d), "node", ["ts", "event_id"]).withColumn("models", F.array_join("models", ","))


def coverage_summary(spark, d):
    return checks.coverage(_t(spark, d, "events").select("event_type", (F.col("user_id") % 7).cast("string").alias("shard"), "user_id"), ["event_type", "shard"], "user_id")


def opaque_ids(spark, d):
    return checks.opaque_ids(_t(spark, d, "customer"), "c_custkey", "c", "salt", "v1")


def unknown_ids(spark, d):
    """Supplier codes of lines that are not among the suppliers with a positive balance."""
    used = _t(spark, d, "lineitem").select(F.concat(F.lit(" S"), F.col("l_suppkey").cast("string")).alias("code"))
    return checks.unknown_ids(used, "code", _t(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("s_code")), "s_code")




GOALS = {"ask": "how|what|why", "number": "[0-9]", "write": "write|summar|explain"}


def dedupe_evidence(spark, d):
    """First turn of each (conversation, role, text)."""
    return checks.keep_first(_t(spark, d, "conversations"), ["conv_id", "role", "text"], ["turn"]).select("conv_id", "role", "turn")


def duplicate_sources_topk(spark, d):
    top = _bm25_top(spark, d, 5).select("item_id", "doc_id").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return top.groupBy("item_id").agg((F.count("source") - F.count_distinct("source")).alias("n_repeated"))


def blocking_gate(spark, d):
    s = metrics.method_summary(_scores(spark, d).withColumn("method", F.lit("lexical")), ["item_id"])
    failed = metrics.blocking_gate(s)
    return s.select("method", F.array_join(failed, ",").alias("failed_gates"), (F.size(failed) == 0).alias("passed"))


_NAMES = "tokenize postings_df bm25_topk matched_terms case_scores lexical_summary reason_counts recall_ceiling expected_ranks cosine_topk validate_vectors normalize_vectors rrf_many parent_child_topk budget_cutoff best_by_dimension duplicate_keys manifest content_hash diff_tables unsafe_values chunk_ids run_manifest_counts latency_summary provider_status usage_totals coverage_summary opaque_ids unknown_ids dedupe_evidence duplicate_sources_topk blocking_gate"
QUERIES = {n: globals()[n] for n in _NAMES.split()}
for _part in (scopes, retrieval, generators, corpora, modelruns, dealplans, reports):
    QUERIES |= _part.QUERIES

_TOK = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+(?:[-_][a-z0-9]+)*')"
_POST = f"""tok AS (SELECT doc_id, unnest({_TOK.format("coalesce(text, '')")}) AS term, 1 AS w FROM documents UNION ALL SELECT doc_id, unnest({_TOK.format("coalesce(source, '')")}), 2 FROM documents),
    post AS (SELECT doc_id, term, sum(w) AS tf FROM tok GROUP BY ALL)"""
_BM25 = f"""{_POST}, len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS length FROM documents d LEFT JOIN post USING (doc_id) GROUP BY 1),
    st AS (SELECT count(*) AS n, greatest(avg(length), 1) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    q AS (SELECT item_id, t AS term, count(*) AS times, min(i) AS pos FROM (SELECT item_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT item_id, {_TOK.format("text")} AS ts FROM benchmark)) GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score, string_agg(term, ' ' ORDER BY pos, term) AS matched
           FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL HAVING score > 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc),
    gold AS (SELECT DISTINCT item_id, doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) USING (line) WHERE length(line) >= 12)"""
_CASES = f"""{_BM25}, m AS (SELECT r.*, g.doc_id IS NOT NULL AS rel, l.doc_id IS NOT NULL AS bad FROM rk r LEFT JOIN gold g USING (item_id, doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id) WHERE rank <= 5),
    a AS (SELECT item_id, count(DISTINCT CASE WHEN rel AND rank <= 1 THEN doc_id END) h1, count(DISTINCT CASE WHEN rel AND rank <= 3 THEN doc_id END) h3, count(DISTINCT CASE WHEN rel THEN doc_id END) h5, count(*) FILTER (rank <= 3) r3, count(*) r5, min(rank) FILTER (rel) f, bool_or(bad) bad FROM m GROUP BY 1),
    g AS (SELECT item_id, count(*) n FROM gold GROUP BY 1),
    cs AS (SELECT b.item_id, coalesce(h1 / n, 0) recall_1, coalesce(h3 / n, 0) recall_3, coalesce(h5 / n, 0) recall_5, coalesce(h3 / r3, 0) precision_3, coalesce(h5 / r5, 0) precision_5, coalesce(1 / f, 0) reciprocal_rank, coalesce(h5, 0) relevant_hits, coalesce(bad, false) forbidden_hit,
        list_filter([CASE WHEN coalesce(h5 / n, 0) < 1 THEN 'recall_at_5_below_pilot_gate' END, CASE WHEN coalesce(bad, false) THEN 'forbidden_hit_detected' END, CASE WHEN coalesce(h5, 0) < 1 THEN 'minimum_relevant_hits_not_met' END], lambda x: x IS NOT NULL) AS rs
        FROM benchmark b LEFT JOIN a USING (item_id) LEFT JOIN g USING (item_id))"""
_RUNS = """r AS (SELECT *, bad_k AS tokens, round_even((bad_k * 1000 * 0.3 + bad_k * 100 * 1.2) / 1000000, 6) AS cost FROM (SELECT event_id, ts, event_type AS node, 'm' || (user_id % 3) AS model, value AS latency, CAST(props->>'$.k' AS BIGINT) AS bad_k, value < 450 AS fast, CAST(props->>'$.k' AS BIGINT) < 90 AS small, CASE WHEN user_id % 4 > 0 THEN 'e' || (user_id % 4) END AS error_type FROM events)),
    s AS (SELECT node, model, count(*) n_runs, round(avg(fast::INT), 6) fr, round(avg(small::INT), 6) sr, round(avg(latency), 3) ml, sum(tokens)::BIGINT tokens, round(sum(cost), 6) cost, fr >= 0.9 AND sr >= 0.85 AS eligible FROM r GROUP BY ALL)"""
ORACLE = {
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
    "postings_df": f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1",
    "bm25_topk": f"WITH {_BM25} SELECT item_id, doc_id, score FROM rk WHERE rank <= 5",
    "matched_terms": f"WITH {_BM25} SELECT item_id, doc_id, matched FROM rk WHERE rank <= 5",
    "case_scores": f"WITH {_CASES} SELECT * EXCLUDE (rs), array_to_string(rs, ',') AS reasons FROM cs",
    "lexical_summary": f"WITH {_CASES}, fs AS (SELECT x, min(row(item_id, i)) AS at_ FROM (SELECT item_id, unnest(rs) AS x, unnest(range(len(rs))) AS i FROM cs) GROUP BY x) SELECT 'lexical' AS method, count(*) AS n_cases, round(avg(recall_1), 6) recall_1, round(avg(recall_3), 6) recall_3, round(avg(recall_5), 6) recall_5, round(avg(precision_3), 6) precision_3, round(avg(precision_5), 6) precision_5, round(avg(reciprocal_rank), 6) reciprocal_rank, round(avg(forbidden_hit::INT), 6) AS forbidden_rate, CAST(0 AS DOUBLE) AS violation_rate, CAST(0 AS BIGINT) AS n_errors, count(*) FILTER (len(rs) = 0) AS n_passed, coalesce((SELECT string_agg(x, ',' ORDER BY at_) FROM fs), '') AS reasons FROM cs",
    "reason_counts": f"WITH {_CASES} SELECT 'lexical' AS method, reason, count(*) AS n_cases FROM (SELECT unnest(rs) AS reason FROM cs) GROUP BY ALL",
    "recall_ceiling": f"WITH {_BM25}, g AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1) SELECT item_id, n_gold, least(n_gold, 5) / n_gold AS ceiling, n_gold <= 5 AS recall_feasible, 1 + item_id % 7 <= 5 AND 1 + item_id % 7 <= n_gold AS hits_feasible FROM g",
    "expected_ranks": f"WITH {_BM25} SELECT g.item_id, g.doc_id, rank FROM gold g LEFT JOIN (SELECT * FROM rk WHERE rank <= 20) r USING (item_id, doc_id)",
    "cosine_topk": "SELECT * FROM (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE rank <= 5",
    "validate_vectors": "SELECT label, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, count(*) AS n_vectors FROM embeddings GROUP BY ALL",
    "normalize_vectors": "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) END AS first, CASE WHEN vec_id % 7 <> 0 THEN CAST(1 AS DOUBLE) END AS square FROM embeddings",
    "rrf_many": """WITH e AS (SELECT user_id, event_type, count(*) n, round(sum(value), 2) v FROM events GROUP BY ALL),
        a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) rank FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) rank FROM e),
        f AS (SELECT user_id, event_type, min(c) AS count_rank, min(w) AS value_rank, round(sum(1.0::DOUBLE / (60 + coalesce(c, w))), 8) AS s FROM (SELECT user_id, event_type, rank c, NULL w FROM a WHERE rank <= 3 UNION ALL SELECT user_id, event_type, NULL, rank FROM b WHERE rank <= 3) GROUP BY ALL)
        SELECT user_id, event_type, round(s, 6) AS score, rank, count_rank, value_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS rank FROM f) WHERE rank <= 5""",
    "parent_child_topk": """WITH r AS (SELECT * FROM (SELECT c_nationkey q, c_custkey p, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) pr FROM customer) WHERE pr <= 10),
        own AS (SELECT * FROM (SELECT q, o_orderkey o, row_number() OVER (PARTITION BY q ORDER BY o_totalprice DESC, o_orderkey) rk FROM r JOIN orders ON o_custkey = p) WHERE rk <= 20),
        c AS (SELECT r.q, r.p, o_orderkey o, pr AS parent_rank, row_number() OVER (PARTITION BY r.q, r.p ORDER BY rk ASC NULLS LAST, o_orderkey) nth FROM r JOIN orders ON o_custkey = p LEFT JOIN own ON own.q = r.q AND own.o = o_orderkey)
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY parent_rank, nth) AS rank FROM c WHERE nth <= 2""",
    "budget_cutoff": f"WITH {_RUNS}, c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY node, model ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT node, model, count(*) AS n_run, CAST(sum(tokens) AS BIGINT) AS tokens FROM c WHERE before < 5000 GROUP BY ALL",
    "best_by_dimension": f"WITH {_RUNS}, m AS (SELECT model, round(avg(latency), 4) AS latency, round(avg(tokens), 4) AS tokens FROM r GROUP BY 1), l AS (SELECT model, 'latency' AS dimension, latency AS mean FROM m UNION ALL SELECT model, 'tokens', tokens FROM m) SELECT dimension, model, mean FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY mean DESC, model) n FROM l) WHERE n = 1",
    "duplicate_keys": "SELECT * FROM (SELECT md5(text) AS key, min(doc_id) OVER (PARTITION BY text) AS first_line, doc_id AS line FROM documents) WHERE line > first_line",
    "manifest": "SELECT source, count(*) AS n_rows FROM documents GROUP BY 1",
    "content_hash": "WITH h AS (SELECT sha256(array_to_string([CASE WHEN x IS NULL THEN '0' ELSE '1' || length(x) || ':' || x END FOR x IN [doc_id::VARCHAR, text, lang, source, n_chars::VARCHAR]], '')) AS x FROM documents), p AS (SELECT CAST('0x' || substr(x, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(x, 16, 15) AS BIGINT) AS b FROM h) SELECT count(*) AS n_rows, CAST(sum(a % 1000000007) AS BIGINT) AS hash_sum, bit_xor(a) AS hash_xor, bit_xor(b) AS hash_xor2 FROM p",
    "diff_tables": """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source, n_chars + (doc_id % 5 = 0)::INT AS n_chars FROM documents WHERE doc_id % 10 <> 3)
        SELECT doc_id, c AS "column" FROM (SELECT doc_id, unnest(list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END], lambda x: x IS NOT NULL)) AS c FROM documents a FULL JOIN b USING (doc_id))""",
    "unsafe_values": "SELECT doc_id, marks FROM (SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{m}' END" for m in MARKS) + ") AS marks FROM documents) WHERE marks <> ''",
    "chunk_ids": "SELECT doc_id, i, doc_id || printf('#chunk-%03d-', i) || substr(sha1(doc_id || ':' || i || ':' || c), 1, 12) AS chunk_id, CAST(greatest(1, ceil(length(c) / 4)) AS BIGINT) AS token_estimate FROM (SELECT doc_id, unnest(s) AS c, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))",
    "run_manifest_counts": f"WITH {_RUNS} SELECT node, count(*) AS n_planned, count(*) FILTER (error_type IS NULL) AS n_completed, count(*) FILTER (error_type IS NULL AND coalesce(fast AND small, false)) AS n_passed, count(*) FILTER (error_type IS NULL AND NOT coalesce(fast AND small, false)) AS n_failed, count(error_type) AS n_errors, count(*) FILTER (cost IS NULL) AS n_unknown_cost FROM r GROUP BY 1",
    "latency_summary": f"WITH {_RUNS} SELECT model, count(latency) AS n, round(avg(latency), 3) AS mean, max(latency) AS most, min(latency) AS least, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM r GROUP BY 1",
    "provider_status": f"WITH {_RUNS} SELECT model, count(*) AS n_cases, count(error_type) AS n_errors, CASE WHEN count(error_type) = 0 THEN 'completed' WHEN count(error_type) < count(*) THEN 'completed_with_case_errors' ELSE 'failed' END AS status FROM r GROUP BY 1",
    "usage_totals": f"WITH {_RUNS}, f AS (SELECT node, model, min(row(ts, event_id)) AS first_at, sum(tokens) AS t FROM r GROUP BY ALL) SELECT node, CAST(sum(t) AS BIGINT) AS tokens, string_agg(model, ',' ORDER BY first_at, model) AS models FROM f GROUP BY 1",
    "coverage_summary": "SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY 2 UNION ALL SELECT 'shard', CAST(user_id % 7 AS VARCHAR), count(*), count(DISTINCT user_id) FROM events GROUP BY 2",
    "opaque_ids": "SELECT c_custkey, 'c-' || substr(sha256('salt:v1:' || c_custkey), 1, 16) AS opaque_id, false AS clashes FROM customer",
    "unknown_ids": "SELECT 's' || l_suppkey AS id, count(*) AS n_rows FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
    "dedupe_evidence": "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role, text",
    "duplicate_sources_topk": f"WITH {_BM25} SELECT item_id, count(source) - count(DISTINCT source) AS n_repeated FROM rk JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1",
    "blocking_gate": f"WITH {_CASES}, s AS (SELECT avg(recall_5) < 1 AS a, bool_or(forbidden_hit) AS b, bool_or(len(rs) > 0) AS c FROM cs) SELECT 'lexical' AS method, concat_ws(',', CASE WHEN a THEN 'summary_recall_at_5' END, CASE WHEN b THEN 'forbidden_hit_rate' END, CASE WHEN c THEN 'all_cases_pass_blocking_gate' END) AS failed_gates, NOT (a OR b OR c) AS passed FROM s",
}
for _part in (scopes, retrieval, generators, corpora, modelruns, dealplans, reports):
    ORACLE |= _part.ORACLE
