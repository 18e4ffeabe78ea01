"""Queries of the seven candidate generators over texts of the roles, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import candidates, corpus, diagnosis, eligibility, joins, lexical, metrics, vectors, within
from ..shared import durable
from . import retrieval, roles, scopes
from .roles import SQL

#: Every list of a case is so long; a larger one than the corpus ranks all of it.
DEPTH = 100
#: Dimension of the vectors made of digests.
DIM = 32
#: Ranks that the causes of a missing item compare, by generator.
CAUSES = {"current_rank": "G0", "prefilter_rank": "G1", "enriched_rank": "G2", "dual_rank": "G4"}
_CLASS = retrieval.CHUNK_CLASS


def _document_scope(spark: bool) -> tuple[str, str]:
    w = roles._words(spark)
    kind = "CASE doc % 4 WHEN 0 THEN 'solution_specific' WHEN 1 THEN 'multi_solution' WHEN 2 THEN 'cross_cutting_requirement' ELSE 'global_policy' END"
    return kind, f"CASE WHEN doc % 3 = 0 AND doc % 4 <> 3 THEN {w['L']}((doc + 4) % 5) ELSE {w['none']} END"


def units(spark: SparkSession, d: str) -> DataFrame:
    """view, unit (doc, chunk), text, section and what decides whether it may be indexed: chunks, chunks with their document's texts, and documents."""
    kind, excluded = _document_scope(True)
    chunks = roles.chunks(spark, d)
    unit = F.struct("doc", F.col("chunk").cast("long").alias("chunk"))
    plain = chunks.select(F.lit("chunk").alias("view"), unit.alias("unit"), F.col("content").alias("text"), "section", *_CLASS)
    rich = chunks.select(F.lit("enriched").alias("view"), unit.alias("unit"), corpus.enriched_chunk_text().alias("text"), "section", *_CLASS)
    told = ["doc", "title", "summary", "document_type", "document_applicable", "industries", "tags", "status", "effective_from", "effective_until"]
    docs = chunks.groupBy(*told).agg(F.array_sort(F.collect_list(F.struct("chunk", "content"))).alias("own"))  # three chunks a document
    docs = docs.withColumn("content", F.array_join(F.transform("own", lambda x: x["content"]), " ")).withColumn("scope_type", F.expr(kind)).withColumn("excluded", F.expr(excluded)).withColumn("applicable", F.col("document_applicable"))
    whole = docs.select(F.lit("document").alias("view"), F.struct("doc", F.lit(None).cast("long").alias("chunk")).alias("unit"), corpus.document_text().alias("text"), F.lit("").alias("section"), *_CLASS)
    return plain.unionByName(rich).unionByName(whole).withColumn("status", eligibility.status_class())


def _generated(spark: SparkSession, d: str, depth: int = DEPTH) -> DataFrame:
    cases = roles.cases(spark, d).withColumn("qc", joins.class_of(retrieval.CASE_LISTS))
    every = units(spark, d).withColumn("dc", joins.class_of(retrieval.CHUNK_LISTS))
    ask = retrieval.asked(spark, d).join(cases, "q").withColumn("v", vectors.hash_bytes(F.col("text"), "query", DIM))
    terms = durable(lexical.query_terms(ask, "q", "text"), "case-terms")
    old = every.withColumns({c: F.lit(None).cast("date") for c in ("effective_from", "effective_until")})
    old = joins.class_pairs(cases.select("qc", "effective_on", *retrieval.CASE_LISTS), old.select("dc", "effective_from", "effective_until", *retrieval.CHUNK_LISTS), *scopes.operational_filters())
    allowed = {"all": within.Allowed(old, starts=False, own=False), "eligible": within.Allowed(retrieval.eligible(cases, every), starts=True, own=True)}
    told = within.prepared(every.select("*", "unit.*", vectors.hash_bytes(F.col("text"), "document", DIM).alias("v")), {"text": 1, "section": 2}, terms)
    ranked = durable(within.best(told, ask, terms, allowed, depth, vector=True).drop("score"), "rankings")
    lists = candidates.opened(ranked, roles.chunks(spark, d).select("doc", F.col("chunk").cast("long").alias("chunk")), depth)
    return durable(candidates.generated(lists, depth), "candidates")


def _told(spark: SparkSession, d: str) -> DataFrame:
    return roles.told(spark, d, _generated(spark, d)).withColumn("eligible", eligibility.chunk_eligible())


def candidate_generators(spark, d):
    """The first twenty of every generator, method and case."""
    return _generated(spark, d).where("rank <= 20").select("variant", "method", "q", "doc", "chunk", F.col("rank").cast("long").alias("rank"))


def generator_summary(spark, d):
    """A row a generator and method: recall at three depths, rates of violations and forbidden hits, failed cases, place and next step."""
    want, _ = roles.gold(spark, d)
    r = _told(spark, d).select("variant", "method", "q", "rank", "item", (~F.col("eligible")).alias("violating"), F.col("forbidden_document").alias("forbidden"))
    runs = roles.cases(spark, d).select("q", F.explode(F.array(*map(F.lit, candidates.GENERATORS))).alias("variant")).select("*", F.explode(F.array(*map(F.lit, retrieval.METHODS))).alias("method"))
    s = metrics.variant_summary(metrics.candidate_recall(runs, r, want, ["variant", "method", "q"], "q", "item"), ["variant", "method"])
    return s.withColumn("next_step", metrics.next_step(s))


def generator_causes(spark, d):
    """Why each expected item is not among the first twenty of the current generator, from its ranks in the others."""
    want, _ = roles.gold(spark, d)
    x = candidates.item_places(_told(spark, d), want, CAUSES).where("current_rank is null or current_rank > 20")
    first = roles.chunks(spark, d).groupBy("doc").agg(F.min("chunk").alias("first_chunk"))
    x = x.join(first, "doc").withColumn("own", F.coalesce("chunk", "first_chunk"))
    t = roles.chunks(spark, d).select(F.col("chunk").alias("own"), tokens("content").alias("content"), tokens("title").alias("title"), tokens("summary").alias("summary"))
    x = x.join(t, "own").join(retrieval.asked(spark, d).select("q", tokens("text").alias("t")), "q")
    for c in ("content", "title", "summary"):
        x = x.withColumn(f"overlap_{c}", F.arrays_overlap("t", c))
    ranks = [F.col(c).cast("long").alias(c) for c in CAUSES]
    return x.select("method", "q", "item", *ranks, F.col("n_ineligible_ahead").cast("long").alias("n_ineligible_ahead"), "sibling_ahead", diagnosis.root_cause(x).alias("cause"))


QUERIES = {f.__name__: f for f in (candidate_generators, generator_summary, generator_causes)}

# --- SQL -----------------------------------------------------------------------------------------------------------

_DOC_SCOPE, _DOC_EXCLUDED = _document_scope(False)
_UNIT_COLUMNS = ", ".join(_CLASS)
_TITLES = "'Title: ' || title, 'Summary: ' || summary"
_VECTOR = f"list_transform(range({DIM}), lambda i: CAST('0x' || substr(a, CAST(2 * i + 1 AS INT), 2) AS INT) / CAST(255 AS DOUBLE) * 2 - 1)"
_UNITS = f"""dx AS (SELECT doc, title, summary, document_type, document_applicable AS applicable, industries, tags, status, effective_from, effective_until, string_agg(content, ' ' ORDER BY chunk) AS content FROM chunks GROUP BY ALL),
    un AS (SELECT 'chunk' AS view, 'c' || chunk AS unit, doc, CAST(chunk AS BIGINT) AS chunk, content AS text, section, {_UNIT_COLUMNS} FROM chunks
        UNION ALL SELECT 'enriched', 'c' || chunk, doc, chunk, concat_ws(chr(10), {_TITLES}, 'Section: ' || nullif(section, ''), 'Content: ' || content), section, {_UNIT_COLUMNS} FROM chunks
        UNION ALL SELECT 'document', 'd' || doc, doc, NULL, concat_ws(chr(10), {_TITLES}, 'Document Type: ' || document_type, 'Content: ' || content), '', {_UNIT_COLUMNS} FROM (SELECT *, {_DOC_SCOPE} AS scope_type, {_DOC_EXCLUDED} AS excluded FROM dx)),
    al AS (SELECT 'eligible' AS filter, view, q, unit, doc, chunk FROM cases, un WHERE {retrieval._ELIGIBLE} UNION ALL SELECT 'all', view, q, unit, doc, chunk FROM cases, un WHERE {scopes.OPERATIONAL})"""
_WORDS = f"""tk AS (SELECT view, unit, unnest({retrieval._TOK.format('text')}) AS term, 1 AS w FROM un UNION ALL SELECT view, unit, unnest({retrieval._TOK.format('section')}), 2 FROM un), tf AS (SELECT view, unit, term, sum(w) AS tf FROM tk GROUP BY ALL),
    ln AS (SELECT view, unit, coalesce(sum(tf), 0) AS length FROM un LEFT JOIN tf USING (view, unit) GROUP BY ALL),
    qt AS (SELECT q, t AS term, count(*) AS times, min(i) AS pos FROM (SELECT q, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT q, {retrieval._TOK.format('text')} AS ts FROM ask)) GROUP BY ALL),
    hq AS (SELECT filter, view, q, unit, doc, chunk, term, tf, length, times, pos FROM al JOIN tf USING (view, unit) JOIN ln USING (view, unit) JOIN qt USING (q, term)),
    st AS (SELECT 'eligible' AS filter, view, q, count(*) AS n, greatest(avg(length), 1) AS avgdl FROM al JOIN ln USING (view, unit) WHERE filter = 'eligible' GROUP BY view, q UNION ALL SELECT 'all', view, q, n, avgdl FROM (SELECT view, count(*) AS n, greatest(avg(length), 1) AS avgdl FROM ln GROUP BY view), cases),
    dq AS (SELECT filter, view, q, term, count(*) AS df FROM hq WHERE filter = 'eligible' GROUP BY ALL UNION ALL SELECT 'all', view, q, term, df FROM (SELECT view, term, count(*) AS df FROM tf GROUP BY ALL) JOIN qt USING (term)),
    lx AS (SELECT filter, view, 'lexical_v1' AS method, q, doc, chunk, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM hq JOIN dq USING (filter, view, q, term) JOIN st USING (filter, view, q) GROUP BY ALL HAVING score > 0)"""
_RANKINGS = f"""uv AS (SELECT view, unit, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT view, unit, {_VECTOR} AS v FROM (SELECT view, unit, sha256('document' || chr(31) || text) AS a FROM un))),
    qv AS (SELECT q, v AS w, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM (SELECT q, {_VECTOR} AS v FROM (SELECT q, sha256('query' || chr(31) || text) AS a FROM ask))),
    vx AS (SELECT filter, view, 'vector_v1' AS method, q, doc, chunk, round(list_dot_product(v, w) / n / m, 8) AS score FROM al JOIN uv USING (view, unit) JOIN qv USING (q)),
    rk AS (SELECT * FROM (SELECT filter, view, method, q, doc, chunk, row_number() OVER (PARTITION BY filter, view, method, q ORDER BY score DESC, doc, chunk NULLS FIRST) AS rank FROM (FROM lx UNION ALL FROM vx)) WHERE rank <= {DEPTH})"""
_USES = ", ".join(f"('{name}', '{kind}', '{view}')" for name, parts in candidates.GENERATORS.items() for kind, view in parts)
_GENERATED = f"""WITH {SQL}, {retrieval._ASK}, {_UNITS}, {_WORDS}, {_RANKINGS},
    op AS (SELECT r.filter, 'opened' AS view, r.method, r.q, r.doc, c.chunk, row_number() OVER (PARTITION BY r.filter, r.method, r.q ORDER BY r.rank, o.rank NULLS LAST, c.chunk) AS rank FROM rk r JOIN chunks c ON c.doc = r.doc LEFT JOIN rk o ON o.view = 'chunk' AND o.filter = r.filter AND o.method = r.method AND o.q = r.q AND o.chunk = c.chunk WHERE r.view = 'document'),
    li AS (SELECT * FROM rk WHERE view <> 'document' UNION ALL SELECT * FROM op WHERE rank <= {DEPTH}),
    ev AS (SELECT variant, method, q, doc, chunk, min(rank) FILTER (view <> 'opened') AS own, min(rank) FILTER (view = 'opened') AS byd FROM li JOIN (VALUES {_USES}) AS t(variant, filter, view) USING (filter, view) GROUP BY ALL),
    si AS (SELECT * FROM (SELECT variant, method, q, doc, chunk, row_number() OVER (PARTITION BY variant, method, q ORDER BY least(own, byd), coalesce(byd, 10000), coalesce(own, 10000), chunk) AS rank FROM ev) WHERE rank <= {DEPTH}),
    fu AS (SELECT *, row_number() OVER (PARTITION BY variant, q ORDER BY score DESC, doc, chunk) AS rank FROM (SELECT variant, q, doc, chunk, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 8) AS score FROM si WHERE variant NOT IN ('G5', 'G6') GROUP BY ALL)),
    ge AS (FROM si UNION ALL SELECT variant, 'hybrid_v1', q, doc, chunk, rank FROM fu WHERE rank <= {DEPTH} UNION ALL SELECT v, 'hybrid_v1', q, doc, chunk, rank FROM fu, (VALUES ('G5'), ('G6')) AS t(v) WHERE variant = 'G4' AND rank <= {DEPTH})"""
_TOLD = f"{_GENERATED}, {roles.told_sql('ge', 'gt')}, tl AS (SELECT *, {retrieval._ELIGIBLE} AS eligible FROM gt)"
_METHOD_ROWS = "(VALUES ('lexical_v1'), ('vector_v1'), ('hybrid_v1')) AS m(method)"
_VARIANT_ROWS = "(VALUES " + ", ".join(f"('{v}')" for v in candidates.GENERATORS) + ") AS v(variant)"
ORACLE = {
    "candidate_generators": f"{_GENERATED} SELECT variant, method, q, doc, chunk, rank FROM ge WHERE rank <= 20",
    "generator_summary": f"""{_TOLD}, gs AS (SELECT q, count(DISTINCT item) AS n FROM gold GROUP BY q),
        ra AS (SELECT variant, method, q, count(DISTINCT item) FILTER (relevant AND rank <= 5) h5, count(DISTINCT item) FILTER (relevant AND rank <= 10) h10, count(DISTINCT item) FILTER (relevant AND rank <= 20) h20, bool_or(NOT eligible AND rank <= 20) v, bool_or(forbidden_document AND rank <= 20) f FROM tl GROUP BY ALL),
        rc AS (SELECT v.variant, m.method, c.q, coalesce(h5 / n, 0) recall_5, coalesce(h10 / n, 0) recall_10, coalesce(h20 / n, 0) recall_20, coalesce(v, false) violation_20, coalesce(f, false) forbidden_20 FROM cases c CROSS JOIN {_VARIANT_ROWS} CROSS JOIN {_METHOD_ROWS} LEFT JOIN ra ON ra.variant = v.variant AND ra.method = m.method AND ra.q = c.q LEFT JOIN gs ON gs.q = c.q),
        g AS (SELECT variant, method, round(avg(recall_5), 6) recall_5, round(avg(recall_10), 6) recall_10, round(avg(recall_20), 6) recall_20, count(*) FILTER (recall_20 = 1) n_full, round(avg(violation_20::INT), 6) violation_rate, round(avg(forbidden_20::INT), 6) forbidden_rate, count(*) FILTER (recall_20 < 1) n_unresolved, count(*) FILTER (recall_20 < 1 OR violation_20 OR forbidden_20) n_failed FROM rc GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY recall_20 DESC, violation_rate, forbidden_rate, recall_5 DESC, n_failed, variant, method) AS place, CASE WHEN recall_20 = 1 AND violation_rate = 0 AND forbidden_rate = 0 THEN CASE WHEN recall_5 = 1 THEN 'candidate_generation_can_directly_promote_to_retriever_v2' ELSE 'design_deterministic_rerank_v2' END ELSE 'improve_candidate_generation_before_rerank' END AS next_step FROM g""",
    "generator_causes": f"""{_TOLD}, gi AS (SELECT DISTINCT q, item, doc, chunk FROM gold), now AS (SELECT *, coalesce(sum((NOT eligible)::INT) OVER (PARTITION BY method, q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM tl WHERE variant = 'G0'),
        ik AS (SELECT method, q, item, min(rank) FILTER (variant = 'G0') AS current_rank, min(rank) FILTER (variant = 'G1') AS prefilter_rank, min(rank) FILTER (variant = 'G2') AS enriched_rank, min(rank) FILTER (variant = 'G4') AS dual_rank FROM tl GROUP BY ALL),
        x AS (SELECT m.method, g.*, current_rank, prefilter_rank, enriched_rank, dual_rank, CAST(coalesce((SELECT min(ahead) FROM now n WHERE n.method = m.method AND n.q = g.q AND n.item = g.item), (SELECT count(*) FILTER (NOT eligible) FROM now n WHERE n.method = m.method AND n.q = g.q), 0) AS BIGINT) AS n_ineligible_ahead,
            g.chunk IS NOT NULL AND EXISTS (SELECT 1 FROM now n WHERE n.method = m.method AND n.q = g.q AND n.doc = g.doc AND n.chunk <> g.chunk AND n.rank < coalesce(current_rank, 10000)) AS sibling_ahead FROM gi g CROSS JOIN {_METHOD_ROWS} LEFT JOIN ik ON ik.method = m.method AND ik.q = g.q AND ik.item = g.item),
        y AS (SELECT x.*, list_has_any(t, {retrieval._TOK.format('c.content')}) AS co, list_has_any(t, {retrieval._TOK.format('c.title')}) AS ti, list_has_any(t, {retrieval._TOK.format('c.summary')}) AS su FROM x JOIN (SELECT doc, min(chunk) AS first FROM chunks GROUP BY doc) f USING (doc) JOIN chunks c ON c.chunk = coalesce(x.chunk, first) JOIN (SELECT q, {retrieval._TOK.format('text')} AS t FROM ask) a ON a.q = x.q)
        SELECT method, q, item, current_rank, prefilter_rank, enriched_rank, dual_rank, n_ineligible_ahead, sibling_ahead,
            CASE WHEN n_ineligible_ahead > 0 AND prefilter_rank IS NOT NULL AND (current_rank IS NULL OR prefilter_rank < current_rank) THEN 'runtime_ineligible_crowding' WHEN sibling_ahead THEN 'expected_sibling_chunk_substitution' WHEN dual_rank <= 20 AND (current_rank IS NULL OR dual_rank < current_rank) THEN 'parent_document_signal_missing'
            WHEN enriched_rank <= 20 AND (current_rank IS NULL OR enriched_rank < current_rank) THEN CASE WHEN ti AND NOT co THEN 'title_not_indexed' WHEN su AND NOT co THEN 'summary_not_indexed' ELSE 'chunk_context_insufficient' END WHEN method = 'lexical_v1' AND NOT co AND NOT ti AND NOT su THEN 'lexical_term_mismatch' WHEN method = 'vector_v1' THEN 'vector_semantic_mismatch' WHEN method = 'hybrid_v1' THEN 'hybrid_candidate_union_gap' ELSE 'unknown_candidate_generation_cause' END AS cause
        FROM y WHERE current_rank IS NULL OR current_rank > 20""",
}
