"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizers(folder: str = "/opt"):
    """The module that describes the public vocabulary files, found beside their folder."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        import importlib.util

        spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/tokenizers/__init__.py")
        public_tokenizers = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public_tokenizers)
    return public_tokenizers


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    return language.identify(_t(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    got = decontaminate.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_model
    from .sampling import fold

    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    known = labels.where((fold("doc_id", 5) != 0) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    got = quality_model.classify(docs, docs.select("doc_id", "text"), known)
    return got.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    # the trusted target: all documents labelled good
    return quality_rules.judge(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").where("quality = 1"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(_t(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shared import fresh_path
    from . import archive

    folder = fresh_path(spark, "warc")
    archive.write_archive(_t(spark, sf_dir, "pages"), folder, min_bytes=0)
    return archive.read_index(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    got = line_dedup.remove_boilerplate(_t(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("_wl_lines").alias("n_lines"), F.col("_wl_removed").alias("n_removed"), F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


#: Listed url rules, longest match first in effect.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_rules

    return url_rules.judge(_t(spark, sf_dir, "pages"), URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .sampling import fold

    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    known = labels.where((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "text"), known, power=2.0))
    return got.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def bpe_digests(docs: DataFrame, stored: bool, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    from . import bpe

    P = tokenizers()
    ranks = bpe.load_ranks(docs.sparkSession, P.path(vocabulary))
    return bpe.encode(docs, ranks, P.PATTERN, stored, digests=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_t(spark, sf_dir, "documents"), stored=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_codes

    coded, books = vector_codes.compress(_t(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_links

    return vector_links.near_copies(_t(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import alignment

    P = tokenizers()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    known = alignment.Tokenizers(alignment.byte_level_ranks(P.path("byte_bpe_50k.json")), P.PATTERN, model)
    return alignment.link_counts(_t(spark, sf_dir, "documents"), known)[0]


QUERIES = {k: v for k, v in vars(sys.modules[__name__]).items() if k.startswith("op") and k[2:3].isdigit()}


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds of op11 one after another. Doubles hold every number exactly: components are some thousands at most."""
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS w FROM k, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, w AS e FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p.part, any_value(w) AS w, min(struct_pack(d := CAST(list_inner_product(w, w) - 2 * list_inner_product(w, e) + list_inner_product(e, e) AS BIGINT), entry := entry)) AS near FROM p JOIN b{r} USING (part) GROUP BY vec_id, p.part)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, entry, list(x ORDER BY i) AS e FROM (SELECT part, near.entry AS entry, i, floor(sum(w[i]) / count(*)) AS x FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(w)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)")
    last = f"""
        c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', near.entry)), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN e], ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM c"""
    return "WITH " + ",\n        ".join(steps) + "," + last


ORACLE: dict[str, str] = {
    # Copies of one payload share its bytes, so text equality stands for digest equality
    "op6_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
            array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
            CASE WHEN page_id = least_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = least_id THEN NULL ELSE least_id END AS refers_to
        FROM (SELECT *, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages)""",
    "op7_line_dedup": """
        WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, CAST(i AS INT) AS i, ls[i] AS line, trim(ls[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
                   FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
        b AS (SELECT bare, min(struct_pack(d := doc_id, i := i)) AS first FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 6),
        k AS (SELECT l.*, b.bare IS NOT NULL AND NOT (b.first.d = l.doc_id AND b.first.i = l.i) AS gone FROM l LEFT JOIN b ON b.bare = l.bare),
        r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t) AS text_sha256 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op11_vector_codes": _codes_sql(),
}
