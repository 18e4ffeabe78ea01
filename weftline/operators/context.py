"""From ranked candidates to context: blocks, citations, completeness, summaries, query texts, diverse selections.

Rows have query, rank, kind (document or chunk), doc, chunk, eligible and, where blocks are made, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lowered, plain_tokens


def blocks(rows: DataFrame, query: str) -> DataFrame:
    """Blocks of each query in rank order: eligible rows, the first of each document or chunk; `repeats` counts the later ones."""
    ok = rows.where("eligible")
    name = F.concat(F.col("kind"), F.lit("-block:"), F.when(F.col("kind") == "document", F.col("doc").cast("string")).otherwise(F.col("chunk").cast("string")))
    named = ok.withColumn("block", name)
    w = Window.partitionBy(query, "block")
    first = named.withColumn("n", F.row_number().over(w.orderBy("rank"))).withColumn("repeats", F.count("*").over(w) - 1).where("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def materialize(rows: DataFrame, query: str) -> DataFrame:
    """Per query: blocks by kind, characters, repeated rows left out, and whether two blocks have the same text but for white space."""
    b = blocks(rows, query).withColumn("same", F.md5(F.trim(F.regexp_replace("content", r"\s+", " "))))
    return b.groupBy(query).agg(F.count_if(F.col("kind") == "document").alias("n_document_blocks"), F.count_if(F.col("kind") == "chunk").alias("n_chunk_blocks"), F.sum(F.length("content")).cast("long").alias("n_characters"), F.sum("repeats").alias("n_repeats"), (F.count_distinct("same") < F.count("*")).alias("duplicate_content"))


def citation_groups(rows: DataFrame, query: str) -> DataFrame:
    """Eligible rows under their document: place by its first row, chunks in rank order."""
    g = rows.where("eligible").groupBy(query, "doc").agg(F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "chunk", F.struct("rank", "chunk")))), lambda x: x["chunk"]).alias("chunks"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("first"))).drop("first")


def completeness(queries: DataFrame, rows: DataFrame, query: str) -> DataFrame:
    """Every query with the ordered reasons why its evidence is not complete."""
    m = materialize(rows, query)
    clash = F.col("parent") != F.col("doc") if "parent" in rows.columns else F.lit(False)
    g = rows.groupBy(query).agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_ok"), F.count_if(F.col("eligible") & (F.col("kind") == "chunk")).alias("n_chunks"), F.coalesce(F.bool_or((F.col("kind") == "chunk") & clash), F.lit(False)).alias("clash"))
    j = queries.select(query).join(g, query, "left").join(m, query, "left").na.fill(0).na.fill(False)
    n_blocks = F.col("n_document_blocks") + F.col("n_chunk_blocks")
    reasons = F.array_compact(F.array(
        F.when(F.col("n") == 0, F.lit("hierarchical_pool_empty")), F.when((F.col("n") > 0) & (F.col("n_ok") == 0), F.lit("runtime_eligibility_rejected_all_candidates")),
        F.when((F.col("n_ok") > 0) & (F.col("n_chunks") == 0), F.lit("required_evidence_missing")), F.when((n_blocks > 0) & (n_blocks < F.least(F.lit(2), F.col("n_ok"))), F.lit("final_evidence_count_insufficient")),
        F.when(F.col("duplicate_content"), F.lit("candidate_structure_or_citation_not_safely_materialized")), F.when(F.col("clash"), F.lit("parent_child_metadata_conflict")),
    ))
    return j.select(query, reasons.alias("reasons"), (F.size(reasons) == 0).alias("complete"))


def shadow_summary(rows: DataFrame, query: str) -> DataFrame:
    """Per query: candidates by kind, eligible and rejected ones, and its blocks."""
    n = rows.groupBy(query).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("kind") == "document").alias("n_documents"), F.count_if(F.col("kind") == "chunk").alias("n_chunks"), F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_rejected"))
    m = materialize(rows, query).select(query, "n_document_blocks", "n_chunk_blocks", F.col("n_repeats").alias("n_repeats"))
    return n.join(m, query, "left").na.fill(0)


# --- queries -------------------------------------------------------------------------------------------------------

# What separates the clauses of a query, and words without content in them.
CLAUSE_ENDS = "[，,；;。.!?]|以及|并且|同时|但是|需要|希望"


def decompose(query: Column, stopwords: list[str]) -> Column:
    """Clauses of a query as joined tokens: those of three characters or more with a token that is no stopword, in order, once.

    A query without such a clause stands for itself."""
    cut = F.split(query, CLAUSE_ENDS)
    # folded in one piece, the clauses kept apart by a sign that no text has
    low = F.split(lowered(F.array_join(cut, "\x00")), "\x00")
    parts = F.arrays_zip(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))).alias("p"), low.alias("l"))
    stop = F.array(*map(F.lit, stopwords)).cast("array<string>")
    own = F.transform(F.filter(parts, lambda x: F.length(x["p"]) >= 3), lambda x: F.array_join(F.filter(plain_tokens(x["l"]), lambda t: ~F.array_contains(stop, t)), " "))
    kept = F.array_distinct(F.filter(own, lambda c: F.length(c) >= 3))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(query))


def augment(query: Column, parts: dict[str, str]) -> Column:
    """The query and each context list that is not empty, as `name a b`, between bars; parts: name -> array column."""
    said = [F.when(F.size(c) > 0, F.concat(F.lit(n + " "), F.array_join(F.transform(c, lambda x: x.cast("string")), " "))) for n, c in parts.items()]
    return F.concat_ws(" | ", F.nullif(F.trim(query), F.lit("")), *said)


def request_query(base: str, lines: dict[str, str]) -> Column:
    """The request's text and one `label: value` line for each field that is there; lists are joined by commas."""
    return F.trim(F.concat_ws("\n", F.nullif(F.col(base), F.lit("")), *[F.concat(F.lit(label), F.nullif(F.col(c), F.lit(""))) for label, c in lines.items()]))


# --- selections ----------------------------------------------------------------------------------------------------


def filter_and_backfill(rows: DataFrame, by: list[str], allowed: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the first k allowed rows of a deeper pool, ranked anew; the rows that are not allowed)."""
    flagged = rows.withColumn("_ok", F.coalesce(allowed, F.lit(False)))
    kept = flagged.where("_ok").withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where(F.col("new_rank") <= k)
    return kept.drop("_ok"), flagged.where("not _ok").drop("_ok")


def diverse_topk(rows: DataFrame, by: list[str], doc: str, chunk: str, order: list, per_document: int | None, k: int = 5) -> DataFrame:
    """by, the first k allowed rows in `order` with at most per_document of a document; and the counts up to the last pick.

    rows: by, rank, doc, chunk, allowed. Returns by, n_filtered, n_backfilled (picks of a rank beyond k), n_skipped, picks array<struct<place, doc, chunk>>."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = Window.partitionBy(*by, doc, "allowed").orderBy(*order)
    r = rows.withColumn("_at", F.row_number().over(w)).withColumn("_own", F.row_number().over(own))
    fits = F.col("allowed") & (F.lit(True) if per_document is None else F.col("_own") <= per_document)
    r = r.withColumn("_fits", fits).withColumn("_place", F.sum(fits.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # rows after the k-th pick are not looked at
    r = r.where((F.col("_place") < k) | ((F.col("_place") == k) & F.col("_fits")))
    picks = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(F.col("_place").alias("place"), F.col(doc).alias("doc"), F.col(chunk).alias("chunk")))))
    return r.groupBy(*by).agg(F.count_if(~F.col("allowed")).alias("n_filtered"), F.count_if(F.col("_fits") & (F.col("rank") > 5)).alias("n_backfilled"), F.count_if(F.col("allowed") & ~F.col("_fits")).alias("n_skipped"), picks.alias("picks"))


def evidence_items(rows: DataFrame, query: str, k: int = 5, excerpt: int = 220) -> DataFrame:
    """The first k rows with title, kind and an excerpt: of the chunk's content, or of the document's summary."""
    text = F.when(F.col("chunk").isNotNull(), F.col("content")).otherwise(F.col("summary"))
    return rows.where(F.col("rank") <= k).select(query, "rank", "title", F.when(F.col("chunk").isNotNull(), "chunk").otherwise("document").alias("kind"), "doc", "chunk", F.substring(text, 1, excerpt).alias("excerpt"))


def fallback_reasons(requests: DataFrame, minimum: int = 2) -> Column:
    """Ordered reasons to fall back, from n_evidence, n_ineligible, retrieval_error, selection_status, shadow_parent, shadow_eligible,
    shadow_error, company_id, context_present, readiness. A null shadow_eligible means that no shadow ran."""
    n, asked = F.col("n_evidence"), F.coalesce(F.col("company_id") != "", F.lit(False))
    named = {
        "retrieval_error": F.col("retrieval_error").isNotNull(), "no_evidence_found": (n == 0) & F.col("retrieval_error").isNull(), "all_evidence_filtered": (n > 0) & (F.col("n_ineligible") == n),
        "evidence_count_below_minimum": n < minimum, "boundary_status_blocked_or_unknown": ~F.coalesce(F.col("selection_status") == "eligible_method_selected", F.lit(False)),
        "shadow_detected_parent_child_gap": F.col("shadow_parent") & (n < F.col("shadow_eligible")), "shadow_pipeline_error": F.col("shadow_eligible").isNotNull() & F.coalesce(F.col("shadow_error") != "", F.lit(False)),
        "enterprise_context_missing": asked & ~F.col("context_present"), "enterprise_context_data_readiness_low": asked & F.col("context_present") & (F.lower(F.trim("readiness")) == "low"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in named.items()]))
