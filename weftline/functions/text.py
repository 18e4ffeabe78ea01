"""Text functions: normalisation, retrieval tokens, match tokens, chunk ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CJK = "一-鿿"
_TOKEN = f"[a-z0-9]+(?:[-_][a-z0-9]+)*|[{_CJK}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Characters that NFKC and case folding treat as lower-casing does (ß, narrow dots and odd spaces aside, which are replaced below).
_PLAIN = r"\x00-\x7f\x85\u00a0-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201f\u2022\u2026\u4e00-\u9fff\u3001\u3002"


def lowered(c: Column) -> Column:
    """NFKC with full case folding: built-in functions where they suffice, Python only for texts with characters beyond them."""
    beyond = F.regexp_replace(c, r"[\x00-\x7f]++", "").rlike(f"[^{_PLAIN}]")  # the long class is slow, and asked of what is left
    plain = F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("…"), F.lit("..."))
    return F.coalesce(_nfkc(F.when(beyond, c)), plain)


def _nfkc(c: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s):
        import unicodedata

        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return run(c)


def normalize(c) -> Column:
    """NFKC and case-folded, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(lowered(_col(c)), r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def _bigrams(run: Column) -> Column:
    n = F.length(run)
    return F.when(~run.rlike(f"^[{_CJK}]+$") | (n == 1), F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def plain_tokens(low: Column) -> Column:
    """tokens of a text that is folded already."""
    found = F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))
    return F.when(low.rlike(f"[{_CJK}]"), F.flatten(F.transform(found, _bigrams))).otherwise(found)


def tokens(c) -> Column:
    """Retrieval tokens in order, repeats kept; a CJK run of two or more becomes its overlapping bigrams."""
    return plain_tokens(lowered(_col(c)))


def match_tokens(c, stopwords: list[str]) -> Column:
    """Tokens for matching: letters and digits of two or more, CJK runs of 2-6 and all bigrams; no stopwords, first-seen order."""
    runs = F.regexp_extract_all(normalize(c), F.lit(f"[a-z0-9]+|[{_CJK}]+"), F.lit(0))
    each = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_CJK}]"), F.concat(F.when(F.length(r).between(2, 6), F.array(r)).otherwise(F.array().cast("array<string>")), _bigrams(r))).otherwise(F.when(F.length(r) >= 2, F.array(r)).otherwise(F.array().cast("array<string>")))))
    return F.array_except(F.array_distinct(each), F.array(*map(F.lit, stopwords)).cast("array<string>"))


def chunk_id(doc: Column, index: Column, content: Column) -> Column:
    """doc#chunk-NNN-hash; the number is padded, never cut."""
    digest = F.substring(F.sha1(F.concat_ws(":", doc.cast("string"), index.cast("string"), content)), 1, 12)
    return F.concat(doc.cast("string"), F.format_string("#chunk-%03d-", index.cast("int")), digest)


def token_estimate(content: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(content) / 4)).cast("int")
