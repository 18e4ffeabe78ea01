"""URL filters by association rules.

Listed rules (host/path: allow or block) fit their host, all its subdomains and every path that begins with theirs; the
longest wins. What no listed rule decides is judged by association rules: urls that have a label are sets of tokens
(kinds of host labels, neighbours in the host, path segments with digits as one sign), FP-growth finds token
combinations with enough support, and rules "tokens -> label" with enough confidence are kept unless a rule of fewer of
their tokens is as sure. A url is matched through an inverted index from each rule's rarest token; the surest rule wins,
then the better supported, the longer, and the first by its tokens. Without a match the default stands.

DataFrame functions and Spark ML's FP-growth only. Host: after the first :// up to /, ?, # or the end, A-Z lower-cased;
path: then up to ? or #. A null url, or one without ://, has an empty host and path, no rule and the default verdict.
Repeated rows each give a row. Without labelled urls there are no association rules. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import split_join
from .components import _spread

SUPPORT, CONFIDENCE, DEFAULT = 0.005, 0.8, "allow"
#: Rules that are sent to all tasks; each of them has its support, so they are few.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """All columns of urls, host and path."""
    rest = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return urls.select("*", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def listed(rules: list[tuple[str, str]], want: str) -> Column:
    """The rule (want: rule) or verdict (want: verdict) of the longest listed rule that fits host and path; null if none does.

    rules: (host/path, verdict). The list is part of the expression, so it should be of a configuration's length."""
    out = F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + path))
        out = F.when(fits, F.lit(rule if want == "rule" else verdict)).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens of host and path."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    words = F.filter(F.split("host", r"[.\-]"), lambda x: x != "")
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    last = F.element_at(labels, -1)
    return F.array_distinct(F.array_compact(F.concat(
        F.transform(words, lambda x: F.concat(F.lit("w:"), x)),
        F.array(F.when(F.size(labels) > 0, F.concat(F.lit("top:"), last)), F.when(F.size(labels) > 1, F.concat(F.lit("site:"), F.element_at(labels, -2), F.lit("."), last))),
        F.transform(steps, lambda x, i: F.concat(F.lit("p:"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "9"))),
    )))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, support from (items, verdict)."""
    mark = F.concat(F.lit("=verdict:"), "verdict")
    baskets = labelled.where("verdict is not null").select(F.concat("items", F.array(mark)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    said = F.get("consequent", F.lit(0))
    found = model.associationRules.where(F.startswith(said, F.lit("=verdict:")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("=verdict:"))))
    return found.select(F.array_sort("antecedent").alias("tokens"), F.substr(said, F.lit(len("=verdict:") + 1)).alias("verdict"), "confidence", "support")


def _by_rarest(rules: DataFrame, often: DataFrame) -> DataFrame:
    """rules with t, the rarest of their tokens (often: t, n): an inverted index in which each rule stands once."""
    key = rules.select("tokens", "verdict", F.explode("tokens").alias("t")).join(often, "t").groupBy("tokens", "verdict").agg(F.min(F.struct("n", "t")).alias("least"))
    return rules.join(key, ["tokens", "verdict"]).withColumn("t", F.col("least.t")).drop("least")


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that only add tokens to one that is as sure of the same verdict (of any number of tokens fewer).

    A rule meets those that hold its rarest token; mined rules are few, as each needs its support."""
    each = rules.select("tokens", "verdict", F.col("confidence").alias("c"), F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n"))
    small = _by_rarest(rules.select("tokens", "verdict", "confidence"), often).select("t", "verdict", F.col("tokens").alias("fewer"), F.col("confidence").alias("d"))
    worse = each.join(small, ["t", "verdict"]).where((F.col("d") >= F.col("c")) & (F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0)).select("tokens", "verdict").distinct()
    return rules.join(worse, ["tokens", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """items (distinct) and the verdict, tokens and confidence of the best rule for them, of those that have one."""
    sets = urls.select(F.array_sort("items").alias("items")).distinct()
    each = sets.select("items", F.explode("items").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n"))
    index = _by_rarest(rules, often).select("t", F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.size("tokens")).alias("z"), "tokens", "verdict").alias("rule"))
    few = rules.count() <= BROADCAST_RULES
    met = each.join(F.broadcast(index), "t") if few else split_join(each, index, "t", ["items"], ["rule"])  # a token may be in every url
    hit = met.where(F.size(F.array_except("rule.tokens", "items")) == 0)
    return hit.groupBy("items").agg(F.min("rule").alias("best")).select("items", F.col("best.verdict").alias("mined"), F.col("best.tokens").alias("mined_tokens"), (-F.col("best.c")).alias("confidence"))


def judge(urls: DataFrame, rules: list[tuple[str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_tokens, confidence. Listed rules label the urls that are learned from."""
    from ..shared import durable

    p = parts(urls.select("page_id", "url")).drop("url").withColumn("items", F.array_sort(tokens()))
    p = p.withColumn("rule", listed(rules, "rule")).withColumn("own", listed(rules, "verdict"))
    # equal baskets are common; FP-growth reads them as rows, matching reads each once
    learned = durable(pruned(durable(mine(p.select("items", F.col("own").alias("verdict")), support, confidence), "mined")), "rules")
    best = match(p.where("own is null"), learned)
    got = _spread(p, durable(best, "best"), "items", "left")  # many urls have the same tokens, or none
    return got.select("page_id", "host", "path", "rule", F.coalesce("own", "mined", F.lit(default)).alias("verdict"), F.when(F.col("own").isNull(), F.col("mined_tokens")).alias("mined_tokens"), F.when(F.col("own").isNull(), F.col("confidence")).alias("confidence"))
