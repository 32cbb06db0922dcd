"""URL filters: fixed host and path rules, and association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens that go with the label; rules pruned by confidence and support, and by shorter rules
that are as sure, are matched through an inverted index: each rule stands under its rarest token, so common tokens lead nowhere.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from threatspark.llm.common import column, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=block"
SUPPORT = 0.0005
CONFIDENCE = 0.7
#: Labelled URLs that a rule must cover at least, whatever the share: fewer prove nothing.
LEAST = 20
#: Rules that fit into a broadcast; more of them are joined by shuffle.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host and path) that fits, and its verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equal length the one that blocks comes first.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Different tokens of a URL: scheme, host labels, top domain, path segments, extension, query keys, fragment.

    Digits are written as ``0``, so numbered pages share a token. A null URL has none.
    """
    host, path = host_of(url), path_of(url)
    plain = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), plain(x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    labels = F.split(host, r"\.")
    all_ = F.concat(
        named("scheme", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        named("host", labels),
        named("top", F.array(F.element_at(labels, -1))),
        named("path", F.split(path, "/")),
        named("type", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))),
        named("query", keys),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_sort(F.array_distinct(all_)), F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``(items, rarest, confidence, support)`` of token combinations that go with a true ``bad`` in ``labelled(url, bad)``.

    A combination that contains a kept one at least as sure is pruned. Rows with a null label are left out. Without labelled
    rows, or with none bad, there are no rules. How many rules there can be is bounded by the support, not by the rows.
    """
    baskets = labelled.where("bad IS NOT NULL").select(F.when(F.col("bad"), F.array_append(tokens(F.col("url")), F.lit(BAD))).otherwise(tokens(F.col("url"))).alias("items"))
    baskets = settle(baskets)
    support = min(1.0, max(support, LEAST / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BAD)
    alone = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    spread = found.select("antecedent", "confidence", "support", F.explode("antecedent").alias("token")).join(alone, "token")
    rules = spread.groupBy("antecedent").agg(F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    rules = settle(rules.select(F.array_sort("antecedent").alias("items"), "rarest", "confidence", "support"))
    # A rule is redundant if a shorter one inside it is as sure; that one's rarest token is among its own.
    short = rules.select(F.col("items").alias("s_items"), F.col("rarest").alias("token"), F.col("confidence").alias("s_confidence"))
    inside = (F.size("s_items") < F.size("items")) & (F.size(F.array_except("s_items", "items")) == 0) & (F.col("s_confidence") >= F.col("confidence"))
    redundant = rules.withColumn("token", F.explode("items")).join(short, "token").where(inside).select("items").distinct()
    return settle(rules.join(redundant, "items", "left_anti"))


def mined_verdicts(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``token_sets(tokens)`` that some rule fits, with the surest one: ``(tokens, mined)``."""
    n = rules.count()
    index = rules.select("rarest", "items", "confidence", "support")
    index = F.broadcast(index) if n <= BROADCAST_RULES else index
    met = token_sets.distinct().withColumn("rarest", F.explode("tokens")).join(index, "rarest").where(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", "support", F.array_join("items", " & ").alias("rule")))["rule"].alias("mined"))


def judge(pages: DataFrame, labelled: DataFrame, fixed: list[tuple[str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, mined and verdict; columns of these names are replaced.

    A fixed rule decides where one fits. Elsewhere a URL is blocked if a mined rule fits, and allowed otherwise; so are null and
    empty URLs, whose host and path are empty. Every row stays, repeated ones too.
    """
    pages = pages.drop("host", "path", "rule", "mined", "verdict")
    rules = mine(labelled, support, confidence)
    rows = pages.withColumns({"host": host_of(column(url_col)), "path": path_of(column(url_col)), "__tokens": tokens(column(url_col))})
    blocked = mined_verdicts(rows.select(F.col("__tokens").alias("tokens")), rules).withColumnRenamed("tokens", "__tokens")
    name, said = fixed_rule(F.col("host"), F.col("path"), fixed)
    out = rows.join(blocked, "__tokens", "left").withColumn("rule", name)
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(said, method)).drop("__tokens")
