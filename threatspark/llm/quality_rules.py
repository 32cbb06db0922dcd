"""Quality rules as a learned decision list over text statistics.

Sequential covering: a rule that rejects documents is grown condition by condition on two thirds of a labelled sample by
information gain, pruned back on the rest, and kept if it is precise there; the documents it covers leave the sample, and the
next rule is grown. The list is an ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatspark.llm.common import GAP, WORD, column, settle

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Labelled documents that the list is fitted on, at most: those with the smallest hash of the id.
SAMPLE = 20_000
CUTS = 12
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Of the documents that a rule covers in the part kept for pruning, so many must be labelled bad.
PRECISION = 0.95
SUPPORT = 0.002


def _removed(text: Column, chars: str) -> Column:
    """Characters of a text that are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``stats``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_lines.

    Everything is counted over the whole text; a null text has zeros. ``n_repeat_words`` counts the words that lie in a run of three
    words which occurs twice or more in the text, overlapping or not: runs are hashed to 64 bits and sorted, so equal ones
    meet. Work grows as the text's length times its logarithm. A column named ``stats`` is replaced.
    """
    names = [column(c) for c in docs.columns if c != "stats"]
    text = F.coalesce(column(text_col), F.lit(""))
    first = docs.select(*names, text.alias("__text"))
    split = first.select(
        *names,
        "__text",
        F.filter(F.split("__text", GAP), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD)).alias("__lines"),
    )
    places = F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.get("__words", i)
    hashed = split.withColumn("__runs", F.transform(places, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    sorted_runs = F.when(F.size(F.array_distinct("__runs")) == F.size("__runs"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    ordered = hashed.withColumn("__sorted", sorted_runs)
    twice = F.filter("__sorted", lambda x, k: (x["h"] == F.get("__sorted", k + 1)["h"]) | (x["h"] == F.get("__sorted", k - 1)["h"]))
    found = ordered.withColumn("__twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Each such run covers three words, less those that the next one covers as well.
    covered = F.aggregate(
        F.transform("__twice", lambda p, k: F.least(F.coalesce(F.get("__twice", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda total, x: total + x
    )
    stats = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        (F.length("__text") - _removed(F.col("__text"), BLANKS)).cast("long").alias("word_chars"),
        _removed(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _removed(F.col("__text"), CAPITALS).cast("long").alias("n_capitals"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    # As the output of a generator the struct is computed once: no later filter or field access is planned below it.
    return found.select(*names, F.explode_outer(F.array(stats)).alias("stats"))


def base_failed() -> Column:
    return (F.col("stats.n_words") < 50) | (100 * F.col("stats.n_repeat_words") > 50 * F.col("stats.n_words"))


def features() -> dict[str, Column]:
    """What conditions look at: ratios that do not depend on a text's length, but for the number of words."""
    words, chars = F.greatest(F.col("stats.n_words"), F.lit(1)), F.greatest(F.col("stats.word_chars"), F.lit(1))
    lines = F.greatest(F.col("stats.n_lines"), F.lit(1))
    return {
        "n_words": F.col("stats.n_words").cast("double"),
        "chars_a_word": F.col("stats.word_chars") / words,
        "symbols_a_char": F.col("stats.n_symbols") / chars,
        "dup_lines_a_line": F.col("stats.n_dup_lines") / lines,
        "repeat_words_a_word": F.col("stats.n_repeat_words") / words,
        "capitals_a_char": F.col("stats.n_capitals") / chars,
        "words_a_line": F.col("stats.n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def labelled_sample(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(id, bad)`` of at most ``sample`` labelled ids. Null labels are left out; an id with any label 0 is bad."""
    known = labels.where(column(label_col).isNotNull() & column(id_col).isNotNull()).groupBy(column(id_col).alias("__id")).agg((F.min(column(label_col)) == 0).alias("__bad"))
    return known.orderBy(F.xxhash64("__id"), "__id").limit(sample)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules that reject, in order. Without bad labels, or if no rule is precise enough, the list is empty and nothing is rejected.

    The labelled sample has a fixed bound, so it is broadcast to the documents, and only its documents' statistics are taken.
    """
    chosen = labelled_sample(labels, sample, id_col, label_col)
    held = docs.select(column(id_col).alias("__id"), column(text_col).alias("__t")).join(F.broadcast(chosen), "__id")
    stats = with_statistics(held, "__t").where(~base_failed())
    rows = settle(stats.select(F.col("__bad").alias("bad"), (F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)) == 0).alias("held_out"), "stats"))
    conditions = _conditions(rows.where("NOT held_out"))
    if not conditions:
        return []
    hits = F.array(*(c.column() for c in conditions))
    cover = settle(rows.select("bad", "held_out", hits.alias("hits")).groupBy("bad", "held_out", "hits").agg(F.count(F.lit(1)).alias("n")))
    least = max(2.0, SUPPORT * (cover.agg(F.sum("n")).first()[0] or 0))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grown = _grow(cover, least)
        pruned = _prune(cover, grown)
        if not pruned:
            break
        covered = _all(pruned)
        bad, good = _counts(cover.where("held_out").where(covered))
        if bad < max(1.0, least / 4) or bad < precision * (bad + good):
            break
        rules.append(tuple(conditions[i] for i in pruned))
        cover = settle(cover.where(~covered))
    return rules


def _conditions(rows: DataFrame) -> list[Condition]:
    """Cuts halfway between quantiles of each feature; both classes have theirs, so that rare tails have cuts as well."""
    names, columns = zip(*features().items())
    shares = F.array(*(F.lit((k + 0.5) / CUTS) for k in range(CUTS)))
    taken = rows.groupBy("bad").agg(*(F.percentile_approx(c, shares, F.lit(10_000)).alias(n) for n, c in zip(names, columns))).collect()
    if {r["bad"] for r in taken} != {True, False}:
        return []
    out = []
    for n in names:
        values = sorted({v for r in taken for v in r[n]})
        out += [Condition(n, above, (a + b) / 2) for a, b in zip(values, values[1:]) for above in (True, False)]
    return out


def _all(rule: list[int]) -> Column:
    out = F.lit(True)
    for i in rule:
        out = out & F.get("hits", F.lit(i))
    return out


def _counts(cover: DataFrame) -> tuple[float, float]:
    row = cover.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))).first()
    return float(row[0] or 0), float(row[1] or 0)


def _grow(cover: DataFrame, least: float) -> list[int]:
    rule: list[int] = []
    here = cover.where("NOT held_out")
    bad, good = _counts(here)
    while bad and good and len(rule) < MAX_CONDITIONS:
        table = here.where(_all(rule)).select("bad", "n", F.posexplode("hits").alias("at", "hit")).where("hit").groupBy("at").agg(
            F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")
        )
        now = math.log2(bad / (bad + good))
        scored = [(r["b"] * (math.log2(r["b"] / (r["b"] + r["g"])) - now), -r["at"], r) for r in table.collect() if r["b"] >= least]
        if not scored or max(scored, key=lambda x: x[:2])[0] <= 1e-9:
            break
        best = max(scored, key=lambda x: x[:2])[2]
        rule.append(best["at"])
        bad, good = float(best["b"]), float(best["g"])
    return rule


def _prune(cover: DataFrame, rule: list[int]) -> list[int]:
    """The beginning of the rule that is best on the part kept for pruning; the shorter one of equals."""
    best: tuple[float, list[int]] = (-2.0, [])
    for length in range(1, len(rule) + 1):
        bad, good = _counts(cover.where("held_out").where(_all(rule[:length])))
        value = (bad - good) / (bad + good) if bad + good else -1.0
        if value > best[0] + 1e-12:
            best = (value, rule[:length])
    return best[1]


def verdict(rules: list[Rule]) -> Column:
    """True where the list keeps a row with ``stats``: the first rule that fits rejects, the rest is kept."""
    out = None
    for rule in rules:
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        out = F.when(fits, False) if out is None else out.when(fits, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``; columns of these names are replaced."""
    rated = with_statistics(docs.drop("base_failed", "kept"), text_col)
    return rated.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that neither the base limits nor the learned list reject, with their own columns."""
    kept = judged(docs.withColumn("__own", F.struct(*map(column, docs.columns))), learn(docs, labels, text_col=text_col, **options), text_col).where("kept")
    return kept.select(*(F.col("__own")[c].alias(c) for c in docs.columns))
