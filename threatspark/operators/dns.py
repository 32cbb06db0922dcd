"""Generated-domain and DNS-tunnelling detection."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatspark import schemas as S, skew
from threatspark.functions.text import (
    clean_domain,
    first_label,
    longest_subdomain_label,
    ngrams,
    shannon_entropy,
    suffixes,
)
from threatspark.operators.tls import mark_listed

UNSEEN = "__UNSEEN__"


def ngram_model(benign: DataFrame, n: int = S.NGRAM_SIZE, *, check: bool = True) -> DataFrame:
    """Add-one smoothed log-probability per n-gram of the first labels: ``gram``, ``logp``.

    The row with gram ``__UNSEEN__`` holds the value of every gram that was not seen.
    """
    grams = benign.select(F.explode(ngrams(first_label(F.col("domain")), n)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    if check and counts.isEmpty():
        raise ValueError("no n-grams: check the benign domain list")
    size = counts.agg((F.sum("c") + F.count(F.lit(1))).alias("size"))
    seen = counts.select("gram", F.log((F.col("c") + 1) / size.scalar()).alias("logp"))
    unseen = size.where(F.col("size").isNotNull()).select(
        F.lit(UNSEEN).alias("gram"), F.log(F.lit(1.0) / F.col("size")).alias("logp")
    )
    return seen.unionByName(unseen)


#: Characters of host names; a piece of them has a code, and the model a table by code.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-_"
#: Longest pieces that get a table by code (38^3 numbers), and most other pieces that a row looks through.
CODED_SIZE, FEW_PIECES = 3, 200


def _code(characters: list[Column]) -> Column:
    """Place of a piece in the table; null if a character is not of the alphabet."""
    found = F.lit(0)
    for c in characters:
        at = F.nullif(F.call_function("instr", F.lit(ALPHABET), c), F.lit(0)) - 1
        found = found * len(ALPHABET) + at
    return found


def with_ngram_score(
    domains: DataFrame, model: DataFrame, n: int = S.NGRAM_SIZE, *, only: Column | None = None
) -> DataFrame:
    """Add ``ngram_score``, the mean log-probability of the n-grams of the first label.

    ``domains`` must hold each domain once. Rows outside ``only`` are not scored. The model is settled once. Pieces of host-name
    characters are looked up in a table of at most 38^3 numbers, by code and inside the row: nothing is exploded or shuffled.
    Longer pieces, and models with many pieces of other characters, are joined.
    """
    model = skew.settled(model)
    wanted = F.lit(True) if only is None else only
    coded = _code([F.substring("gram", k + 1, 1) for k in range(n)])
    rest = model.where(F.col("gram") != UNSEEN).where(coded.isNull() | (F.length("gram") != n))
    if n > CODED_SIZE or rest.count() > FEW_PIECES:
        return _joined_score(domains, model, n, wanted)
    # At most 38^3 pieces have a code, and few others are left: the driver holds these numbers as constants of the plan.
    known = model.where((F.col("gram") == UNSEEN) | coded.isNotNull()).select("gram", coded.alias("code"), "logp").collect()
    base = next((r["logp"] for r in known if r["gram"] == UNSEEN), None)
    dense = [base] * len(ALPHABET) ** n
    for r in known:
        if r["gram"] != UNSEEN:
            dense[r["code"]] = r["logp"]
    unseen = F.lit(base).cast("double")
    table = F.from_json(F.lit(json.dumps(dense)), "array<double>")
    others = F.from_json(F.lit(json.dumps({r["gram"]: r["logp"] for r in rest.collect()})), "map<string,double>")

    def value(gram: Column) -> Column:
        code = _code([F.substring(gram, k + 1, 1) for k in range(n)])
        return F.coalesce(F.when(code.isNotNull(), F.get(table, code)).otherwise(F.element_at(others, gram)), unseen)

    grams = ngrams(first_label(F.col("domain")), n)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + value(g))
    score = F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(unseen)
    return domains.withColumn("ngram_score", F.when(wanted, score))


def _joined_score(domains: DataFrame, model: DataFrame, n: int, wanted: Column) -> DataFrame:
    """The same by a join on exploded pieces, which stay with their domain in the grouping."""
    unseen = model.where(F.col("gram") == UNSEEN).agg(F.max("logp")).scalar()
    grams = F.when(wanted, ngrams(first_label(F.col("domain")), n))
    rows = domains.select("*", wanted.alias("_wanted"), F.explode_outer(grams).alias("gram"))
    scored = rows.join(model.where(F.col("gram") != UNSEEN), "gram", "left")
    out = scored.groupBy(*domains.columns, "_wanted").agg(F.avg(F.coalesce("logp", unseen)).alias("_score"))
    return out.select(*domains.columns, F.when(F.col("_wanted"), F.col("_score")).alias("ngram_score"))


def score_domains(domains: DataFrame, model: DataFrame, n: int = S.NGRAM_SIZE) -> DataFrame:
    """Distinct domains with ``entropy`` and ``ngram_score`` (not rounded)."""
    scored = with_ngram_score(domains.select("domain").distinct(), model, n)
    return scored.select("domain", shannon_entropy(F.col("domain")).alias("entropy"), "ngram_score")


def allowlist(ranked: DataFrame, size: int = S.ALLOWLIST_SIZE) -> DataFrame:
    """The best-ranked domains, by position in the cleaned list."""
    return ranked.where(F.col("position") <= size)


def mark_allowed(domains: DataFrame, allowed: DataFrame, flag: str = "allowed") -> DataFrame:
    """Flag domains that are, or lie under, an allowed domain. ``domains`` must be distinct."""
    parents = domains.select("*", F.explode(suffixes(F.col("domain"))).alias("_suffix"))
    names = allowed.select(F.col("domain").alias("_suffix")).distinct().withColumn("_hit", F.lit(True))
    marked = parents.join(names, "_suffix", "left").groupBy(*domains.columns)
    return marked.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias(flag))


def classify_domains(
    domains: DataFrame,
    blocklist: DataFrame,
    model: DataFrame,
    entropy_threshold: float | Column,
    ngram_threshold: float | Column,
    allowed: DataFrame | None = None,
    n: int = S.NGRAM_SIZE,
) -> DataFrame:
    """Verdict per distinct cleaned domain.

    Order: invalid, blocklist, allowlist, then entropy and n-gram score. Only names that the first
    three leave open are scored.
    """
    names = domains.select(clean_domain(F.col("domain")).alias("domain")).distinct()
    rows = mark_listed(names, "domain", blocklist, "domain", "listed")
    if allowed is not None:
        rows = mark_allowed(rows, allowed)
    else:
        rows = rows.withColumn("allowed", F.lit(False))
    invalid = ~F.contains("domain", F.lit("."))
    decided = F.when(invalid, "invalid_domain").when(F.col("listed"), "blocklist_match").when(
        F.col("allowed"), "allowlisted"
    )
    rows = rows.withColumn("_decided", decided)
    rows = rows.select("domain", "_decided")
    rows = with_ngram_score(rows, model, n, only=F.col("_decided").isNull())
    rows = rows.withColumn("entropy", F.when(F.col("_decided").isNull(), shannon_entropy(F.col("domain"))))
    high = F.col("entropy") >= _lit(entropy_threshold)
    odd = F.col("ngram_score") <= _lit(ngram_threshold)
    scored = F.when(high & odd, "entropy+ngram").when(high | odd, "entropy_or_ngram")
    reason = F.coalesce("_decided", scored)
    confidence = (
        F.when(F.col("reason") == "blocklist_match", 1.0)
        .when(F.col("reason") == "entropy+ngram", 0.9)
        .when(F.col("reason") == "entropy_or_ngram", 0.6)
        .otherwise(0.0)
    )
    return rows.withColumn("reason", reason).select(
        "domain",
        (confidence > 0).alias("flagged"),
        "reason",
        F.round("entropy", 3).alias("entropy"),
        F.round("ngram_score", 3).alias("ngram_score"),
        confidence.alias("confidence"),
    )


def _lit(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def query_rates(
    queries: DataFrame,
    *,
    seq: str,
    window_seconds: float = S.DNS_WINDOW_SECONDS,
    closed: str = "both",
    peers: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Queries of the source in the trailing window of each query (``recent_queries``).

    ``closed='both'`` keeps the left edge, ``closed='right'`` drops it.
    """
    rows = queries.withColumn("_t", F.unix_micros("timestamp"))
    out = skew.trailing_sums(
        rows,
        ["src_ip"],
        "_t",
        [seq],
        int(round(window_seconds * 1_000_000)),
        {"recent_queries": F.lit(1).cast("long")},
        left_closed=closed == "both",
        peers=peers,
        chunk_rows=chunk_rows,
    )
    return out.drop("_t")


def detect_tunneling(
    queries: DataFrame,
    *,
    seq: str,
    window_seconds: float = S.DNS_WINDOW_SECONDS,
    rate_limit: int = S.DNS_RATE_LIMIT,
    label_limit: int = S.DNS_LABEL_LIMIT,
    closed: str = "both",
    peers: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Flag high query rates and overlong sub-domain labels. Rows without a time are dropped."""
    timed = queries.where(F.col("timestamp").isNotNull())
    rated = query_rates(
        timed, seq=seq, window_seconds=window_seconds, closed=closed, peers=peers, chunk_rows=chunk_rows
    )
    return rated.withColumns(
        {
            "high_query_rate": F.col("recent_queries") >= rate_limit,
            "long_subdomain": longest_subdomain_label(clean_domain(F.col("domain"))) >= label_limit,
        }
    )


def classify_queries(queries: DataFrame, verdicts: DataFrame, *, seq: str, **tunneling) -> DataFrame:
    """Verdict per query: domain verdict combined with the tunnelling checks.

    ``verdicts`` comes from ``classify_domains`` (one row per distinct name).
    """
    rows = detect_tunneling(queries, seq=seq, **tunneling).withColumn("_name", clean_domain(F.col("domain")))
    known = verdicts.select(
        F.col("domain").alias("_name"),
        F.col("flagged").alias("_dga"),
        F.col("reason").alias("_reason"),
        F.col("confidence").alias("_confidence"),
        F.col("entropy").alias("_entropy"),
        F.col("ngram_score").alias("_ngram"),
    )
    rows = rows.join(known, "_name", "left")
    dga = F.coalesce("_dga", F.lit(False))
    rate, long = F.col("high_query_rate"), F.col("long_subdomain")
    tunnel_reason = (
        F.when(rate & long, "high_query_rate+long_subdomain").when(rate, "high_query_rate").when(long, "long_subdomain")
    )
    tunnel_confidence = F.when(rate & long, 0.95).when(rate, 0.8).when(long, 0.7)
    found = F.concat_ws("+", F.when(dga, F.col("_reason")), tunnel_reason)
    flag = F.when(dga, "DGA").when(rate | long, "DNS_TUNNELING")
    return rows.withColumns(
        {
            "flagged": dga | rate | long,
            "reason": F.when(found != "", found).otherwise(F.coalesce("_reason", F.lit("clean"))),
            "confidence": F.coalesce(
                F.greatest(F.when(dga, F.col("_confidence")), tunnel_confidence), F.lit(0.0)
            ),
            "entropy_score": F.coalesce("_entropy", F.lit(0.0)),
            "ngram_score": F.coalesce("_ngram", F.lit(0.0)),
            "dns_flag": flag,
        }
    ).drop("_name", "_dga", "_reason", "_confidence", "_entropy", "_ngram", "recent_queries")


def calibrate_thresholds(
    scores: DataFrame, measures: dict[str, tuple[bool, float]], *, chunk_rows: int | None = None
) -> DataFrame:
    """One row ``(measure, threshold, accuracy)`` per measure: the observed score that separates best.

    ``scores`` has ``measure``, ``score`` and ``malicious``; ``measures`` tells for each measure whether high
    scores are malicious and how much a benign row weighs. Rows of equal score are counted first; the
    sweep is a running sum over distinct scores, cut into score ranges if there are very many.
    """
    bad = F.col("malicious").cast("long")
    freq = scores.groupBy("measure", "score").agg(F.sum(bad).alias("bad"), F.sum(1 - bad).alias("good"))
    ch = skew.chunked(freq, ["measure"], ["score"], chunk_rows=chunk_rows, settle=True)
    swept = skew.with_running(ch, sums={"bad_upto": F.col("bad"), "good_upto": F.col("good")}).done()
    if ch.hot:
        totals = ch.df.groupBy("measure").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
        swept = swept.join(F.broadcast(totals), "measure")  # one row per measure
    else:
        whole = Window.partitionBy("measure")
        swept = swept.withColumns({"all_bad": F.sum("bad").over(whole), "all_good": F.sum("good").over(whole)})
    higher, weight = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    for name, (is_higher, benign_weight) in measures.items():
        higher = F.when(F.col("measure") == name, F.lit(is_higher)).otherwise(higher)
        weight = F.when(F.col("measure") == name, F.lit(float(benign_weight))).otherwise(weight)
    hits = F.when(higher, F.col("all_bad") - F.col("bad_upto") + F.col("bad")).otherwise(F.col("bad_upto"))
    passes = F.when(higher, F.col("good_upto") - F.col("good")).otherwise(F.col("all_good") - F.col("good_upto"))
    weighted = (hits + weight * passes) / (F.col("all_bad") + weight * F.col("all_good"))
    accuracy = (hits + passes) / (F.col("all_bad") + F.col("all_good"))
    best = swept.groupBy("measure").agg(
        F.max_by(F.struct(F.col("score").alias("threshold"), accuracy.alias("accuracy")), F.struct(weighted, -F.col("score"))).alias("b")
    )
    return best.select("measure", "b.threshold", "b.accuracy")


def calibrate_threshold(
    scores: DataFrame,
    *,
    higher_is_malicious: bool = True,
    benign_weight: float = 1.0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """One row ``(threshold, accuracy)`` for ``scores`` with ``score`` and ``malicious``."""
    rows = scores.select(F.lit("score").alias("measure"), "score", "malicious")
    picked = calibrate_thresholds(rows, {"score": (higher_is_malicious, benign_weight)}, chunk_rows=chunk_rows)
    return picked.drop("measure")


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation of a score per set."""
    return scores.groupBy("malicious").agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("domains")
    )


@dataclass(frozen=True)
class DnsCalibration:
    """What the DNS detector needs at run time; each table can be written and read as parquet."""

    blocklist: DataFrame
    allowed: DataFrame
    model: DataFrame
    thresholds: DataFrame  # measure, threshold, accuracy

    def save(self, path: str) -> None:
        for name in ("blocklist", "allowed", "model", "thresholds"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> "DnsCalibration":
        read = spark.read.parquet
        return DnsCalibration(*[read(f"{path}/{n}") for n in ("blocklist", "allowed", "model", "thresholds")])

    def threshold(self, measure: str) -> Column:
        return self.thresholds.where(F.col("measure") == measure).agg(F.max("threshold")).scalar()

    def classify(self, queries: DataFrame, *, seq: str, **tunneling) -> DataFrame:
        verdicts = classify_domains(
            queries, self.blocklist, self.model, self.threshold("entropy"), self.threshold("ngram"), self.allowed
        )
        return classify_queries(queries, verdicts, seq=seq, **tunneling)


def calibrate(
    malicious: DataFrame,
    ranked: DataFrame,
    *,
    allow_size: int = S.ALLOWLIST_SIZE,
    entropy_weight: float = S.ENTROPY_BENIGN_WEIGHT,
    n: int = S.NGRAM_SIZE,
    decimals: int | None = None,
) -> DnsCalibration:
    """Build the DNS detector's tables from the malicious and the ranked benign list."""
    model = skew.settled(ngram_model(ranked, n))
    both = malicious.select("domain", F.lit(True).alias("malicious")).unionByName(
        ranked.select("domain", F.lit(False).alias("malicious"))
    )
    scores = both.join(score_domains(both, model, n), "domain")

    def score(column: str) -> Column:
        return F.col(column) if decimals is None else F.round(column, decimals)

    long = scores.select(
        "malicious",
        F.inline(
            F.array(
                F.struct(F.lit("entropy").alias("measure"), score("entropy").alias("score")),
                F.struct(F.lit("ngram").alias("measure"), score("ngram_score").alias("score")),
            )
        ),
    )
    thresholds = calibrate_thresholds(long, {"entropy": (True, entropy_weight), "ngram": (False, 1.0)})
    return DnsCalibration(malicious, allowlist(ranked, allow_size), model, thresholds)
