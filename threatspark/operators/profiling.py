"""Statistics of flow tables. Every operator returns a table; wide passes are unpivoted once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatspark import schemas as S, skew
from threatspark.functions.numeric import is_infinite, is_missing, variation
from threatspark.operators.cleaning import is_floating, numeric_columns, q


def _wide(df: DataFrame, columns: Sequence[str], fields) -> DataFrame:
    """One aggregation pass over all columns, returned with a row per column."""
    items = [F.struct(F.lit(c).alias("column"), *fields(q(c).cast("double"))) for c in columns]
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("value")) for c in columns]
    return df.select(*[q(k) for k in keys], F.inline(F.array(*items)))


def label_distribution(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows and share (percent, four decimals) per label."""
    counts = df.groupBy(q(target).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select("label", "rows", F.round(F.col("rows") * 100 / total, 4).alias("pct"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles (linear) and max per column, in a few passes over the settled rows."""
    columns = list(columns or numeric_columns(df))
    rows = skew.settled(df.select(*[q(c) for c in columns]))
    base = _wide(
        rows,
        columns,
        lambda c: [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")],
    )
    named = _named_quantiles(rows, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(named, "column", "left").select("column", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def _named_quantiles(rows: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of all columns at once as named columns, a row for each group and column."""
    found = skew.wide_quantiles(rows, columns, sorted(set(probs.values())), by)
    return found.groupBy(*by, "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(name) for name, p in probs.items()])


def quantile_columns(
    long: DataFrame, keys: Sequence[str], probs: dict[str, float], *, group_rows: int | None = None
) -> DataFrame:
    """Exact quantiles of ``value`` per key as named columns."""
    rows = skew.exact_quantiles(long, keys, "value", sorted(set(probs.values())), group_rows=group_rows)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(name) for name, p in probs.items()]
    )


def skew_kurtosis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per column."""
    stats = _wide(
        df,
        list(columns or numeric_columns(df)),
        lambda c: [
            F.count(c).cast("double").alias("n"),
            F.skewness(c).alias("g1"),
            F.kurtosis(c).alias("g2"),
        ],
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    corrected_skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    corrected_kurt = F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return stats.select("column", corrected_skew.alias("skewness"), corrected_kurt.alias("kurtosis"))


def _correlated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, r`` for all ordered column pairs, in two passes over the settled rows.

    The first pass finds means, gaps and constant columns; the second adds up the products of centred values, one plain sum a
    pair. A pair uses the rows in which both have a number (gaps are null or NaN): only pairs of columns with gaps need their
    own moments. A constant column has no correlation, and neither has any pair of an empty table.
    """
    names = list(columns)
    value = [F.nanvl(q(c).cast("double"), F.lit(None).cast("double")) for c in names]
    rows = skew.settled(df.select(*[v.alias(f"x{i}") for i, v in enumerate(value)]))
    at = range(len(names))
    parts = [f(f"x{i}").alias(f"{name}{i}") for i in at for name, f in (("n", F.count), ("m", F.avg), ("a", F.min), ("b", F.max))]
    first = rows.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    whole = [first[f"n{i}"] == first["n"] for i in at]
    constant = [first[f"a{i}"] == first[f"b{i}"] for i in at]
    centred = [F.col(f"x{i}") - F.lit(first[f"m{i}"]) for i in at]
    wanted = {}
    for i in at:
        for j in at[i:]:
            if first[f"n{i}"] and first[f"n{j}"] and not constant[i] and not constant[j]:
                plain = whole[i] and whole[j] or i == j
                wanted[i, j] = F.sum(centred[i] * centred[j]) if plain else F.corr(f"x{i}", f"x{j}")
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[r.alias(f"r{i}_{j}") for (i, j), r in wanted.items()]).first()  # one number a pair
    cells = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r, k = None, (min(i, j), max(i, j))
            if k in wanted and got[f"r{k[0]}_{k[1]}"] is not None:
                r = got[f"r{k[0]}_{k[1]}"]
                if i == j:
                    r = 1.0
                elif whole[i] and whole[j]:
                    r = r / (math.sqrt(got[f"r{i}_{i}"]) * math.sqrt(got[f"r{j}_{j}"]))
                r = None if math.isnan(r) else r
            cells.append((a, b, r))
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, r double")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair (first before second); null for constant columns."""
    columns = list(columns or numeric_columns(df))
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    cells = _correlated(df, columns)
    return cells.where(F.element_at(place, F.col("feature_a")) < F.element_at(place, F.col("feature_b")))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix, one row per feature."""
    columns = list(columns or numeric_columns(df))
    cells = _correlated(df, columns)
    return cells.groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", columns).agg(F.max("r"))


def correlated_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """Pairs with |r| at or above the threshold; the second of a pair is the redundant one."""
    pairs = correlations(df, columns)
    return pairs.where(F.abs("r") >= threshold)


def spread_audit(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    min_cv_squared: float = 0.01,
    max_zero_share: float = 0.5,
) -> DataFrame:
    """Variance, variance over squared mean, share of zeros, and the two flags."""
    stats = _wide(
        df,
        list(columns or numeric_columns(df)),
        lambda c: [
            F.var_samp(c).alias("variance"),
            F.avg(c).alias("mean"),
            F.count_if(c == 0).alias("zeros"),
            F.count(F.lit(1)).alias("n"),
        ],
    )
    squared = F.col("variance") / F.nullif(F.col("mean") * F.col("mean"), F.lit(0.0))
    share = F.col("zeros") * 100.0 / F.col("n")
    return stats.select(
        "column",
        "variance",
        "mean",
        squared.alias("cv_squared"),
        share.alias("zero_pct"),
        F.coalesce(squared < min_cv_squared, F.lit(False)).alias("near_constant"),
        (share > max_zero_share * 100).alias("sparse"),
    )


def drop_advice(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """Columns to consider dropping, with the reason."""
    columns = list(columns or numeric_columns(df))
    redundant = correlated_pairs(df, columns, threshold).select(F.col("feature_b").alias("column")).distinct()
    audit = spread_audit(df, columns)
    return (
        redundant.withColumn("reason", F.lit("redundant"))
        .unionByName(audit.where("near_constant").select("column", F.lit("near_constant").alias("reason")))
        .unionByName(audit.where("sparse").select("column", F.lit("sparse").alias("reason")))
    )


def class_statistics(df: DataFrame, columns: Sequence[str], target: str = S.TARGET) -> DataFrame:
    """Mean, std, min, median and max of every feature per class."""
    rows = skew.settled(df.select(q(target).alias("label"), *[q(c) for c in columns]))
    items = [
        F.struct(F.lit(c).alias("column"), *[f(q(c).cast("double")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
        for c in columns
    ]
    base = rows.groupBy("label").agg(F.array(*items).alias("_a")).select("label", F.inline("_a"))
    medians = _named_quantiles(rows, columns, {"median": 0.5}, ["label"])
    same = base["label"].eqNullSafe(medians["label"]) & (base["column"] == medians["column"])
    return base.join(medians, same, "left").select(base["label"], base["column"], "mean", "std", "min", "median", "max")


def outliers(df: DataFrame, columns: Sequence[str], fence: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences per column; none where the quartiles coincide."""
    df = skew.settled(df.select(*[q(c) for c in columns]))
    quartiles = _named_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    fences = quartiles.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "q3")))).alias("f")
    )  # one entry per column
    marked = df.select(*[q(c) for c in columns], fences.scalar().alias("_f"))

    def counted(c: str) -> Column:
        limits = F.element_at(F.col("_f"), F.lit(c))
        width = limits["q3"] - limits["q1"]
        outside = (q(c) < limits["q1"] - width * fence) | (q(c) > limits["q3"] + width * fence)
        return F.struct(
            F.lit(c).alias("column"),
            F.count_if((width != 0) & outside).alias("outliers"),
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(width == 0, "IQR=0").otherwise("")).alias("note"),
        )

    found = marked.agg(F.array(*[counted(c) for c in columns]).alias("_a")).select(F.inline("_a"))
    return found.select("column", "outliers", F.round(F.col("outliers") * 100 / F.col("n"), 3).alias("pct"), "note")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in columns]))
    )
    return long.groupBy("column").agg(F.count_distinct("value").alias("distinct_values"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values, ties in value order."""
    counts = df.groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(n)


def port_ranges(df: DataFrame, column: str) -> DataFrame:
    bucket = F.when(q(column) < 1024, "well_known").when(q(column) < 49152, "registered").otherwise("ephemeral")
    return df.where(q(column).isNotNull()).groupBy(bucket.alias("port_range")).agg(F.count(F.lit(1)).alias("rows"))


def time_span(df: DataFrame, column: str) -> DataFrame:
    """First and last instant and their distance in microseconds."""
    t = F.unix_micros(column)
    return df.agg(F.min(t).alias("first_us"), F.max(t).alias("last_us")).withColumn(
        "span_us", F.col("last_us") - F.col("first_us")
    )


def class_presence(
    df: DataFrame, expected: Sequence[str], target: str = S.TARGET, min_share: float = 0.01
) -> DataFrame:
    """Expected classes with their share, flagged if absent or rarer than ``min_share``."""
    spark = df.sparkSession
    names = spark.createDataFrame([(e,) for e in expected], "label string")
    counts = df.groupBy(q(target).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    joined = names.join(counts, "label", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    share = F.col("rows") / total
    return joined.select(
        "label",
        "rows",
        F.when(F.col("rows") == 0, "absent").when(share < min_share, "under-represented").otherwise("ok").alias("flag"),
    )


def quality_overview(df: DataFrame) -> DataFrame:
    """Missing and infinite cells per column in one pass."""
    floats = {c: is_floating(df, c) for c in df.columns}
    items = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(is_missing(q(c), floats[c])).alias("missing"),
            F.count_if(is_infinite(q(c)) if floats[c] else F.lit(False)).alias("infinite"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def with_variation(df: DataFrame, mean: str, std: str, name: str = "iat_cv", sentinel: float = -1.0) -> DataFrame:
    return df.withColumn(name, variation(q(mean), q(std), sentinel))


def latency_report(df: DataFrame, keys: Sequence[str], micros: str, *, group_rows: int | None = None) -> DataFrame:
    """Latency percentiles and rows per second per key, over a duration column in microseconds."""
    value = df.select(*[q(k) for k in keys], q(micros).cast("double").alias("value"))
    base = value.groupBy(*keys).agg(
        F.count("value").alias("rows"), (F.count("value") * 1e6 / F.sum("value")).alias("rows_per_second")
    )
    marks = quantile_columns(value, keys, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, group_rows=group_rows)
    return base.join(marks, list(keys), "left")


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Row counts per key and their percentage within part of the key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*within))
    return counts.withColumn("pct", F.round(F.col("rows") * 100 / total, 4))
