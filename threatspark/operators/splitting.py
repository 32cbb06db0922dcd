"""Stratified splits and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatspark import schemas as S, skew

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def hash_bucket(row_id: str, seed: int = 42, buckets: int = 10_000) -> Column:
    """Bucket of a row id that any SQL engine can repeat (leading hex digits of an MD5)."""
    text = F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def _pick(position: Column, whole: Column | int, shares: dict[str, float]) -> Column:
    out, upto, names = F.lit(None).cast("string"), 1.0, list(shares)
    for name in reversed(names):
        out = F.when(position < F.lit(upto) * whole, name).otherwise(out)
        upto = round(upto - shares[name], 12)
    return out


def split_by_hash(df: DataFrame, row_id: str, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Add ``split`` from a hash of the row id. No shuffle; classes are balanced in expectation."""
    buckets = 10_000
    return df.withColumn("split", _pick(hash_bucket(row_id, seed, buckets), F.lit(buckets), shares))


def split_exact(
    df: DataFrame,
    row_id: str,
    target: str = S.TARGET,
    shares: dict[str, float] = SHARES,
    seed: int = 42,
    *,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``split`` with exact per-class shares: position of the row in its class's hash order. A null class is one too."""
    rows = df.withColumn("_h", hash_bucket(row_id, seed, 1 << 31))
    numbered = skew.row_numbers(rows, [target], ["_h", row_id], "_rn", chunk_rows=chunk_rows)
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    sizes = skew.counted_broadcast(sizes.withColumnRenamed(target, "_class"))  # one row per class
    joined = numbered.join(sizes, F.col(f"`{target}`").eqNullSafe(F.col("_class")), "left").drop("_class")
    return joined.withColumn("split", _pick(F.col("_rn") - 1, F.col("_n"), shares)).drop("_h", "_rn", "_n")


def split_balance(df: DataFrame, target: str = S.TARGET, names: tuple[str, ...] = tuple(SHARES)) -> DataFrame:
    """Rows and percentage of each class in each split."""
    counts = df.groupBy(F.col(f"`{target}`").alias("label")).pivot("split", list(names)).agg(F.count(F.lit(1)))
    counts = counts.na.fill(0, list(names))
    totals = counts.agg(F.struct(*[F.sum(n).alias(n) for n in names]).alias("t"))
    counts = counts.withColumn("_t", totals.scalar())
    return counts.select(
        "label",
        *[c for n in names for c in (
            F.col(n).alias(f"{n}_count"),
            F.round(F.col(n) * 100 / F.col("_t")[n], 4).alias(f"{n}_pct"),
        )],
    )


def class_weights(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(f"`{target}`").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k")).alias("t"))
    counts = counts.withColumn("_t", totals.scalar())
    return counts.select("label", "rows", (F.col("_t.n") / (F.col("_t.k") * F.col("rows"))).alias("weight"))


def with_class_weights(df: DataFrame, target: str = S.TARGET, name: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(F.col("label").alias(target), F.col("weight").alias(name))
    return df.join(skew.counted_broadcast(weights), target, "left")
