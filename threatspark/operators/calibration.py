"""Thresholds on anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threatspark import schemas as S
from threatspark.operators.profiling import quantile_columns

GRID_START, GRID_END, GRID_STEP = -0.4400, -0.5200, -0.0005
TARGET_RECALL = 0.90


def grid(start: float = GRID_START, end: float = GRID_END, step: float = GRID_STEP) -> list[float]:
    steps = int(round((end - start) / step))
    return [round(start + i * step, 4) for i in range(steps + 1)]


def scan_thresholds(
    scores: DataFrame,
    thresholds: list[float] | None = None,
    *,
    score: str = "score",
    label: str = "label",
    positive: str = S.BOTS_LABEL,
    negative: str = S.NORMAL_LABEL,
) -> DataFrame:
    """Recall of the positive and false-positive rate of the negative class per grid threshold.

    A row is flagged if its score is at or below the threshold. Rows are counted per grid cell (one
    shuffle of at most one row per cell), then summed up along the grid.
    """
    marks = sorted(thresholds if thresholds is not None else grid(), reverse=True)
    # Last threshold (descending) that still flags the row, by binary descent.
    arr = F.array(*[F.lit(float(t)) for t in marks])
    steps = [1 << b for b in reversed(range(max(1, len(marks).bit_length())))]
    cell = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(arr, pos + step - 1) >= F.col(score), pos + step).otherwise(pos),
    )
    counts = (
        scores.where(F.col(label).isin(positive, negative))
        .groupBy(cell.alias("cell"))
        .agg(
            F.count_if(F.col(label) == positive).alias("pos"),
            F.count_if(F.col(label) == negative).alias("neg"),
        )
    )
    spark = scores.sparkSession
    points = spark.createDataFrame([(i + 1, t) for i, t in enumerate(marks)], "cell int, threshold double")
    joined = points.unionByName(spark.createDataFrame([(0, None)], "cell int, threshold double")).join(
        counts, "cell", "left"
    )
    every = Window.partitionBy()
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # one row per grid point
    return (
        joined.select(
            "threshold",
            (F.sum("pos").over(down) / F.sum("pos").over(every)).alias("bots_recall"),
            (F.sum("neg").over(down) / F.sum("neg").over(every)).alias("normal_fpr"),
        )
        .where(F.col("threshold").isNotNull())
        .select("threshold", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bots_recall", "normal_fpr")])
    )


def pick_threshold(scan: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Scan row with the lowest false-positive rate among those that reach the recall; first on ties."""
    return (
        scan.where(F.col("bots_recall") >= target_recall).orderBy("normal_fpr", F.desc("threshold")).limit(1)
    )


def calibrated(scan: DataFrame, target_recall: float = TARGET_RECALL) -> tuple[float, float, float]:
    """Chosen threshold with its recall and false-positive rate; raises if no threshold qualifies."""
    best = pick_threshold(scan, target_recall).first()
    if best is None:
        raise RuntimeError(f"no threshold reaches recall {target_recall:.2f}")
    return best["threshold"], best["bots_recall"], best["normal_fpr"]


def flagged_share(scores: DataFrame, threshold: float, *, score: str = "score", label: str = "label") -> DataFrame:
    """Rows and percentage flagged per class at a threshold."""
    flag = (F.col(score) <= threshold).cast("double")
    return scores.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(flag) * 100, 2).alias("pct_flagged")
    )


def score_summary(
    scores: DataFrame,
    *,
    label: str = "label",
    decision: str = "decision",
    raw: str = "raw_anomaly",
    anomaly: str = "anomaly",
    group_rows: int | None = None,
) -> DataFrame:
    """Mean and median of both scores and percentage called anomalous per class."""
    base = scores.groupBy(label).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(decision).alias("mean_decision"),
        F.avg(raw).alias("mean_raw"),
        F.round(F.avg((F.col(anomaly) == -1).cast("double")) * 100, 2).alias("pct_flagged"),
    )
    out = base
    for column, name in ((decision, "median_decision"), (raw, "median_raw")):
        long = scores.select(label, F.col(column).alias("value"))
        out = out.join(quantile_columns(long, [label], {name: 0.5}, group_rows=group_rows), label, "left")
    return out


def threshold_record(scan: DataFrame, *, trees: int, contamination: str = "auto", seed: int = 42,
                     target_recall: float = TARGET_RECALL) -> DataFrame:
    """One-row table of the chosen threshold and how it was found."""
    value, recall, fpr = calibrated(scan, target_recall)
    rule = "flag as anomalous if score_samples(x) <= calibrated_threshold"
    row = (value, rule, target_recall, recall, fpr, trees, contamination, seed)
    return scan.sparkSession.createDataFrame([row], S.THRESHOLD)
