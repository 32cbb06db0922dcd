"""Batch inference: stored models that are trained, saved, loaded and applied as one thing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatspark import schemas as S, skew
from threatspark.functions.numeric import anomaly_probability
from threatspark.operators import calibration, forest as RF, isolation as IF, rules
from threatspark.sources import feeds

INPUTS = "no int, name string, logged boolean, top int"


def _column(name: str):
    return F.col(f"`{name}`")


def _scaled(models_or_names: Iterable[str], logged: Iterable[str]) -> dict:
    """Inputs of the isolation forest under neutral names: the raw value, or its log for the columns trained that way."""
    logged = set(logged)
    raw = {f"isolation input {i}": (c, _column(c).cast("double")) for i, c in enumerate(models_or_names)}
    return {name: F.log1p(F.greatest(x, F.lit(0.0))) if c in logged else x for name, (c, x) in raw.items()}


@dataclass(frozen=True)
class Models:
    """Random forest on raw features, isolation forest with log scaling, and the calibrated threshold of its score."""

    forest: PipelineModel
    isolation: IF.IsolationForest
    record: DataFrame
    threshold: float
    features: tuple[str, ...]
    logged: tuple[str, ...]
    top: tuple[str, ...]

    def save(self, path: str) -> None:
        """Everything that ``load`` needs, under one folder."""
        from threatspark.sources import sinks

        spark = self.record.sparkSession
        RF.save_model(self.forest, f"{path}/forest")
        self.isolation.save(f"{path}/isolation")
        sinks.write_threshold(self.record, f"{path}/threshold")
        rows = [(i, c, c in self.logged, self.top.index(c) if c in self.top else None) for i, c in enumerate(self.features)]
        spark.createDataFrame(rows, INPUTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")


def load(spark: SparkSession, path: str) -> Models:
    inputs = spark.read.schema(INPUTS).parquet(f"{path}/inputs").orderBy("no").collect()  # one row per feature
    record = feeds.read_threshold(spark, f"{path}/threshold")
    top = sorted((r for r in inputs if r["top"] is not None), key=lambda r: r["top"])
    return Models(
        RF.load_model(f"{path}/forest"),
        IF.IsolationForest.load(spark, f"{path}/isolation"),
        record,
        feeds.threshold_value(record),
        tuple(r["name"] for r in inputs),
        tuple(r["name"] for r in inputs if r["logged"]),
        tuple(r["name"] for r in top),
    )


def train(
    rows: DataFrame,
    row_id: str,
    features: Sequence[str] = S.MODEL_FEATURES,
    *,
    target: str = S.TARGET,
    split: str = "split",
    logged: Sequence[str] = S.LOG_FEATURES,
    forest: dict | None = None,
    isolation: dict | None = None,
    thresholds: list[float] | None = None,
    target_recall: float = calibration.TARGET_RECALL,
    top: int = 2,
) -> Models:
    """Fit both forests on the training rows and calibrate the threshold on the validation rows.

    The isolation forest sees normal traffic only. ``split`` tells 'train' from 'val'; the threshold is the one with the
    lowest false-positive rate among those that reach the recall of the rare class, and none of them is an error. ``rows`` are
    worked out once and stored; the passes over them read the columns they need.
    """
    rows = skew.stored(rows.select(*map(_column, dict.fromkeys([row_id, *features, target, split]))))
    train_rows = rows.where(_column(split) == "train")
    classes = RF.fit_forest(train_rows, features, target, **(forest or {}))
    scaled = _scaled(features, logged)
    normal = train_rows.where(_column(target) == S.NORMAL_LABEL).select(_column(row_id), *[x.alias(n) for n, x in scaled.items()])
    options = {"trees": 200} | (isolation or {})
    trees = IF.fit(normal, list(scaled), row_id, **options)
    nodes = IF.IsolationForest(trees.nodes.checkpoint() if _shared(rows.sparkSession) else trees.nodes, trees.features)
    held = rows.where(_column(split) == "val").select(_column(target).alias("label"), *[x.alias(n) for n, x in scaled.items()])
    scan = calibration.scan_thresholds(nodes.score(held, "score").select("label", "score"), thresholds)
    record = calibration.threshold_record(scan, trees=options["trees"], target_recall=target_recall)
    names = tuple(features)
    used = tuple(c for c in logged if c in names)
    return Models(classes, nodes, record, feeds.threshold_value(record), names, used, tuple(RF.top_features(classes, rows, top)))


def _shared(spark: SparkSession) -> bool:
    from threatspark.session import ensure_checkpoint_dir

    return bool(ensure_checkpoint_dir(spark))


def score(rows: DataFrame, models: Models) -> DataFrame:
    """Adds ``rf_label``, ``rf_confidence`` and ``raw_anomaly``. The random forest reads raw values, the isolation forest scaled ones.

    Each row is read once and nothing is shuffled: the models' own size bounds what every task holds.
    """
    scaled = _scaled(models.features, models.logged)
    classed = RF.predict(models.forest, rows).withColumns(scaled)
    trees = IF.IsolationForest(models.isolation.nodes, tuple(scaled))
    return trees.score(classed, "raw_anomaly").drop(*scaled)


def classify(rows: DataFrame, models: Models) -> DataFrame:
    """Threat class, confidence, anomaly probability, top features and version of every row, without the traffic rules."""
    scored = score(rows, models)
    return rules._unpack(scored, rules.model_verdict(models.threshold, list(models.top)))


def probability(models: Models):
    """Anomaly probability of a scored row."""
    return anomaly_probability(F.col("raw_anomaly"), models.threshold)
