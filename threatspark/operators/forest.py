"""Supervised flow classifier on MLlib, and its evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from threatspark import schemas as S
from threatspark.operators.splitting import with_class_weights

OVERFIT_GAP = 0.05


def assemble(features: Sequence[str] = S.MODEL_FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = S.MODEL_FEATURES,
    target: str = S.TARGET,
    *,
    trees: int = 300,
    depth: int = 20,
    min_leaf: int = 5,
    bins: int = 128,
    seed: int = 42,
) -> PipelineModel:
    """Random forest with balanced class weights."""
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc")
    labels = indexer.fit(train)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol="_y",
        weightCol="_weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        maxBins=bins,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=512,
    )
    back = IndexToString(inputCol="prediction", outputCol="rf_label", labels=labels.labels)
    rows = with_class_weights(train, target, "_weight")
    model = Pipeline(stages=[assemble(features), labels, forest]).fit(rows)
    return PipelineModel([model.stages[0], model.stages[2], back])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``rf_label`` and ``rf_confidence`` (highest class probability)."""
    out = model.transform(df)
    confidence = F.array_max(vector_to_array("probability"))
    return out.select(*df.columns, "rf_label", confidence.alias("rf_confidence"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Ranked importances with their percentage; one row per feature."""
    assembler, forest = model.stages[0], model.stages[1]
    values = forest.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(n, float(v), round(100.0 * float(v) / total, 2)) for n, v in zip(assembler.getInputCols(), values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double, pct double")
    return table.orderBy(F.desc("importance"), "feature")


def top_features(model: PipelineModel, df: DataFrame, n: int = 2) -> list[str]:
    return [r["feature"] for r in feature_importance(model, df).limit(n).collect()]


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(f"`{actual}`").alias("actual"), F.col(f"`{predicted}`").alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Rows are actual classes, columns ``pred_<class>`` predicted ones."""
    counts = confusion_counts(df, actual, predicted)
    table = counts.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("rows"))
    return table.select("actual", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"pred_{c}") for c in labels])


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where undefined."""
    counts = confusion_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0)
    both = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("called")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("called")),
            )
        )
    )
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(
        "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support"
    )


def overall_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and macro-F1 in one row."""
    per_class = class_report(df, actual, predicted)
    return per_class.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def overfit_check(train: DataFrame, val: DataFrame, actual: str, predicted: str, limit: float = OVERFIT_GAP) -> DataFrame:
    """Macro-F1 on both splits, their gap, and whether it is above the limit."""
    a = overall_report(train, actual, predicted).select(F.col("macro_f1")).scalar()
    return (
        overall_report(val, actual, predicted)
        .select(a.alias("train_f1"), F.col("macro_f1").alias("val_f1"))
        .withColumn("gap", F.col("train_f1") - F.col("val_f1"))
        .withColumn("overfit", F.col("gap") > limit)
    )
