"""Isolation forest: trees are built from small hash samples, one task per tree; scoring is narrow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threatspark import schemas as S, skew

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, path double, sample int"
_SPACE = 1 << 40


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    grown = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, grown))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random axis-parallel splits until points are alone or the depth limit is met."""
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            f, s, left, right, path = nodes[parent]
            nodes[parent] = (f, s, left if is_right else me, me if is_right else right, path)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        f = int(rng.choice(open_features))
        s = float(rng.uniform(low[f], high[f]))
        below = x[rows, f] <= s
        if below.all():  # the draw hit the upper edge
            s = float(low[f])
            below = x[rows, f] <= s
        nodes.append((f, s, -1, -1, 0.0))
        todo.append((rows[~below], depth + 1, me, True))
        todo.append((rows[below], depth + 1, me, False))
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    """Node table plus the feature order; at most ``trees * (2 * sample - 1)`` rows."""

    nodes: DataFrame
    features: tuple[str, ...]

    def save(self, path: str) -> None:
        meta = [(i, f) for i, f in enumerate(self.features)]
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame(meta, "no int, name string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/features")

    @staticmethod
    def load(spark, path: str) -> "IsolationForest":
        names = spark.read.parquet(f"{path}/features").orderBy("no").collect()
        return IsolationForest(spark.read.parquet(f"{path}/nodes"), tuple(r["name"] for r in names))

    def score(self, df: DataFrame, name: str = "raw_anomaly") -> DataFrame:
        """Add the raw score; lower means more anomalous."""
        spark = df.sparkSession
        table = self.nodes.orderBy("tree", "node").toPandas()  # bounded by trees * nodes per tree
        forest = spark.sparkContext.broadcast(_pack(table))
        features = list(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed = forest.value
            for batch in batches:
                at = [batch.schema.get_field_index(c) for c in features]
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in at])
                scores = pa.array(_score(packed, x), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
        return df.mapInArrow(run, schema)


def _pack(table: pd.DataFrame) -> dict[str, np.ndarray]:
    """All trees in one array set; children are absolute positions and leaves point to themselves."""
    start = table.groupby("tree", sort=True)["node"].size()
    base = np.repeat(np.concatenate([[0], np.cumsum(start.to_numpy())[:-1]]), start.to_numpy())
    own = np.arange(len(table))
    leaf = table["feature"].to_numpy() < 0
    return {
        "feature": np.where(leaf, 0, table["feature"].to_numpy()),
        "split": np.where(leaf, np.inf, table["split"].to_numpy()),
        "left": np.where(leaf, own, base + table["left"].to_numpy()),
        "right": np.where(leaf, own, base + table["right"].to_numpy()),
        "path": table["path"].to_numpy(dtype="float64"),
        "roots": np.unique(base),
        "sample": np.array([table["sample"].max()]),
    }


def _score(packed: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    n = len(x)
    rows = np.arange(n)
    total = np.zeros(n)
    for root in packed["roots"]:
        at = np.full(n, root)
        while True:
            goes_left = x[rows, packed["feature"][at]] <= packed["split"][at]
            after = np.where(goes_left, packed["left"][at], packed["right"][at])
            if (after == at).all():
                break
            at = after
        total += packed["path"][at]
    mean = total / max(len(packed["roots"]), 1)
    return -np.power(2.0, -mean / float(average_path(packed["sample"])[0]))


def _binomial_sums(n: int, p: float) -> list[float]:
    """Chances of at most 0, 1, ... successes in ``n`` trials, up to where they are 1 in double precision."""
    if p >= 1:
        return [0.0] * n
    sums, term = [], (1 - p) ** n
    total = term
    for k in range(n):
        if total >= 1 - 1e-15:
            break
        sums.append(total)
        term *= (n - k) / (k + 1) * p / (1 - p)
        total += term
    return sums


def fit(
    rows: DataFrame,
    features: list[str],
    row_id: str,
    *,
    trees: int = 200,
    sample: int = 256,
    seed: int = 42,
) -> IsolationForest:
    """Fit on ``rows`` (normal traffic only). ``row_id`` must be unique; it makes the samples repeatable.

    A row's hash draws how many trees take it, from the binomial distribution that gives each tree a little more than its
    sample; only rows that some tree takes are expanded and shuffled. Input size changes no step.
    """
    base = rows.select(F.col(row_id).cast("string").alias("_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    n = base.count()
    if n == 0:
        raise ValueError("no rows to fit")
    share = min(1.0, (1.3 * sample + 8.0) / n)
    below = [int(x * _SPACE) for x in _binomial_sums(trees, share)]
    u = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(_SPACE))
    taken = base.withColumn("_k", F.size(F.filter(F.array(*map(F.lit, below)), lambda x: x <= u))).where("_k > 0")
    turn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("_id", t, F.lit(seed + 1)).alias("h"), t.alias("t")))
    chosen = F.transform(F.slice(F.array_sort(turn), F.lit(1), F.col("_k")), lambda x: x["t"])
    drawn = taken.select("*", F.explode(chosen).alias("tree")).drop("_k")
    drawn = drawn.withColumn("_h", F.pmod(F.xxhash64("_id", "tree", F.lit(seed)), F.lit(_SPACE)))
    names = list(features)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        pdf = pdf.sort_values(["_h", "_id"]).head(sample)
        size = len(pdf)
        limit = int(np.ceil(np.log2(max(size, 2))))
        nodes = grow_tree(pdf[names].to_numpy(dtype="float64"), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "path"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        out["sample"] = size
        return out

    nodes = drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
    return IsolationForest(nodes, tuple(features))


def with_decision(
    scored: DataFrame,
    train_scores: DataFrame,
    contamination: float = 0.05,
    name: str = "raw_anomaly",
    *,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``decision`` (score minus the training quantile) and ``anomaly`` (1 normal, -1 anomalous)."""
    keyed = train_scores.select(F.lit("train").alias("_g"), F.col(name).alias("_s"))
    offset = skew.exact_quantiles(keyed, ["_g"], "_s", [contamination], group_rows=group_rows).agg(F.max("q"))
    decision = F.col(name) - offset.scalar()
    return scored.withColumn("decision", decision).withColumn(
        "anomaly", F.when(F.col("decision") < 0, -1).otherwise(1)
    )


def separation(scored: DataFrame, target: str = S.TARGET, name: str = "raw_anomaly") -> DataFrame:
    """Mean score of the rare and the normal class, and whether the rare class lies lower."""
    label = F.col(f"`{target}`")
    return scored.agg(
        F.avg(F.when(label == S.BOTS_LABEL, F.col(name))).alias("rare_mean"),
        F.avg(F.when(label == S.NORMAL_LABEL, F.col(name))).alias("normal_mean"),
    ).withColumn("separated", F.col("rare_mean") < F.col("normal_mean"))
