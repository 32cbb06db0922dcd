"""Writers: prepared tables, threshold record, stored flows and alerts, live feed."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from threatspark import schemas as S
from threatspark.operators import alerts as A
from threatspark.session import ensure_checkpoint_dir


def write_training_tables(supervised: DataFrame, anomaly: DataFrame, path: str, fmt: str = "parquet") -> None:
    for name, table in (("supervised", supervised), ("anomaly", anomaly)):
        table.write.mode("overwrite").format(fmt).options(header=True).save(f"{path}/{name}")


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Scores, scan and report tables."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_threshold(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


class AlertStore:
    """Flows and alerts as parquet folders, partitioned by day and id hash, with upsert by id.

    An upsert reads and rewrites the partitions that its rows fall into and no others. A row whose day has changed leaves its
    older form in another partition; every row says when it was stored, and readers take the newest of an id. Writing the same
    rows again gives the same table, so a run that was interrupted between partitions is mended by its replay.
    """

    SCHEMAS = {"flows": S.FLOWS, "alerts": S.ALERTS}
    KEYS = {"flows": "flow_id", "alerts": "alert_id"}
    DAY, BUCKET, STORED = "stored_day", "stored_bucket", "stored_at"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _layout(self, name: str) -> T.StructType:
        extra = [T.StructField(self.STORED, T.LongType()), T.StructField(self.DAY, T.StringType()), T.StructField(self.BUCKET, T.IntegerType())]
        return T.StructType([*self.SCHEMAS[name].fields, *extra])

    def _rows(self, name: str) -> DataFrame:
        """Everything that lies in the table, older forms included; partitions are pruned by day and bucket."""
        try:
            return self.spark.read.schema(self._layout(name)).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:  # nothing stored yet
            if "PATH_NOT_FOUND" in str(exc):
                return self.spark.createDataFrame([], self._layout(name))
            raise

    def read(self, name: str) -> DataFrame:
        """The newest form of every id."""
        columns = self.SCHEMAS[name].fieldNames()
        return A.latest(self._rows(name).drop(self.DAY, self.BUCKET), self.KEYS[name], [self.STORED, "timestamp"]).select(*columns)

    def find(self, name: str, day: str, ids: list[str] | None = None) -> DataFrame:
        """Stored rows of one day, or of some ids in it: reads that day's partitions, or those ids' buckets of it."""
        rows = self._rows(name).where(F.col(self.DAY) == day)
        if ids is not None:
            keys = self.spark.createDataFrame([(i,) for i in ids], "id string")
            wanted = [r[0] for r in keys.select(self._bucket(F.col("id"))).distinct().collect()]
            rows = rows.where(F.col(self.BUCKET).isin(wanted) & F.col(self.KEYS[name]).isin(ids))
        return A.latest(rows.drop(self.DAY, self.BUCKET), self.KEYS[name], [self.STORED, "timestamp"]).select(*self.SCHEMAS[name].fieldNames())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def upsert(self, name: str, rows: DataFrame, stored_at: int | None = None) -> None:
        """Put rows on top of those of equal id. ``stored_at`` orders upserts (the clock in microseconds unless given).

        Rows of equal id in one batch: the newest timestamp stays, then the greatest row. The touched partitions are a table of
        a few words each, never more rows than the store has partitions; old rows outside of them are not read.
        """
        key, columns = self.KEYS[name], self.SCHEMAS[name].fieldNames()
        at = time.time_ns() // 1000 if stored_at is None else stored_at
        day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none"))
        new = rows.select(*columns).withColumns({self.STORED: F.lit(at).cast("long"), self.DAY: day, self.BUCKET: self._bucket(F.col(key))})
        new = new.checkpoint() if ensure_checkpoint_dir(self.spark) else new
        touched = new.select(self.DAY, self.BUCKET).distinct()
        old = self._rows(name).join(F.broadcast(touched), [self.DAY, self.BUCKET], "left_semi").select(*new.columns)
        tie = F.xxhash64(*[F.col(c) for c in columns])
        both = old.unionByName(new).withColumn("_tie", tie)
        merged = A.latest(both, key, [self.STORED, "timestamp", "_tie"]).drop("_tie")
        merged = merged.checkpoint()  # the partitions are read before they are replaced
        self._replace(name, merged, "dynamic")

    def _replace(self, name: str, rows: DataFrame, mode: str) -> None:
        rows = rows.repartition(self.DAY, self.BUCKET).select(*self._layout(name).fieldNames())
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(self.DAY, self.BUCKET).parquet(f"{self.path}/{name}")

    def compact(self, name: str) -> None:
        """Rewrite the table without the older forms that a changed day has left behind."""
        rows = A.latest(self._rows(name).drop(self.DAY, self.BUCKET), self.KEYS[name], [self.STORED, "timestamp"])
        day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none"))
        placed = rows.withColumns({self.DAY: day, self.BUCKET: self._bucket(F.col(self.KEYS[name]))})
        ensure_checkpoint_dir(self.spark)
        self._replace(name, placed.checkpoint(), "static")

    def reset(self) -> None:
        """Clear both tables."""
        for name in self.SCHEMAS:
            self._replace(name, self.spark.createDataFrame([], self._layout(name)), "static")

    def upsert_stream(self, name: str, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Upsert every micro-batch; stable ids make a replayed batch harmless."""
        return (
            rows.writeStream.foreachBatch(lambda batch, _: self.upsert(name, batch))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def feed_messages(alerts: DataFrame) -> DataFrame:
    """Alert rows as feed messages (key, JSON value), ready for a message queue or file sink."""
    body = F.struct(F.lit("alert").alias("type"), F.struct(*alerts.columns).alias("alert"))
    return alerts.select(F.col("alert_id").alias("key"), F.to_json(body).alias("value"))


def start_feed(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Live alert feed as an append-only JSON folder."""
    return (
        feed_messages(alerts)
        .writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
