"""Packet, DNS and TLS record files: JSON lines, batch or stream, with rejected rows kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threatspark import schemas as S
from threatspark.operators import cleaning

CORRUPT = "_corrupt"


def parse_json_lines(lines: DataFrame, schema: T.StructType, reason: Column) -> DataFrame:
    """Parsed rows with ``reject_reason`` (null for good rows) and the ``raw`` line of bad ones.

    Blank lines are skipped. Malformed and invalid lines stay in the table, so nothing is lost silently.
    """
    full = schema.add(CORRUPT, T.StringType()) if CORRUPT not in schema.fieldNames() else schema
    parsed = lines.where(F.trim("value") != "").select(
        "value",
        F.from_json(
            "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        ).alias("r"),
    )
    rows = parsed.select("value", "r.*")
    broken = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed line")).otherwise(reason)
    out = rows.withColumn("reject_reason", broken)
    return out.select(
        *[c for c in rows.columns if c not in ("value", CORRUPT)],
        "reject_reason",
        F.when(F.col("reject_reason").isNotNull(), F.col("value")).alias("raw"),
    )


def read_packets(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    return parse_packets((spark.readStream if stream else spark.read).options(**options).text(path))


def parse_packets(lines: DataFrame) -> DataFrame:
    rows = parse_json_lines(lines, T.StructType(list(S.PACKETS.fields)), cleaning.packet_reason())
    return rows.withColumn("syn_flag", F.coalesce("syn_flag", F.lit(False)))


def read_dns_queries(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    return parse_dns_queries((spark.readStream if stream else spark.read).options(**options).text(path))


def parse_dns_queries(lines: DataFrame) -> DataFrame:
    return _timed(parse_json_lines(lines, T.StructType(list(S.DNS_QUERIES.fields)), cleaning.dns_reason()))


def read_tls_sessions(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    return parse_tls_sessions((spark.readStream if stream else spark.read).options(**options).text(path))


def parse_tls_sessions(lines: DataFrame) -> DataFrame:
    return _timed(parse_json_lines(lines, T.StructType(list(S.TLS_SESSIONS.fields)), cleaning.tls_reason()))


def _timed(rows: DataFrame) -> DataFrame:
    """Text time to timestamp; unreadable times are rejected."""
    ts = F.try_to_timestamp("timestamp")
    unreadable = F.col("reject_reason").isNull() & ts.isNull()
    reason = F.when(unreadable, F.lit("timestamp unreadable")).otherwise(F.col("reject_reason"))
    raw = F.when(unreadable, F.coalesce("raw", F.col("timestamp"))).otherwise(F.col("raw"))
    return rows.withColumns({"_ts": ts, "reject_reason": reason, "raw": raw}).drop("timestamp").withColumnRenamed(
        "_ts", "timestamp"
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")


def load_summary(rows: DataFrame) -> DataFrame:
    """Accepted and rejected row counts of a read."""
    bad = F.col("reject_reason").isNotNull()
    return rows.agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
