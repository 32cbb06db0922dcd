"""Reference lists, labelled flow tables and the threshold record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threatspark import schemas as S, skew
from threatspark.operators import cleaning


def _usable(domain: Column) -> Column:
    return F.contains(domain, F.lit(".")) & (F.length(domain) >= S.MIN_DOMAIN_LENGTH)


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no valid {what}: check the file format")
    return df


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """Distinct lower-case domains from feed lines (column ``value``)."""
    line = F.trim("value")
    domain = F.lower(F.trim(F.get(F.split(line, ","), 0)))
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(domain.alias("domain"))
    return rows.where(_usable(F.col("domain"))).distinct()


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return _not_empty(parse_blocklist(spark.read.text(path)), f"domains in {path}")


def rank_domains(rows: DataFrame, sample_size: int | None = None) -> DataFrame:
    """``position, domain`` of all rows (``line_no, domain``), or of the first ``sample_size``, cleaned, without repeats."""
    head = rows if sample_size is None else rows.orderBy("line_no").limit(sample_size)
    name = F.lower(F.trim("domain"))
    names = head.where(F.lower("domain") != "domain").select("line_no", name.alias("domain"))
    first = names.groupBy("domain").agg(F.min("line_no").alias("line_no")).where(_usable(F.col("domain")))
    return skew.row_numbers(first, [], ["line_no"], "position").select("position", "domain")


def read_ranked_domains(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """Ranked list in either form: ``rank,domain`` or ``domain`` alone, in file order."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"),
    )
    cells = F.split("value", ",")
    ordered = F.struct("_f", "_b", "_i")
    domain = F.when(F.size(cells) >= 2, F.get(cells, 1)).otherwise(F.get(cells, 0))
    rows = lines.select(ordered.alias("line_no"), domain.alias("domain"))
    return _not_empty(rank_domains(rows, sample_size), f"domains in {path}")


def fingerprint_column(columns: Sequence[str]) -> str:
    for column in columns:
        if any(hint in column.strip().lower() for hint in S.JA3_HEADER_HINTS):
            return column
    raise ValueError(f"no fingerprint column in header: {list(columns)}")


def parse_fingerprints(rows: DataFrame) -> DataFrame:
    """Distinct fingerprints from a table with a header; footer comments are skipped, bad values raise."""
    column = fingerprint_column(rows.columns)
    value = F.trim(F.col(f"`{column}`"))
    footer = F.startswith(F.trim(F.coalesce(F.col(f"`{rows.columns[0]}`"), F.lit(""))), F.lit("#"))
    found = rows.where(~footer & (F.coalesce(value, F.lit("")) != "")).select(value.alias("ja3_md5")).distinct()
    bad = found.where(~F.col("ja3_md5").rlike(S.JA3_PATTERN))
    counted = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ja3_md5").rlike(S.JA3_PATTERN)).alias("bad")).first()
    if counted["n"] == 0:
        raise ValueError(f"no fingerprints in column {column!r}")
    if counted["bad"]:
        shown = [r[0] for r in bad.limit(3).collect()]
        raise ValueError(f"{counted['bad']} malformed fingerprints in column {column!r}, such as {shown}")
    return found


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return parse_fingerprints(spark.read.option("header", True).csv(path))


def read_flow_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, target: str = S.TARGET
) -> DataFrame:
    """Labelled flow table: header blanks stripped, vector columns in order with their types, extras dropped.

    The header row is read first (one line), so the scan itself has an explicit schema.
    """
    header = spark.read.option("header", True).csv(path).columns
    wanted = list(columns) if columns is not None else [*S.FLOW_TABLE_FIELDS, target]
    missing = [c for c in wanted if c not in [h.strip() for h in header]]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    kinds = {**S.FLOW_TABLE_FIELDS, target: T.StringType()}
    schema = T.StructType(
        [T.StructField(h, kinds.get(h.strip(), T.StringType()), True) for h in header]
    )
    options = {"header": True, "nanValue": "NaN", "positiveInf": "inf", "negativeInf": "-inf"}
    rows = spark.read.options(**options).schema(schema).csv(path)
    return cleaning.require_columns(cleaning.strip_headers(rows), wanted)


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    """Threshold record; the file must exist and name a threshold."""
    rows = spark.read.schema(S.THRESHOLD).json(path, multiLine=True)
    return _not_empty(rows.where(F.col("calibrated_threshold").isNotNull()), f"threshold in {path}")


def threshold_value(record: DataFrame) -> float:
    return float(record.select("calibrated_threshold").first()[0])
