"""Cleaning and preparation of labelled flow tables, and row contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatspark import schemas as S
from threatspark.functions.numeric import is_infinite, is_missing, log1p_clipped

FLOATING = (T.DoubleType, T.FloatType)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FLOATING)


def numeric_columns(df: DataFrame, target: str | None = S.TARGET) -> list[str]:
    """Numeric columns without the target."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns in their order, nothing else; missing ones raise."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df.select(*[q(c) for c in wanted])


def conformance(df: DataFrame, expected: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Schema check as a table: missing and extra columns, columns of another type, and whether the count fits.

    With a mapping the types are checked too; a time stamp with or without zone is ``timestamp``.
    """
    found = {f.name: f.dataType.simpleString().removesuffix("_ntz") for f in df.schema}
    rows = [("missing", c) for c in expected if c not in found]
    rows += [("extra", c) for c in found if c not in expected]
    if isinstance(expected, Mapping):
        rows += [("type", f"{c}: {found[c]} for {k}") for c, k in expected.items() if c in found and found[c] != k]
    rows.append(("column_count_ok" if len(found) == len(expected) else "column_count_differs", str(len(found))))
    return df.sparkSession.createDataFrame(rows, "finding string, subject string")


def _per_column(df: DataFrame, columns: Sequence[str], flag, name: str) -> DataFrame:
    """One pass: number of flagged rows per column."""
    items = [F.struct(F.lit(c).alias("column"), F.count_if(flag(c)).alias(name)) for c in columns]
    return df.agg(F.array(*items).alias("_a")).select(F.inline("_a"))


def infinite_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, numeric_columns(df, None), lambda c: is_infinite(q(c)), "infinite")


def missing_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, df.columns, lambda c: is_missing(q(c), is_floating(df, c)), "missing")


def non_numeric_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text cells that are present but not numbers."""
    return _per_column(
        df, columns, lambda c: q(c).isNotNull() & q(c).cast("string").try_cast("double").isNull(), "non_numeric"
    )


def invalid_counts(df: DataFrame, columns: Sequence[str] = S.NON_NEGATIVE) -> DataFrame:
    return _per_column(df, columns, lambda c: q(c) < 0, "negative")


def has_infinite(df: DataFrame) -> Column:
    return _any([is_infinite(q(c)) for c in numeric_columns(df, None) if is_floating(df, c)])


def has_missing(df: DataFrame) -> Column:
    return _any([is_missing(q(c), is_floating(df, c)) for c in df.columns])


def drop_infinite(df: DataFrame, mode: str = "rows") -> DataFrame:
    """Drop rows with an infinity, or in mode ``columns`` every column that holds one."""
    if mode == "rows":
        return df.where(~has_infinite(df))
    if mode != "columns":
        raise ValueError(f"unknown mode {mode!r}")
    bad = [r["column"] for r in infinite_counts(df).where("infinite > 0").collect()]  # one row per column
    return df.select(*[q(c) for c in df.columns if c not in bad])


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop()


def drop_copies(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; copies already collapse before the shuffle."""
    return df.dropDuplicates()


def assert_clean(df: DataFrame) -> DataFrame:
    """The same rows, counted once over the finished result; raises if a null, NaN or infinity is left in them."""
    if df.agg(F.count_if(has_missing(df) | has_infinite(df))).first()[0]:
        raise ValueError("missing or infinite values remain")
    return df


# Blanks of every kind, underscore and hyphen.
IGNORED_IN_LABELS = "_- \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def label_key(label: Column) -> Column:
    return F.lower(F.translate(label.cast("string"), IGNORED_IN_LABELS, ""))


def canonical_label(label: Column, names: Sequence[str] = S.FLOW_LABELS) -> Column:
    """Contract spelling of a label, null outside the contract."""
    pairs = [(name.lower().translate({ord(c): None for c in IGNORED_IN_LABELS}), name) for name in names]
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), label_key(label))


def scope_labels(df: DataFrame, target: str = S.TARGET, names: Sequence[str] = S.FLOW_LABELS) -> DataFrame:
    """Keep rows whose label is in scope under any spelling, with the canonical name."""
    return df.withColumn(target, canonical_label(q(target), names)).where(q(target).isNotNull())


def keep_classes(df: DataFrame, classes: Sequence[str] = S.FLOW_LABELS, target: str = S.TARGET) -> DataFrame:
    return df.where(q(target).isin(*classes))


def clean(df: DataFrame, mode: str = "rows", columns: Sequence[str] | None = None) -> DataFrame:
    """First cleaning layer: vector columns, no infinities, no gaps, no copies, labels in scope."""
    wanted = list(columns) if columns is not None else [*S.FLOW_TABLE_FIELDS, S.TARGET]
    rows = require_columns(strip_headers(df), wanted)
    return scope_labels(drop_copies(drop_missing(drop_infinite(rows, mode))))


def cleaning_account(df: DataFrame, target: str = S.TARGET, names: Sequence[str] = S.FLOW_LABELS) -> DataFrame:
    """Rows before and after each step of ``clean`` in mode ``rows``, from a single pass.

    Equal rows are counted once as groups, which gives both the row and the distinct-row totals.
    """
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    finite = ~has_infinite(df)
    whole = finite & ~has_missing(df)
    scoped = whole & canonical_label(q(target), names).isNotNull()

    def total(cond: Column | None, distinct: bool = False) -> Column:
        amount = F.lit(1).cast("long") if distinct else F.col("_copies")
        return F.coalesce(F.sum(amount if cond is None else F.when(cond, amount)), F.lit(0).cast("long"))

    marks = groups.agg(
        total(None).alias("raw"),
        total(finite).alias("finite"),
        total(whole).alias("whole"),
        total(whole, True).alias("unique"),
        total(scoped, True).alias("scoped"),
    )
    steps = [("raw", "raw", "raw"), ("infinite", "raw", "finite"), ("missing", "finite", "whole")]
    steps += [("copies", "whole", "unique"), ("scope", "unique", "scoped")]
    rows = [
        F.struct(
            F.lit(i).alias("step_no"),
            F.lit(n).alias("step"),
            F.col(b).alias("rows_before"),
            F.col(a).alias("rows_after"),
            (F.col(b) - F.col(a)).alias("rows_removed"),
        )
        for i, (n, b, a) in enumerate(steps)
    ]
    return marks.select(F.inline(F.array(*rows)))


def drop_impossible(df: DataFrame, columns: Sequence[str] = S.NON_NEGATIVE) -> DataFrame:
    """Drop rows with a negative duration, gap or rate."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing columns: {absent}")
    return df.where(~F.coalesce(_any([q(c) < 0 for c in columns]), F.lit(False)))


def consolidate(df: DataFrame, columns: Sequence[str] = S.DROPPED_FEATURES) -> DataFrame:
    return df.drop(*columns)


def log_features(df: DataFrame, columns: Sequence[str] = S.LOG_FEATURES) -> DataFrame:
    """``log1p`` of the heavy-tailed columns, clipped at zero; other columns are untouched."""
    return df.select(*[log1p_clipped(q(c)).alias(c) if c in columns else q(c) for c in df.columns])


def supervised_table(df: DataFrame) -> DataFrame:
    """Training table of the classifier: raw values."""
    return consolidate(drop_impossible(df))


def anomaly_table(df: DataFrame) -> DataFrame:
    """Training table of the anomaly model: log-scaled values."""
    return log_features(supervised_table(df))


def model_row(features: DataFrame) -> DataFrame:
    """Flow features under their model names and in model order, next to the identity columns."""
    named = [F.col(src).cast("double").alias(name) for name, src in S.FEATURE_SOURCES.items()]
    return features.select("*", *named)


def _reason(checks: Sequence[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for broken, text in reversed(checks):
        out = F.when(F.coalesce(broken, F.lit(True)), F.lit(text)).otherwise(out)
    return out


def packet_reason() -> Column:
    """Why a packet row breaks its contract; null if it does not."""
    ranges = [(~F.col(c).between(0, 65535), f"{c} out of range") for c in ("src_port", "dst_port")]
    return _reason(
        [
            (F.col("timestamp").isNull(), "timestamp missing"),
            (F.col("src_ip").isNull(), "src_ip missing"),
            (F.col("dst_ip").isNull(), "dst_ip missing"),
            *ranges,
            (~F.col("protocol").isin(*S.PROTOCOLS), "protocol unknown"),
            (F.col("packet_size") < 0, "packet_size negative"),
        ]
    )


def feature_reason() -> Column:
    """Why a flow-feature row breaks its contract; null if it does not."""
    amounts = (
        "packet_count", "byte_count", "flow_duration", "packets_per_second", "avg_packet_size", "iat_mean",
        "iat_std", "unique_destinations", "unique_dest_ports", "syn_count", "flow_bytes_per_second",
        "fwd_packet_length_min",
    )
    return _reason(
        [
            (F.col("flow_id").isNull(), "flow_id missing"),
            (F.col("timestamp").isNull(), "timestamp missing"),
            *[(F.col(c) < 0, f"{c} negative") for c in amounts],
            (~F.col("protocol").isin(*S.PROTOCOLS), "protocol unknown"),
            (~F.col("dst_port").between(0, 65535), "dst_port out of range"),
        ]
    )


def dns_reason() -> Column:
    return _reason([(F.col(c).isNull(), f"{c} missing") for c in ("domain", "query_type", "timestamp", "src_ip")])


def tls_reason() -> Column:
    return _reason(
        [
            (F.col("fingerprint").isNull(), "fingerprint missing"),
            (~F.col("transport").isin(*S.TRANSPORTS), "transport unknown"),
            (~F.col("role").isin(*S.TLS_ROLES), "role unknown"),
            (F.col("timestamp").isNull(), "timestamp missing"),
            (F.col("src_ip").isNull(), "src_ip missing"),
        ]
    )


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their ``reject_reason``."""
    marked = rows.withColumn("reject_reason", reason)
    good = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.where(F.col("reject_reason").isNotNull())
