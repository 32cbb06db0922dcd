"""Outbound behaviour: exponentially weighted volume baseline per source, and low-and-slow flows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatspark import schemas as S, skew

IDENTITY = ("source_ip", "dest_ip", "timestamp", "flow_id")
FEATURES = ("Flow Duration", "Total Length of Fwd Packets", "Fwd Packets/s")
DURATION_DIVISOR = {"microseconds": 1_000_000.0, "seconds": 1.0}

_SCORES = {
    "flow_count": T.LongType(),
    "z_score": T.DoubleType(),
    "status": T.StringType(),
    "drift": T.BooleanType(),
    "ewma_mean": T.DoubleType(),
    "ewma_variance": T.DoubleType(),
}


def behavior_payload(flows: DataFrame, *, duration_unit: str = "microseconds") -> DataFrame:
    """Observation rows from labelled-table features plus flow identity.

    Missing columns and unknown units raise. Rows without identity keep a ``reject_reason``.
    """
    missing = [c for c in (*FEATURES, *IDENTITY) if c not in flows.columns]
    if missing:
        raise KeyError(f"missing required column(s) {missing}")
    if duration_unit not in DURATION_DIVISOR:
        raise ValueError(f"unknown duration unit {duration_unit!r}")
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in IDENTITY]))
    return flows.select(
        "source_ip",
        "timestamp",
        "flow_id",
        F.col("Total Length of Fwd Packets").cast("double").alias("byte_count"),
        (F.col("Flow Duration").cast("double") / DURATION_DIVISOR[duration_unit]).alias("flow_duration"),
        F.col("Fwd Packets/s").cast("double").alias("pps"),
        "dest_ip",
        F.when(F.size(gone) > 0, F.concat(F.lit("missing "), F.array_join(gone, ","))).alias("reject_reason"),
    )


def is_low_and_slow(
    duration_s: Column,
    pps: Column,
    min_seconds: float = S.SLOW_MIN_SECONDS,
    max_pps: float = S.SLOW_MAX_PPS,
) -> Column:
    return (duration_s > min_seconds) & (pps < max_pps)


def baseline_step(
    count: int, mean: float, variance: float, x: float, alpha: float, warmup: int
) -> tuple[float, bool, float, float]:
    """Score one value against the state before it; returns (z, scored, new mean, new variance)."""
    z, scored = 0.0, count >= warmup
    delta = x - mean
    if scored:
        if variance > 0.0:
            z = delta / variance**0.5
        elif delta > 0.0:
            z = S.Z_CLAMP
        z = 0.0 if z != z else min(max(z, -S.Z_CLAMP), S.Z_CLAMP)
    if count == 0:
        return z, scored, x, 0.0
    return z, scored, mean + alpha * delta, (1.0 - alpha) * (variance + alpha * delta * delta)


def key_changes(ids: pd.DataFrame, current: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a new key starts in sorted rows, given the key before the batch; nulls are one key."""
    fresh = np.zeros(len(ids), dtype=bool)
    for column in ids.columns:
        values, gone = ids[column].to_numpy(), ids[column].isna().to_numpy()
        fresh[1:] |= (values[1:] != values[:-1]) & ~(gone[1:] & gone[:-1])
    head, tail = (tuple(None if pd.isna(v) else v for v in ids.iloc[i]) for i in (0, -1))
    fresh[0] = current is None or head != current
    return fresh, tail


def score_drift(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    *,
    alpha: float = S.EWMA_ALPHA,
    warmup: int = S.BASELINE_MIN_FLOWS,
    z_limit: float = S.Z_LIMIT,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add the baseline verdict of every row, taken against the rows before it in its key.

    Columns: ``flow_count``, ``ewma_mean``, ``ewma_variance`` (state after the row), ``z_score``, ``status``
    and ``drift``. ``order`` must be unique within a key.

    The recurrence reads each key's rows in order, streaming through sorted partitions. A hot key is cut
    into chunks: the effect of a chunk on any start state is a closed form of four sums, so chunk
    summaries are made in parallel, chained per key (one row per chunk), and every chunk is then scored
    from its own start state.
    """
    ch = skew.chunked(rows, keys, order, chunk_rows=chunk_rows, settle=True)
    fields = [T.StructField(c, rows.schema[c].dataType) for c in rows.columns]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in _SCORES.items()])
    start = {"_n0": T.LongType(), "_m0": T.DoubleType(), "_v0": T.DoubleType()}
    if ch.hot:
        states = _chunk_starts(ch, keys, order, value, alpha)
        data = skew.attach(ch.df, states, ch.group)
    else:
        data = ch.df
    group = ch.group
    columns = list(rows.columns)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, mean, variance = None, 0, 0.0, 0.0
        for batch in batches:
            if batch.empty:
                continue
            fresh, current = key_changes(batch[group], current)
            xs = batch[value].astype("float64").tolist()
            if "_n0" in batch:
                n0 = batch["_n0"].fillna(0).astype("int64").tolist()
                m0, v0 = batch["_m0"].fillna(0.0).tolist(), batch["_v0"].fillna(0.0).tolist()
            out = {n: [None] * len(xs) for n in ("n", "z", "s", "m", "v")}
            for i, x in enumerate(xs):
                if fresh[i]:
                    count, mean, variance = (n0[i], m0[i], v0[i]) if "_n0" in batch else (0, 0.0, 0.0)
                z, scored, mean, variance = baseline_step(count, mean, variance, x, alpha, warmup)
                count += 1
                out["n"][i], out["z"][i], out["s"][i], out["m"][i], out["v"][i] = count, z, scored, mean, variance
            result = batch[columns].copy()
            result["flow_count"] = out["n"]
            result["z_score"] = out["z"]
            result["status"] = np.where(np.array(out["s"], dtype=bool), "SCORED", "INSUFFICIENT_HISTORY")
            result["drift"] = np.array(out["z"], dtype="float64") > z_limit
            result["ewma_mean"] = out["m"]
            result["ewma_variance"] = out["v"]
            yield result

    keep = [*columns, *([skew.CHUNK, *start] if ch.hot else [])]
    ordered = data.select(*keep).repartition(*group).sortWithinPartitions(*group, *order)
    return ordered.mapInPandas(scan, schema)


def _chunk_starts(ch: skew.Chunked, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Baseline state at the start of every chunk of the hot keys."""
    group = ch.group
    types = {f.name: f.dataType for f in ch.df.schema.fields}
    summary_schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField(skew.CHUNK, T.IntegerType()), T.StructField("_rows", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in ("_first", "_b", "_vv", "_mv", "_mm")]
    )

    def effect(xs: np.ndarray) -> tuple[float, float, float, float]:
        """What a run of values makes of a start state.

        Values are taken relative to the first one. With ``e`` the start mean relative to it, ``v`` the start
        variance and ``w`` the weight left of the start: mean = b + w*e, variance = w*v + vv - 2*e*mv + e*e*mm.
        """
        keep = 1.0 - alpha
        b = vv = mv = mm = 0.0
        power = 1.0
        for x in (xs - xs[0]).tolist():
            d = x - b
            vv = keep * (vv + alpha * d * d)
            mv = keep * (mv + alpha * d * power)
            mm = keep * (mm + alpha * power * power)
            b += alpha * d
            power *= keep
        return b, vv, mv, mm

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort")
        xs = pdf[value].astype("float64").to_numpy()
        b, vv, mv, mm = effect(xs)
        row = [*key, len(xs), float(xs[0]), b, vv, mv, mm]
        return pd.DataFrame([row], columns=[f.name for f in summary_schema.fields])

    summaries = ch.hot_rows().select(*group, *order, value).groupBy(*group).applyInPandas(summarise, summary_schema)

    start_schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [
            T.StructField(skew.CHUNK, T.IntegerType()),
            T.StructField("_n0", T.LongType()),
            T.StructField("_m0", T.DoubleType()),
            T.StructField("_v0", T.DoubleType()),
        ]
    )

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(skew.CHUNK)
        n, m, v, out = 0, 0.0, 0.0, []
        for r in pdf.itertuples(index=False):
            f = dict(zip(pdf.columns, r))
            out.append([*key, f[skew.CHUNK], n, m, v])
            if n == 0:  # the key's first value is its own start
                m, v = f["_first"], 0.0
            weight, e = (1.0 - alpha) ** f["_rows"], m - f["_first"]
            v = max(weight * v + f["_vv"] - 2.0 * e * f["_mv"] + e * e * f["_mm"], 0.0)
            m = f["_first"] + f["_b"] + weight * e
            n += f["_rows"]
        return pd.DataFrame(out, columns=[f.name for f in start_schema.fields])

    return summaries.groupBy(*keys).applyInPandas(chain, start_schema)


def classify_behavior(
    observations: DataFrame,
    *,
    seq: str = "flow_id",
    alpha: float = S.EWMA_ALPHA,
    warmup: int = S.BASELINE_MIN_FLOWS,
    z_limit: float = S.Z_LIMIT,
    min_seconds: float = S.SLOW_MIN_SECONDS,
    max_pps: float = S.SLOW_MAX_PPS,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Behavioural verdict per observation: drift or low-and-slow, with nested metrics."""
    scored = score_drift(
        observations,
        ["source_ip"],
        ["timestamp", seq],
        "byte_count",
        alpha=alpha,
        warmup=warmup,
        z_limit=z_limit,
        chunk_rows=chunk_rows,
    )
    return with_behavior_verdict(scored, min_seconds, max_pps)


def with_behavior_verdict(
    scored: DataFrame, min_seconds: float = S.SLOW_MIN_SECONDS, max_pps: float = S.SLOW_MAX_PPS
) -> DataFrame:
    slow = is_low_and_slow(F.col("flow_duration"), F.col("pps"), min_seconds, max_pps)
    metrics = F.struct(
        F.struct(
            F.col("drift").alias("triggered"), F.col("z_score").alias("z_score"), F.col("status").alias("status")
        ).alias("baseline_drift"),
        F.struct(
            slow.alias("triggered"), F.col("flow_duration").alias("duration"), F.col("pps").alias("pps")
        ).alias("low_and_slow"),
    )
    return scored.withColumns(
        {
            "event_type": F.lit(S.BEHAVIORAL_SIGNAL),
            "low_and_slow": slow,
            "alert_triggered": F.col("drift") | slow,
            "metrics": metrics,
        }
    )


def latest_baseline(scored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current baseline of every entity: the state after its last row."""
    state = F.struct("flow_count", "ewma_mean", "ewma_variance")
    last = scored.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias("_s"))
    std = F.when(F.col("_s.ewma_variance") > 0, F.sqrt("_s.ewma_variance")).otherwise(F.lit(0.0))
    return last.select(
        *keys,
        F.col("_s.flow_count").alias("flow_count"),
        F.col("_s.ewma_mean").alias("ewma_mean"),
        std.alias("ewma_std"),
    )


def flow_observations(flows: DataFrame) -> DataFrame:
    """Behavioural observations from the flow-feature table (duration in seconds)."""
    return flows.select(
        F.col("src_ip").alias("source_ip"),
        "timestamp",
        "flow_id",
        F.col("byte_count").cast("double").alias("byte_count"),
        (F.col("flow_duration") / 1_000_000.0).alias("flow_duration"),
        F.col("packets_per_second").alias("pps"),
        F.col("dst_ip").alias("dest_ip"),
    )


def cold_start_rows(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    warmup: int = S.BASELINE_MIN_FLOWS,
    *,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Flag the first ``warmup`` observations of each key, which are never scored."""
    numbered = skew.row_numbers(rows, keys, order, "_rn", chunk_rows=chunk_rows)
    return numbered.withColumn("cold_start", F.col("_rn") <= warmup).drop("_rn")
