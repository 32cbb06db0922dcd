"""Correlation of the four detector branches per source.

Signals are narrow rows; the evidence of an alert is looked up afterwards by ``alert_entries``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threatspark import schemas as S, skew
from threatspark.operators.alerts import fixed
from threatspark.operators.behavior import key_changes

ORDER = ("_t", "seq")
EVIDENCE_FIELDS = ("source_ip", "ts", "seq", "signal_type", "flow_id", "detail", "evidence")


def _signal(rows: DataFrame, signal_type: str, detail: Column, evidence: Column) -> DataFrame:
    return rows.select(
        "source_ip",
        F.col("timestamp").alias("ts"),
        F.col("seq").cast("long").alias("seq"),
        F.lit(signal_type).alias("signal_type"),
        "flow_id",
        detail.alias("detail"),
        F.to_json(evidence).alias("evidence"),
    )


def ml_gate(scored: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals, near misses and rejected rows of the flow-model branch.

    Needs ``source_ip, timestamp, seq, flow_id, rf_threat_class, rf_confidence, iforest_raw_score``.
    Normal traffic gives nothing. The rare class needs a raw score below the threshold, else it is a near miss.
    """
    label, score = F.col("rf_threat_class"), F.col("iforest_raw_score")
    rare = label == S.BOTS_LABEL
    broken = (
        F.when(rare & score.isNull(), "iforest_raw_score is required for " + S.BOTS_LABEL)
        .when(label.isNull() | ~label.isin(*S.FLOW_LABELS), F.concat(F.lit("unrecognized class "), F.coalesce(label, F.lit("null"))))
    )
    rows = scored.withColumn("_broken", broken)
    rejected = rows.where(F.col("_broken").isNotNull()).withColumnRenamed("_broken", "reject_reason")
    sound = rows.where(F.col("_broken").isNull() & (label != S.NORMAL_LABEL)).drop("_broken")
    backed = ~rare | (score < threshold)
    detail = F.when(rare, F.lit("Bots (RF) corroborated by Isolation Forest")).otherwise(
        F.concat(label, F.lit(" (RF)"))
    )
    evidence = F.struct(
        label.alias("rf_threat_class"),
        F.when(~rare, F.col("rf_confidence")).alias("rf_confidence"),
        F.when(rare, score).alias("iforest_raw_score"),
        F.when(rare, F.lit(float(threshold))).alias("calibrated_threshold"),
    )
    signals = _signal(sound.where(backed), S.ML_SIGNAL, detail, evidence)
    near = sound.where(~backed).select(
        "source_ip",
        F.col("timestamp").alias("ts"),
        "flow_id",
        F.lit("anomaly score did not corroborate the rare class").alias("reason"),
        F.struct(
            label.alias("rf_threat_class"),
            F.col("rf_confidence"),
            score.alias("iforest_raw_score"),
            F.lit(float(threshold)).alias("calibrated_threshold"),
        ).alias("detail"),
    )
    return signals, near, rejected


def dns_gate(verdicts: DataFrame) -> DataFrame:
    """Signals of the DNS branch: rows with a ``dns_flag``."""
    rows = verdicts.where(F.coalesce(F.col("dns_flag"), F.lit("")) != "")
    detail = F.concat(F.col("dns_flag"), F.lit(" on domain "), F.coalesce("domain", F.lit("?")))
    return _signal(rows, S.DNS_SIGNAL, detail, F.struct("domain", "dns_flag"))


def tls_gate(verdicts: DataFrame) -> DataFrame:
    """Signals of the TLS branch: rows with ``ja3_match``."""
    family = F.coalesce("matched_signature", F.lit("unknown family"))
    detail = F.concat(F.lit("JA3 match ("), family, F.lit(")"))
    rows = verdicts.where(F.coalesce("ja3_match", F.lit(False)))
    return _signal(rows, S.TLS_SIGNAL, detail, F.struct("ja3_hash", "matched_signature"))


def behavior_gate(verdicts: DataFrame) -> DataFrame:
    """Signals of the behavioural branch: triggered rows of ``classify_behavior``, one category for both checks."""
    rows = verdicts.where("alert_triggered")
    drift = F.when(
        F.col("drift"), F.concat(F.lit("volume baseline drift (z="), fixed(F.col("z_score"), 2), F.lit(")"))
    )
    slow = F.when(
        F.col("low_and_slow"),
        F.concat(
            F.lit("low-and-slow (duration="),
            fixed(F.col("flow_duration"), 0),
            F.lit("s, pps="),
            fixed(F.col("pps"), 2),
            F.lit(")"),
        ),
    )
    evidence = F.struct(F.col("metrics").alias("behavioral_metrics"), "dest_ip")
    return _signal(rows, S.BEHAVIORAL_SIGNAL, F.concat_ws(" + ", drift, slow), evidence)


def merge_signals(*branches: DataFrame) -> DataFrame:
    """One signal table from the branch signals."""
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def categories(
    signals: DataFrame,
    window_seconds: float = S.FUSION_WINDOW_SECONDS,
    *,
    signal_types: tuple[str, ...] = S.SIGNAL_TYPES,
    peers: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add ``signals``: the sorted distinct categories of the source in the closed trailing window."""
    names = sorted(signal_types)
    counted = skew.trailing_sums(
        signals.withColumn("_t", F.unix_micros("ts")),
        ["source_ip"],
        "_t",
        ["seq"],
        int(round(window_seconds * 1_000_000)),
        {f"_n{i}": (F.col("signal_type") == n).cast("long") for i, n in enumerate(names)},
        peers=peers,
        chunk_rows=chunk_rows,
    )
    present = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(n)) for i, n in enumerate(names)]))
    return counted.withColumn("signals", present).drop("_t", *[f"_n{i}" for i in range(len(names))])


def fuse(
    signals: DataFrame,
    window_seconds: float = S.FUSION_WINDOW_SECONDS,
    cooldown_seconds: float | None = None,
    *,
    keep_suppressed: bool = False,
    peers: bool = False,
    signal_types: tuple[str, ...] = S.SIGNAL_TYPES,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Fusion outcome per signal.

    One category in the window: LOW. Two or more: HIGH, unless the source escalated less than the cool-down
    ago, in which case the row gives no alert (kept as SUPPRESSED on request).
    """
    cooldown = window_seconds if cooldown_seconds is None else cooldown_seconds
    rows = categories(signals, window_seconds, signal_types=signal_types, peers=peers, chunk_rows=chunk_rows).select(
        "source_ip", "ts", "seq", "signal_type", "flow_id", "signals"
    )
    rows = skew.settled(rows)
    single = rows.where(F.size("signals") < 2)
    many = rows.where(F.size("signals") >= 2)
    low = single.withColumns(
        {"severity": F.lit("LOW"), "alert_type": F.concat("signal_type", F.lit("_DETECTION"))}
    )
    high = mark_escalations(many, cooldown, chunk_rows=chunk_rows).withColumns(
        {
            "severity": F.when(F.col("escalated"), "HIGH").otherwise("SUPPRESSED"),
            "alert_type": F.lit(S.DATA_EXFILTRATION),
        }
    )
    if not keep_suppressed:
        high = high.where("escalated")
    return low.unionByName(high.drop("escalated"))


def mark_escalations(rows: DataFrame, cooldown_seconds: float, *, chunk_rows: int | None = None) -> DataFrame:
    """Add ``escalated``: first row of a source, then the first row at least the cool-down after the last one.

    The choice depends on the rows chosen before, so each source is read in order. A hot source is first
    reduced to its distinct instants and cut into chunks. For every chunk the last choice is worked out
    for each possible first choice; the chunks are then chained and scanned in parallel.
    """
    wait = int(round(cooldown_seconds * 1_000_000))
    if wait <= 0:
        return rows.withColumn("escalated", F.lit(True))
    timed = rows.withColumn("_t", F.unix_micros("ts"))
    ch = skew.chunked(timed, ["source_ip"], list(ORDER), chunk_rows=chunk_rows, settle=True)
    timed = ch.done()
    schema = T.StructType([*rows.schema.fields, T.StructField("escalated", T.BooleanType())])
    if not ch.hot:
        ordered = timed.repartition("source_ip").sortWithinPartitions("source_ip", *ORDER)
        return ordered.mapInPandas(_scan(["source_ip"], rows.columns, wait), schema)

    instants = timed.groupBy("source_ip", "_t").agg(F.min("seq").alias("seq"))
    ch = skew.chunked(instants, ["source_ip"], ["_t"], chunk_rows=chunk_rows)
    chosen_schema = T.StructType([*[instants.schema[c] for c in ("source_ip", "_t", "seq")], schema["escalated"]])
    columns = ["source_ip", "_t", "seq"]
    if ch.hot:
        data = skew.attach(ch.df, _chunk_entries(ch, wait), ch.group)
        keep = [*columns, skew.CHUNK, "_last"]
    else:
        data, keep = ch.df, columns
    chosen = (
        data.select(*keep)
        .repartition(*ch.group)
        .sortWithinPartitions(*ch.group, "_t")
        .mapInPandas(_scan(ch.group, columns, wait), chosen_schema)
        .where("escalated")
    )
    marked = timed.join(chosen, ["source_ip", "_t", "seq"], "left")
    return marked.select(*rows.columns, F.coalesce("escalated", F.lit(False)).alias("escalated"))


def _scan(group: list[str], columns: list[str], wait: int):
    never = -(1 << 62)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, never
        for batch in batches:
            if batch.empty:
                continue
            fresh, current = key_changes(batch[group], current)
            times = batch["_t"].to_numpy()
            entry = batch["_last"].to_numpy() if "_last" in batch else None
            flags = np.zeros(len(batch), dtype=bool)
            edges = np.unique(np.append(np.flatnonzero(fresh), [0, len(batch)]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if fresh[lo]:
                    last = never if entry is None or np.isnan(entry[lo]) else int(entry[lo])
                i = lo + int(np.searchsorted(times[lo:hi], last + wait))
                while i < hi:
                    flags[i], last = True, int(times[i])
                    i = lo + int(np.searchsorted(times[lo:hi], last + wait))
            out = batch[columns].copy()
            out["escalated"] = flags
            yield out

    return run


def last_choices(times: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted chunk: runs of possible first choices that end in the same last choice.

    Returns the last time of each run and the final choice it leads to. A start state only
    decides the first choice, and that lies in the first cool-down period of the chunk.
    """
    n = len(times)
    jump = np.searchsorted(times, times + wait)
    jump = np.where(jump < n, jump, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    reach = min(n, int(np.searchsorted(times, times[0] + wait)) + 1)
    ends = times[jump[:reach]]
    last_of_run = np.append(ends[1:] != ends[:-1], True)
    return times[:reach][last_of_run], ends[last_of_run]


def _chunk_entries(ch: skew.Chunked, wait: int) -> DataFrame:
    """Time of the last escalation before each chunk of the hot sources (null if none)."""
    source = ch.df.schema["source_ip"]
    longs = T.ArrayType(T.LongType())
    chunk = T.StructField(skew.CHUNK, T.IntegerType())
    summary_schema = T.StructType([source, chunk, T.StructField("_upto", longs), T.StructField("_ends", longs)])
    entry_schema = T.StructType([source, chunk, T.StructField("_last", T.LongType())])

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        upto, ends = last_choices(np.sort(pdf["_t"].to_numpy()), wait)
        return pd.DataFrame([[*key, upto, ends]], columns=[f.name for f in summary_schema.fields])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for _, r in pdf.sort_values(skew.CHUNK).iterrows():
            out.append([*key, r[skew.CHUNK], last])
            first = 0 if last is None else int(np.searchsorted(r["_upto"], last + wait))
            if first < len(r["_ends"]):
                last = int(r["_ends"][first])
        frame = pd.DataFrame(out, columns=[f.name for f in entry_schema.fields])
        return frame.astype({"_last": "Int64"})

    chunks = ch.hot_rows().groupBy(*ch.group).applyInPandas(summarise, summary_schema)
    return chunks.groupBy("source_ip").applyInPandas(chain, entry_schema)


def alert_entries(
    outcome: DataFrame, signals: DataFrame, window_seconds: float = S.FUSION_WINDOW_SECONDS
) -> DataFrame:
    """The signals behind each alert, one row per entry, instead of a list inside the alert.

    A LOW alert names its own signal. A HIGH alert names every signal of its source in the window up to
    itself. Sources meet on window-long time buckets: an alert looks into its own bucket and the one before.
    """
    width = int(round(window_seconds * 1_000_000))
    t = F.unix_micros("ts")
    low = outcome.where(F.col("severity") == "LOW").select(
        "source_ip", F.col("ts").alias("alert_ts"), F.col("seq").alias("alert_seq"), F.lit("LOW").alias("severity"),
        F.col("seq").alias("entry_seq"), "signal_type", "flow_id",
    )
    alerts = outcome.where(F.col("severity") == "HIGH").select(
        F.col("source_ip").alias("_src"),
        F.col("ts").alias("alert_ts"),
        F.col("seq").alias("alert_seq"),
        t.alias("_at"),
        F.explode(F.array(F.floor(t / width), F.floor(t / width) - 1)).alias("_bucket"),
    )
    entries = signals.select(
        "source_ip",
        F.col("seq").alias("entry_seq"),
        "signal_type",
        "flow_id",
        t.alias("_et"),
        F.floor(t / width).alias("_eb"),
    )
    inside = (
        (F.col("source_ip") == F.col("_src"))
        & (F.col("_eb") == F.col("_bucket"))
        & (F.col("_et") >= F.col("_at") - width)
        & ((F.col("_et") < F.col("_at")) | ((F.col("_et") == F.col("_at")) & (F.col("entry_seq") <= F.col("alert_seq"))))
    )
    high = entries.join(alerts, inside).select(
        "source_ip", "alert_ts", "alert_seq", F.lit("HIGH").alias("severity"), "entry_seq", "signal_type", "flow_id"
    )
    return low.unionByName(high)


def run_summary(outcome: DataFrame, near_misses: DataFrame) -> DataFrame:
    """Alert counts by severity and the number of near misses."""
    by_severity = outcome.groupBy(F.concat(F.lit("alerts_"), F.lower("severity")).alias("item")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return by_severity.unionByName(
        near_misses.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("near_misses").alias("item"), "rows")
    )


def run_listing(outcome: DataFrame, near_misses: DataFrame) -> DataFrame:
    """HIGH alerts and near misses of a run in one table."""
    high = outcome.where(F.col("severity") == "HIGH").select(
        F.lit("high_alert").alias("kind"), "source_ip", "ts", "flow_id", F.concat_ws(", ", "signals").alias("text")
    )
    near = near_misses.select(
        F.lit("near_miss").alias("kind"), "source_ip", "ts", "flow_id", F.col("reason").alias("text")
    )
    return high.unionByName(near)
