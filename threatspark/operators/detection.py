"""The detection pipeline: packets to flows, features, behaviour, models, decision, suppression and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threatspark import schemas as S
from threatspark.operators import alerts as A, behavior as B, cleaning as C, flows as FL, inference as I, rules as R

#: Columns that the behavioural branch adds to a flow.
BEHAVIOR = ("z_score", "drift", "low_and_slow", "alert_triggered")


@dataclass(frozen=True)
class Settings:
    """Parameters of every step; the defaults are those of the single operators."""

    gap_seconds: float = S.FLOW_GAP_SECONDS
    alpha: float = S.EWMA_ALPHA
    warmup: int = S.BASELINE_MIN_FLOWS
    z_limit: float = S.Z_LIMIT
    slow_seconds: float = S.SLOW_MIN_SECONDS
    slow_pps: float = S.SLOW_MAX_PPS
    min_syn: int = 20
    min_pps: float = 100.0
    min_ports: int = 10
    max_packets: int = 5
    dedup_seconds: float = S.DEDUP_SECONDS


def is_slow(settings: Settings) -> Column:
    """Long flows at a low rate; flow durations are microseconds in the feature table."""
    return B.is_low_and_slow(F.col("flow_duration") / 1_000_000.0, F.col("packets_per_second"), settings.slow_seconds, settings.slow_pps)


def with_state(flows: DataFrame, settings: Settings = Settings(), *, chunk_rows: int | None = None) -> DataFrame:
    """Flows with what their source has done up to them, in close order: cardinalities and volume baseline."""
    counted = FL.with_running_cardinalities(flows, chunk_rows=chunk_rows)
    scored = B.score_drift(
        counted, ["src_ip"], ["last_us", "flow_id"], "byte_count",
        alpha=settings.alpha, warmup=settings.warmup, z_limit=settings.z_limit, chunk_rows=chunk_rows,
    )
    slow = scored.withColumn("low_and_slow", is_slow(settings))
    return slow.withColumn("alert_triggered", F.col("drift") | F.col("low_and_slow")).select(*counted.columns, *BEHAVIOR)


def decide(stateful: DataFrame, models: I.Models | None = None, settings: Settings = Settings()) -> DataFrame:
    """A verdict for every flow: behaviour, SYN flood, port scan, models.

    Without models no flow is asked twice and no Python runs here. With models, flows whose features break their contract keep
    the rules' verdict and are benign to the models.
    """
    kept = [*stateful.columns, "threat_class", "confidence", "anomaly_score", "top_features", "model_version"]
    limits = dict(min_syn=settings.min_syn, min_pps=settings.min_pps, min_ports=settings.min_ports, max_packets=settings.max_packets)
    if models is None:
        return R.decide_flows(stateful, None, [], **limits).select(*kept)
    named = C.model_row(stateful)
    fit = F.lit(True)
    for c in models.features:
        x = F.col(f"`{c}`").cast("double")
        fit = fit & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    safe = named.withColumns({c: F.when(fit, F.col(f"`{c}`").cast("double")).otherwise(F.lit(0.0)) for c in models.features}).withColumn("model_fit", fit)
    scored = I.score(safe, models)
    scored = scored.withColumn("rf_label", F.when(F.col("model_fit"), F.col("rf_label")).otherwise(F.lit(S.NORMAL_LABEL)))
    return R.decide_flows(scored, models.threshold, list(models.top), **limits).select(*kept)


def alerts_of(decided: DataFrame, settings: Settings = Settings(), *, chunk_rows: int | None = None) -> DataFrame:
    """Alerts of the flows that are not benign, without those that follow another of their source and class too soon."""
    hits = decided.where(F.col("threat_class") != S.BENIGN)
    first = A.suppress_repeats(hits, ["src_ip", "threat_class"], "timestamp", ["flow_id"], settings.dedup_seconds, chunk_rows=chunk_rows)
    return A.flow_alerts(first)


def detect(packets: DataFrame, models: I.Models | None = None, settings: Settings = Settings(), *, chunk_rows: int | None = None) -> DataFrame:
    """Packets to alerts in one plan.

    Three key changes, three shuffles of rows: the 5-tuple, the source (cardinalities and baseline share it), and the source
    with the threat class, which only rows of suspicion reach. Hot keys are cut into chunks in each of them.
    """
    flows = FL.flow_features(packets, settings.gap_seconds, chunk_rows=chunk_rows)
    return alerts_of(decide(with_state(flows, settings, chunk_rows=chunk_rows), models, settings), settings, chunk_rows=chunk_rows)
