"""Flow classifiers: deterministic rules and the order in which branch verdicts apply.

Every verdict is a struct ``(threat_class, confidence, anomaly_score, top_features, model_version)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatspark import schemas as S

CEILING = 0.99


def verdict(threat: str | Column, confidence: Column, score: Column, features: Column, version: str) -> Column:
    return F.struct(
        (F.lit(threat) if isinstance(threat, str) else threat).alias("threat_class"),
        confidence.cast("double").alias("confidence"),
        score.cast("double").alias("anomaly_score"),
        features.alias("top_features"),
        F.lit(version).alias("model_version"),
    )


def _capped(value: Column) -> Column:
    return F.least(F.lit(CEILING), value)


def _names(*features: str) -> Column:
    return F.array(*[F.lit(f) for f in features])


def syn_flood_rule(min_syn: int = 20, min_pps: float = 100.0, version: str = S.MODEL_VERSION + "+syn-rule") -> Column:
    """TCP flows with many SYN packets at a high rate; null where the rule does not apply."""
    syn, pps = F.col("syn_count"), F.col("packets_per_second")
    hit = (F.upper("protocol") == "TCP") & (syn >= min_syn) & (pps >= min_pps)
    confidence = _capped(F.lit(0.80) + F.least(syn / 1000, F.lit(0.19)))
    score = _capped(F.lit(0.80) + F.least(pps / 10000, F.lit(0.19)))
    return F.when(
        hit, verdict(S.SYN_FLOOD, confidence, score, _names("syn_count", "packets_per_second"), version)
    )


def port_scan_rule(min_ports: int = 10, max_packets: int = 5, version: str = S.MODEL_VERSION) -> Column:
    """Sources that touched many ports with short flows."""
    ports = F.col("unique_dest_ports")
    hit = (ports >= min_ports) & (F.col("packet_count") <= max_packets)
    confidence, score = _capped(F.lit(0.6) + ports / 100), _capped(ports / 50)
    return F.when(
        hit, verdict(S.PORT_SCAN, confidence, score, _names("unique_dest_ports", "packet_count"), version)
    )


def _syn_ratio_rule(min_ratio: float, min_pps: float, version: str) -> Column:
    pps = F.col("packets_per_second")
    ratio = F.when(F.col("packet_count") > 0, F.col("syn_count") / F.col("packet_count")).otherwise(F.lit(0.0))
    hit = (ratio > min_ratio) & (pps > min_pps)
    confidence, score = _capped(F.lit(0.7) + ratio * 0.3), _capped(pps / 500)
    return F.when(
        hit, verdict(S.SYN_FLOOD, confidence, score, _names("syn_count", "packets_per_second"), version)
    )


def _beacon_rule(min_iat_us: float, min_packets: int, max_variation: float, version: str) -> Column:
    mean = F.col("iat_mean")
    variation = F.when(mean > 0, F.col("iat_std") / mean)
    hit = (mean > min_iat_us) & (F.col("packet_count") >= min_packets) & (variation < max_variation)
    regular = _capped(F.lit(0.9) - variation)
    return F.when(hit, verdict(S.C2_BEACONING, regular, regular, _names("iat_std", "iat_mean"), version))


def classify_by_rules(
    features: DataFrame,
    *,
    min_syn_ratio: float = 0.9,
    min_pps: float = 50.0,
    min_ports: int = 10,
    max_packets: int = 5,
    min_iat_us: float = 1_000_000.0,
    min_packets: int = 3,
    max_variation: float = 0.05,
    version: str = S.RULE_VERSION,
) -> DataFrame:
    """Model-free classifier: SYN ratio, then port scan, then beaconing, else benign."""
    quiet = verdict(S.BENIGN, F.lit(0.85), F.lit(0.1), _names("packet_count"), version)
    chosen = F.coalesce(
        _syn_ratio_rule(min_syn_ratio, min_pps, version),
        port_scan_rule(min_ports, max_packets, version),
        _beacon_rule(min_iat_us, min_packets, max_variation, version),
        quiet,
    )
    return _unpack(features, chosen)


def model_verdict(threshold: float, top_features: list[str], version: str = S.MODEL_VERSION) -> Column:
    """Verdict from the supervised label and the raw anomaly score of the flow.

    The rare class counts only if the anomaly score does not lie above the threshold.
    """
    from threatspark.functions.numeric import anomaly_probability

    mapping = F.create_map(*[F.lit(x) for pair in S.LABEL_TO_THREAT.items() for x in pair])
    mapped = F.coalesce(F.element_at(mapping, F.col("rf_label")), F.lit(S.BENIGN))
    gated = (F.col("rf_label") == S.BOTS_LABEL) & (F.col("raw_anomaly") > threshold)
    threat = F.when(gated, F.lit(S.BENIGN)).otherwise(mapped)
    return verdict(
        threat,
        F.col("rf_confidence"),
        anomaly_probability(F.col("raw_anomaly"), threshold),
        _names(*top_features),
        version,
    )


def behavior_verdict(flag: Column, version: str = S.BEHAVIOR_VERSION) -> Column:
    return F.when(
        flag, verdict(S.DATA_EXFILTRATION, F.lit(0.0), F.lit(1.0), _names("outbound_behavior"), version)
    )


def decide_flows(
    scored: DataFrame,
    threshold: float | None,
    top_features: list[str],
    *,
    behavior_flag: str = "alert_triggered",
    min_syn: int = 20,
    min_pps: float = 100.0,
    min_ports: int = 10,
    max_packets: int = 5,
) -> DataFrame:
    """Full decision order: outbound behaviour, SYN flood, port scan, then the models.

    Without a threshold no model is asked, and what no rule names is benign.
    """
    quiet = verdict(S.BENIGN, F.lit(0.0), F.lit(0.0), F.array().cast("array<string>"), S.MODEL_VERSION)
    chosen = F.coalesce(
        behavior_verdict(F.col(behavior_flag)),
        syn_flood_rule(min_syn, min_pps),
        port_scan_rule(min_ports, max_packets),
        quiet if threshold is None else model_verdict(threshold, top_features),
    )
    return _unpack(scored, chosen)


def _unpack(df: DataFrame, chosen: Column) -> DataFrame:
    fields = ("threat_class", "confidence", "anomaly_score", "top_features", "model_version")
    return (
        df.withColumn("_verdict", chosen)
        .select(*df.columns, *[F.col("_verdict")[f].alias(f) for f in fields])
    )
