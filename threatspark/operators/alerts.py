"""Alerts: severity, evidence, repetition, store queries and feed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatspark import schemas as S, skew

DNS_PROTOCOL, TLS_PROTOCOL = "DNS", "TLS"

# Which demo scenario a threat class belongs to.
SCENARIO_BY_THREAT = {
    S.PORT_SCAN: "port_scan",
    S.C2_BEACONING: "c2_beaconing",
    S.SYN_FLOOD: "syn_flood",
    S.DATA_EXFILTRATION: "data_exfiltration",
    S.DGA_DNS_TUNNELING: "dga_dns_tunneling",
    S.MALICIOUS_TLS: "malicious_tls",
}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def severity(threat: Column, confidence: Column) -> Column:
    return (
        F.when(threat == S.PORT_SCAN, "HIGH")
        .when(confidence >= 0.9, "HIGH")
        .when(confidence >= 0.7, "MEDIUM")
        .otherwise("LOW")
    )


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of the binary value, as ``printf`` writes it: a tie is one only if the double lies exactly between."""
    x = value.cast("double")
    pattern = "0." + "0" * digits if digits else "0"
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .otherwise(F.call_function("format_number", x, F.lit(pattern)))
    )


def percent(value: Column, digits: int) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def traffic_evidence() -> Column:
    return F.concat(
        F.col("packet_count").cast("string"),
        F.lit(" packets observed ("),
        F.col("byte_count").cast("string"),
        F.lit(" bytes total) over "),
        fixed(F.col("flow_duration") / 1_000_000, 2),
        F.lit("s, averaging "),
        fixed(F.col("avg_packet_size"), 1),
        F.lit(" bytes/packet"),
    )


def temporal_evidence() -> Column:
    mean_s, std_s = F.col("iat_mean") / 1_000_000, F.col("iat_std") / 1_000_000
    short = mean_s < 0.01

    def spoken(x: Column) -> Column:
        return F.when(short, F.concat(fixed(x * 1000, 2), F.lit("ms"))).otherwise(F.concat(fixed(x, 2), F.lit("s")))

    variation = F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean"))
    head = F.concat(F.lit("mean inter-arrival time = "), spoken(mean_s), F.lit(", std = "), spoken(std_s))
    regular = F.concat(
        head,
        F.lit(" ("),
        percent(variation, 1),
        F.lit(" of mean) — highly regular, consistent with periodic/automated behavior"),
    )
    return (
        F.when(F.col("packet_count") < 2, F.lit("single packet observed, no inter-arrival pattern available"))
        .when(variation < 0.05, regular)
        .otherwise(F.concat(head, F.lit(" — variable timing")))
    )


def ml_evidence() -> Column:
    return F.concat(
        F.lit("Model classified as "),
        F.col("threat_class"),
        F.lit(" (confidence "),
        percent(F.col("confidence"), 0),
        F.lit(", anomaly score "),
        fixed(F.col("anomaly_score"), 2),
        F.lit("). Top contributing features: "),
        F.array_join("top_features", ", "),
    )


def rule_evidence() -> Column:
    ports, targets = F.col("unique_dest_ports"), F.col("unique_destinations")
    syn, count = F.col("syn_count"), F.col("packet_count")
    notes = F.array(
        F.when(
            ports > 5, F.concat(F.lit("source contacted "), ports.cast("string"), F.lit(" unique destination ports"))
        ),
        F.when(
            (syn > 0) & (count > 0) & (syn / count > 0.9),
            F.concat(
                syn.cast("string"),
                F.lit(" of "),
                count.cast("string"),
                F.lit(" packets were SYN (no completed handshake observed)"),
            ),
        ),
        F.when(
            targets > 1,
            F.concat(
                F.lit("source contacted "), targets.cast("string"), F.lit(" unique destinations in this window")
            ),
        ),
    )
    found = F.array_compact(notes)
    return F.when(F.size(found) == 0, F.lit("no rule-based indicators triggered")).otherwise(
        F.array_join(found, "; ")
    )


def evidence(traffic: Column, temporal: Column, ml: Column, rule: Column) -> Column:
    return F.struct(traffic.alias("traffic"), temporal.alias("temporal"), ml.alias("ml"), rule.alias("rule"))


def alert_id(*parts: str) -> Column:
    """Stable id, so that replays write the same row again."""
    return F.concat(F.lit("a_"), F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts])))


def flow_alerts(classified: DataFrame) -> DataFrame:
    """Alert rows for all flows that are not benign."""
    hits = classified.where(F.col("threat_class") != S.BENIGN)
    return hits.select(
        alert_id("flow_id", "threat_class", "model_version").alias("alert_id"),
        "timestamp",
        "flow_id",
        "threat_class",
        severity(F.col("threat_class"), F.col("confidence")).alias("severity"),
        "confidence",
        "anomaly_score",
        evidence(traffic_evidence(), temporal_evidence(), ml_evidence(), rule_evidence()).alias("evidence"),
        "model_version",
    )


def record_flow_id(prefix: str, *columns: str) -> Column:
    return F.concat(
        F.lit(prefix), F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    )


def dns_alerts(verdicts: DataFrame) -> DataFrame:
    """Alerts from classified DNS queries (needs ``flow_id``)."""
    traffic = F.concat(
        F.lit("DNS query for "), F.col("domain"), F.lit(" ("), F.col("query_type"), F.lit(") from "), F.col("src_ip")
    )
    ml = F.concat(
        F.lit("DGA/tunneling detector flagged: "),
        F.col("reason"),
        F.lit(" (entropy="),
        fixed(F.col("entropy_score"), 2),
        F.lit(", ngram="),
        fixed(F.col("ngram_score"), 2),
        F.lit(")"),
    )
    return _record_alerts(verdicts, S.DGA_DNS_TUNNELING, S.DNS_VERSION, traffic, ml, F.lit(""))


def tls_alerts(verdicts: DataFrame) -> DataFrame:
    """Alerts from classified TLS sessions (needs ``flow_id``)."""
    traffic = F.concat(
        F.upper("transport"),
        F.lit(" "),
        F.col("role"),
        F.lit(" fingerprint "),
        F.col("fingerprint"),
        F.lit(" from "),
        F.col("src_ip"),
    )
    ml = F.concat(
        F.lit("JA3/JA3S fingerprint matched known-malicious blocklist entry "), F.col("matched_hash")
    )
    return _record_alerts(
        verdicts, S.MALICIOUS_TLS, S.TLS_VERSION, traffic, ml, F.lit("metadata-only match, no payload decrypted")
    )


def _record_alerts(
    verdicts: DataFrame, threat: str, version: str, traffic: Column, ml: Column, rule: Column
) -> DataFrame:
    rows = verdicts.where("flagged").withColumns({"threat_class": F.lit(threat), "model_version": F.lit(version)})
    return rows.select(
        alert_id("flow_id", "threat_class", "model_version").alias("alert_id"),
        "timestamp",
        "flow_id",
        "threat_class",
        severity(F.col("threat_class"), F.col("confidence")).alias("severity"),
        "confidence",
        F.col("confidence").alias("anomaly_score"),
        evidence(traffic, F.lit(""), ml, rule).alias("evidence"),
        "model_version",
    )


def suppress_repeats(
    hits: DataFrame,
    keys: list[str],
    time: str,
    seq: list[str],
    window_seconds: float = S.DEDUP_SECONDS,
    *,
    keep_suppressed: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Drop a hit that follows another hit of the same key by less than the window.

    A suppressed hit also restarts the window, so only the distance to the previous hit counts.
    """
    rows = hits.withColumn("_t", F.unix_micros(time))
    ch = skew.chunked(rows, keys, ["_t", *seq], chunk_rows=chunk_rows, settle=True)
    ch = skew.with_previous(ch, ["_t"])
    repeat = F.coalesce(F.col("_t") - F.col("prev__t") < int(round(window_seconds * 1_000_000)), F.lit(False))
    out = ch.done().withColumn("suppressed", repeat).drop("_t", "prev__t")
    return out if keep_suppressed else out.where(~F.col("suppressed")).drop("suppressed")


def with_flows(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Alerts with the identity columns of their flow, where one is stored."""
    identity = flows.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
    return alerts.join(identity, "flow_id", "left")


def newest(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    out = alerts.orderBy(F.desc("timestamp"), "alert_id")
    return out if limit is None else out.limit(limit)


def find(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.where(F.col(column) == F.lit(value))


def with_blanks_as_null(alerts: DataFrame) -> DataFrame:
    """Empty destination and zero ports become null on output."""
    return alerts.withColumns(
        {
            "dst_ip": F.nullif("dst_ip", F.lit("")),
            "src_port": F.nullif("src_port", F.lit(0).cast("long")),
            "dst_port": F.nullif("dst_port", F.lit(0).cast("long")),
        }
    )


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts in total, by class, by severity and by both, in one pass (grouping sets)."""
    sets = [[], ["threat_class"], ["severity"], ["threat_class", "severity"]]
    columns = [[F.col(c) for c in s] for s in sets]
    grouped = alerts.groupingSets(columns, F.col("threat_class"), F.col("severity"))
    return grouped.agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("alerts"),
    ).select(
        F.when(F.col("_level") == 3, "total")
        .when(F.col("_level") == 1, "class")
        .when(F.col("_level") == 2, "severity")
        .otherwise("class_severity")
        .alias("level"),
        "threat_class",
        "severity",
        "alerts",
    )


def store_totals(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Row counts of both stored tables."""
    return flows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("flows").alias("table_name"), "rows").unionByName(
        alerts.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("alerts").alias("table_name"), "rows")
    )


def top_severity_by_class(alerts: DataFrame) -> DataFrame:
    """Highest severity seen per class; classes with only unknown severities count as LOW."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
    name = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair[::-1]])
    best = alerts.groupBy("threat_class").agg(F.max(F.element_at(rank, F.col("severity"))).alias("_best"))
    return best.select("threat_class", F.coalesce(F.element_at(name, F.col("_best")), F.lit("LOW")).alias("severity"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity")).agg(
        F.count(F.lit(1)).alias("alerts")
    )


def of_scenario(alerts: DataFrame, scenario: str) -> DataFrame:
    """Alerts of one scenario; rows without one belong to the scenario of their class."""
    mapping = F.create_map(*[F.lit(x) for pair in SCENARIO_BY_THREAT.items() for x in pair])
    fallback = F.element_at(mapping, F.col("threat_class"))
    own = F.coalesce(F.col("scenario"), fallback) if "scenario" in alerts.columns else fallback
    return alerts.where(own == scenario)


def feed_filter(
    alerts: DataFrame, severity: str = "ALL", threat_class: str = "ALL", text: str = ""
) -> DataFrame:
    """Feed view: severity, class and free text over the identifying and evidence fields."""
    out = alerts
    if severity != "ALL":
        out = out.where(F.col("severity") == severity)
    if threat_class != "ALL":
        out = out.where(F.col("threat_class") == threat_class)
    needle = text.lower().strip()
    if needle:
        names = ("alert_id", "flow_id", "threat_class", "severity", "src_ip", "dst_ip", "protocol")
        fields = [F.col(n) for n in names] + [F.col("evidence")[f] for f in ("traffic", "temporal", "ml", "rule")]
        haystack = F.concat_ws(" ", *[F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in fields])
        out = out.where(F.contains(haystack, F.lit(needle)))
    return out


def is_behavioral(version: Column) -> Column:
    return F.startswith(F.coalesce(version, F.lit("")), F.lit("behavioral-exfil-"))


def with_evidence_json(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("evidence", F.to_json("evidence"))


def with_evidence_struct(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("evidence", F.from_json("evidence", S.EVIDENCE))


def latest(rows: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Keep the newest row per key. Partial aggregation keeps one row per key and task."""
    other = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*other), F.struct(*version)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in other]).select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows with the incoming ones on top; the incoming table wins on equal keys."""
    both = stored.withColumn("_version", F.lit(0)).unionByName(incoming.withColumn("_version", F.lit(1)))
    tie = [c for c in ("timestamp",) if c in stored.columns]
    return latest(both, key, ["_version", *tie]).drop("_version")
