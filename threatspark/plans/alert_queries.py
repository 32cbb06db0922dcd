"""Queries on alerts, their store and feed, and on the fusion of branch signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatspark import schemas as S
from threatspark.operators import alerts as A, flows as FL, fusion as FU
from threatspark.plans import adapters as D, flow_queries as Q
from threatspark.plans.registry import query, rounded
from threatspark.sources import sinks

AL = f"WITH {Q.RULE_SQL}"


def _classified(spark, path):
    return Q._classified(spark, path)


def _alerts(spark, path):
    return A.flow_alerts(_classified(spark, path))


def _stored(spark, path):
    """Alerts and the flows they refer to; the flows of one destination are not stored."""
    rows = _classified(spark, path)
    return A.flow_alerts(rows), FL.flow_table(rows).where(F.col("dst_ip") != "view")


_FIXED = "printf('%.{d}f', {x})"


def _fx(x, d):
    return f"printf('%.{d}f', CAST({x} AS DOUBLE))"


_TRAFFIC = f"packet_count || ' packets observed (' || byte_count || ' bytes total) over ' || {_fx('flow_duration / 1000000', 2)} || 's, averaging ' || {_fx('avg_packet_size', 1)} || ' bytes/packet'"
_SPOKEN = "CASE WHEN iat_mean / 1000000 < 0.01 THEN {ms} || 'ms' ELSE {s} || 's' END"
_MEAN = _SPOKEN.format(ms=_fx("iat_mean / 1000000 * 1000", 2), s=_fx("iat_mean / 1000000", 2))
_STD = _SPOKEN.format(ms=_fx("iat_std / 1000000 * 1000", 2), s=_fx("iat_std / 1000000", 2))
_HEAD = f"'mean inter-arrival time = ' || {_MEAN} || ', std = ' || {_STD}"
_TEMPORAL = f"""CASE WHEN packet_count < 2 THEN 'single packet observed, no inter-arrival pattern available'
  WHEN iat_mean > 0 AND iat_std / iat_mean < 0.05 THEN {_HEAD} || ' (' || {_fx('iat_std / iat_mean * 100', 1)} || '% of mean) — highly regular, consistent with periodic/automated behavior'
  ELSE {_HEAD} || ' — variable timing' END"""
_ML = f"""'Model classified as ' || threat_class || ' (confidence ' || {_fx('confidence * 100', 0)} || '%, anomaly score ' || {_fx('anomaly_score', 2)} || '). Top contributing features: ' || top_features"""
_RULE = """coalesce(nullif(concat_ws('; ', CASE WHEN unique_dest_ports > 5 THEN 'source contacted ' || unique_dest_ports || ' unique destination ports' END,
  CASE WHEN syn_count > 0 AND syn_count / packet_count > 0.9 THEN syn_count || ' of ' || packet_count || ' packets were SYN (no completed handshake observed)' END,
  CASE WHEN unique_destinations > 1 THEN 'source contacted ' || unique_destinations || ' unique destinations in this window' END), ''), 'no rule-based indicators triggered')"""


@query("flow_alerts", f"{AL} SELECT alert_id, last_us AS ts_us, flow_id, threat_class, severity, round(confidence, 6) AS confidence, round(anomaly_score, 6) AS anomaly_score, model_version FROM al")
def flow_alerts(spark, path):
    out = _alerts(spark, path).withColumn("ts_us", F.unix_micros("timestamp"))
    return rounded(out.drop("timestamp", "evidence"))


@query("alert_evidence", f"{AL} SELECT alert_id, {_TRAFFIC} AS traffic, {_TEMPORAL} AS temporal, {_RULE} AS rule FROM al")
def alert_evidence(spark, path):
    return _alerts(spark, path).select("alert_id", "evidence.traffic", "evidence.temporal", "evidence.rule")


@query("alert_model_evidence", f"{AL} SELECT threat_class, top_features, count(*) AS alerts, min(length({_ML})) > 60 AS worded FROM al GROUP BY 1, 2")
def alert_model_evidence(spark, path):
    rows = _classified(spark, path)
    texts = rows.where(F.col("threat_class") != S.BENIGN).select(
        "threat_class", F.array_join("top_features", ", ").alias("top_features"), F.length(A.ml_evidence()).alias("n")
    )
    return texts.groupBy("threat_class", "top_features").agg(
        F.count(F.lit(1)).alias("alerts"), (F.min("n") > 60).alias("worded")
    )


@query("evidence_json", f"{AL} SELECT alert_id, {_TRAFFIC} AS traffic FROM al")
def evidence_json(spark, path):
    """Evidence as JSON text at the store boundary and back."""
    stored = A.with_evidence_json(_alerts(spark, path))
    return A.with_evidence_struct(stored).select("alert_id", "evidence.traffic")


_HITS = f"""h AS (SELECT event_id, user_id, event_type, epoch_us(ts) // {D.DEDUP_SCALE} AS t FROM events WHERE event_type <> 'view'),
  s AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) < 10000000, false) AS suppressed FROM h)"""


@query("repeated_alerts", f"WITH {_HITS} SELECT event_id, suppressed FROM s")
def repeated_alerts(spark, path):
    hits = D.events(spark, path, D.DEDUP_SCALE).where(F.col("event_type") != "view")
    out = A.suppress_repeats(hits, ["user_id", "event_type"], "timestamp", ["event_id"], keep_suppressed=True)
    return out.select("event_id", "suppressed")


@query("first_alerts", f"WITH {_HITS} SELECT event_type, count(*) AS alerts FROM s WHERE NOT suppressed GROUP BY 1")
def first_alerts(spark, path):
    hits = D.events(spark, path, D.DEDUP_SCALE).where(F.col("event_type") != "view")
    kept = A.suppress_repeats(hits, ["user_id", "event_type"], "timestamp", ["event_id"])
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("alerts"))


_JOINED = """jn AS (SELECT al.alert_id, al.flow_id, al.last_us AS ts_us, al.threat_class, al.severity, al.confidence, coalesce(f.src_ip, '') AS src_ip, coalesce(f.dst_ip, '') AS dst_ip,
  coalesce(f.dst_port, -1) AS dst_port FROM al LEFT JOIN (SELECT * FROM fl WHERE dst_ip <> 'view') f ON f.flow_id = al.flow_id)"""


def _joined(spark, path):
    alerts, flows = _stored(spark, path)
    return A.with_flows(alerts, flows)


def _flat(df):
    return df.select(
        "alert_id",
        "flow_id",
        F.unix_micros("timestamp").alias("ts_us"),
        "threat_class",
        "severity",
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        F.coalesce("dst_port", F.lit(-1)).alias("dst_port"),
    )


_FLAT = "alert_id, flow_id, ts_us, threat_class, severity, src_ip, dst_ip, dst_port"


@query("alerts_with_flows", f"{AL}, {_JOINED} SELECT {_FLAT} FROM jn")
def alerts_with_flows(spark, path):
    return _flat(_joined(spark, path))


@query("newest_alerts", f"{AL}, {_JOINED} SELECT {_FLAT} FROM jn ORDER BY ts_us DESC, alert_id LIMIT 20")
def newest_alerts(spark, path):
    return _flat(A.newest(_joined(spark, path), 20))


@query("first_screen_alerts", f"{AL}, {_JOINED} SELECT {_FLAT} FROM jn ORDER BY ts_us DESC, alert_id LIMIT 5")
def first_screen_alerts(spark, path):
    return _flat(A.newest(_joined(spark, path), 5))


@query("alerts_of_flow", f"{AL}, {_JOINED} SELECT {_FLAT} FROM jn WHERE flow_id = (SELECT min(flow_id) FROM fl WHERE dst_ip = 'click' AND unique_marker) ".replace("AND unique_marker", "AND src_ip = 'h1'"))
def alerts_of_flow(spark, path):
    first = Q._flows(spark, path).where("dst_ip = 'click' and src_ip = 'h1'").agg(F.min("flow_id")).scalar()
    return _flat(_joined(spark, path).where(F.col("flow_id") == first))


@query("blank_destinations", f"WITH {D.QUERIES_SQL} SELECT src_ip, count(*) AS flows, count(*) AS without_destination, count(*) AS without_port FROM dq GROUP BY 1")
def blank_destinations(spark, path):
    rows = D.dns_queries(spark, path).withColumn("flow_id", F.col("seq").cast("string"))
    shown = A.with_blanks_as_null(FL.metadata_flows(rows, A.DNS_PROTOCOL, 53))
    return shown.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("dst_ip").isNull()).alias("without_destination"),
        F.count_if(F.col("src_port").isNull()).alias("without_port"),
    )


@query(
    "alert_stats",
    f"""{AL} SELECT CASE WHEN grouping(threat_class) = 1 AND grouping(severity) = 1 THEN 'total' WHEN grouping(severity) = 1 THEN 'class'
      WHEN grouping(threat_class) = 1 THEN 'severity' ELSE 'class_severity' END AS level, coalesce(threat_class, '') AS threat_class, coalesce(severity, '') AS severity, count(*) AS alerts
    FROM al GROUP BY GROUPING SETS ((), (threat_class), (severity), (threat_class, severity))""",
)
def alert_stats(spark, path):
    out = A.alert_stats(_alerts(spark, path))
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("threat_class", "severity")})


@query("store_totals", f"{AL} SELECT 'flows' AS table_name, count(*) AS rows FROM fl WHERE dst_ip <> 'view' UNION ALL SELECT 'alerts', count(*) FROM al")
def store_totals(spark, path):
    alerts, flows = _stored(spark, path)
    return A.store_totals(flows, alerts)


@query("class_top_severity", f"{AL} SELECT threat_class, CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM al GROUP BY 1")
def class_top_severity(spark, path):
    return A.top_severity_by_class(_alerts(spark, path))


@query("severity_counts", f"{AL} SELECT severity, count(*) AS alerts FROM al GROUP BY 1")
def severity_counts(spark, path):
    return A.severity_counts(_alerts(spark, path))


@query("scenario_alerts", f"{AL} SELECT alert_id FROM al WHERE threat_class = 'SYN_FLOOD'")
def scenario_alerts(spark, path):
    return A.of_scenario(_alerts(spark, path), "syn_flood").select("alert_id")


@query("feed_search", f"{AL}, {_JOINED}, e AS (SELECT jn.*, {_TRAFFIC} AS traffic FROM jn JOIN (SELECT flow_id, packet_count, byte_count, flow_duration, avg_packet_size FROM fl) USING (flow_id)) SELECT {_FLAT} FROM e WHERE severity = 'HIGH' AND threat_class = 'PORT_SCAN' AND contains(traffic, '120 bytes')")
def feed_search(spark, path):
    return _flat(A.feed_filter(_joined(spark, path), "HIGH", "PORT_SCAN", " 120 BYTES "))


@query("behavioral_alerts", f"WITH {D.RUNNING_SQL}, {Q._MODEL_SQL} SELECT flow_id, alert_triggered AS behavioral FROM mi")
def behavioral_alerts(spark, path):
    from threatspark.operators import rules as R

    rows = Q._model_inputs(Q._running(spark, path))
    out = R.decide_flows(rows, -0.447, ["Flow Duration"], max_packets=1, **Q.SYN)
    return out.select("flow_id", A.is_behavioral(F.col("model_version")).alias("behavioral"))


@query(
    "merged_feeds",
    f"""{AL}, two AS (SELECT alert_id, last_us AS ts_us, severity, 0 AS v FROM al UNION ALL SELECT alert_id, last_us, 'SEEN', 1 FROM al WHERE threat_class = 'SYN_FLOOD')
    SELECT alert_id, ts_us, severity FROM two QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY v DESC) = 1""",
)
def merged_feeds(spark, path):
    alerts = _alerts(spark, path)
    fresh = alerts.where("threat_class = 'SYN_FLOOD'").withColumn("severity", F.lit("SEEN"))
    out = A.upsert(alerts, fresh, "alert_id")
    return out.select("alert_id", F.unix_micros("timestamp").alias("ts_us"), "severity")


@query("feed_messages", f"{AL} SELECT alert_id AS key, 'alert' AS type, threat_class FROM al")
def feed_messages(spark, path):
    out = sinks.feed_messages(_alerts(spark, path))
    return out.select(
        "key",
        F.get_json_object("value", "$.type").alias("type"),
        F.get_json_object("value", "$.alert.threat_class").alias("threat_class"),
    )


# --- fusion ---------------------------------------------------------------------------------------------------
_PRESENT = ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE signal_type = '{t}') OVER w - count(*) FILTER (WHERE signal_type = '{t}') OVER p > 0 THEN '{t}' END"
    for t in S.SIGNAL_TYPES
)
_CATS = f"""WITH RECURSIVE {D.SIGNALS_SQL.strip()},
  ct AS (SELECT *, concat_ws(',', {_PRESENT}) AS signals FROM sg
    WINDOW w AS (PARTITION BY source_ip ORDER BY t RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW),
           p AS (PARTITION BY source_ip, t ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  mn AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY t, seq) AS rn FROM ct WHERE contains(signals, ',')),
  es AS (SELECT source_ip, seq, t, rn, t AS last, true AS hit FROM mn WHERE rn = 1
    UNION ALL SELECT mn.source_ip, mn.seq, mn.t, mn.rn, CASE WHEN mn.t - es.last >= 60000000 THEN mn.t ELSE es.last END, mn.t - es.last >= 60000000
    FROM es JOIN mn ON mn.source_ip = es.source_ip AND mn.rn = es.rn + 1),
  oc AS (SELECT ct.*, CASE WHEN NOT contains(signals, ',') THEN 'LOW' WHEN es.hit THEN 'HIGH' ELSE 'SUPPRESSED' END AS severity
    FROM ct LEFT JOIN es ON es.source_ip = ct.source_ip AND es.seq = ct.seq)"""


@query("signal_categories", f"{_CATS} SELECT source_ip, seq, signals FROM ct")
def signal_categories(spark, path):
    rows = FU.categories(D.signals(spark, path))
    return rows.select("source_ip", "seq", F.concat_ws(",", "signals").alias("signals"))


@query("fusion_outcome", f"{_CATS} SELECT source_ip, seq, t AS ts_us, severity, CASE severity WHEN 'LOW' THEN signal_type || '_DETECTION' ELSE 'DATA_EXFILTRATION' END AS alert_type, signals, flow_id FROM oc")
def fusion_outcome(spark, path):
    rows = FU.fuse(D.signals(spark, path), keep_suppressed=True)
    return rows.select(
        "source_ip", "seq", F.unix_micros("ts").alias("ts_us"), "severity", "alert_type", F.concat_ws(",", "signals").alias("signals"), "flow_id"
    )


@query(
    "fusion_alert_entries",
    f"""{_CATS} SELECT oc.source_ip, oc.seq AS alert_seq, 'LOW' AS severity, oc.seq AS entry_seq, oc.signal_type, oc.flow_id FROM oc WHERE severity = 'LOW'
    UNION ALL SELECT oc.source_ip, oc.seq, 'HIGH', e.seq, e.signal_type, e.flow_id FROM oc JOIN sg e ON e.source_ip = oc.source_ip AND e.t >= oc.t - 60000000
      AND (e.t < oc.t OR (e.t = oc.t AND e.seq <= oc.seq)) WHERE severity = 'HIGH'""",
)
def fusion_alert_entries(spark, path):
    signals = D.signals(spark, path)
    return FU.alert_entries(FU.fuse(signals), signals).drop("alert_ts")


@query("fusion_summary", f"{_CATS} SELECT 'alerts_' || lower(severity) AS item, count(*) AS rows FROM oc WHERE severity <> 'SUPPRESSED' GROUP BY 1 UNION ALL SELECT 'near_misses', count(*) FROM events WHERE event_type = 'error' AND round(value) % 7 <> 0 AND -0.40 - round(value) % 100 / 1000 >= -0.447")
def fusion_summary(spark, path):
    _, near, _ = FU.ml_gate(_scored_flows(spark, path), -0.447)
    return FU.run_summary(FU.fuse(D.signals(spark, path)), near)


def _scored_flows(spark, path):
    label = (
        F.when(F.col("event_type") == "error", "Bots")
        .when(F.col("event_type") == "click", "DDoS")
        .when(F.col("event_type") == "signup", "Port Scanning")
        .when(F.col("event_type") == "view", "Unheard Of")
        .otherwise("Normal Traffic")
    )
    score = F.lit(-0.40) - F.round("value") % 100 / 1000
    return D.events(spark, path, D.FUSION_SCALE).select(
        F.col("user_id").cast("string").alias("source_ip"),
        "timestamp",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("flow_id"),
        label.alias("rf_threat_class"),
        F.lit(0.9).alias("rf_confidence"),
        F.when(F.round("value") % 7 != 0, score).alias("iforest_raw_score"),
    )


_GATE = """g AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'Bots' WHEN 'click' THEN 'DDoS' WHEN 'signup' THEN 'Port Scanning' WHEN 'view' THEN 'Unheard Of' ELSE 'Normal Traffic' END AS c,
    CASE WHEN round(value) % 7 <> 0 THEN -0.40 - round(value) % 100 / 1000 END AS s FROM events)"""


@query(
    "model_branch_gate",
    f"""WITH {_GATE} SELECT seq, CASE WHEN c = 'Unheard Of' THEN 'rejected' WHEN c = 'Bots' AND s IS NULL THEN 'rejected' WHEN c = 'Bots' AND s >= -0.447 THEN 'near_miss' ELSE 'signal' END AS outcome,
      c AS rf_threat_class FROM g WHERE c <> 'Normal Traffic'""",
)
def model_branch_gate(spark, path):
    signals, near, rejected = FU.ml_gate(_scored_flows(spark, path), -0.447)
    label = F.get_json_object("evidence", "$.rf_threat_class").alias("rf_threat_class")
    seq = F.substring("flow_id", 3, 20).cast("long").alias("seq")
    return (
        signals.select("seq", F.lit("signal").alias("outcome"), label)
        .unionByName(near.select(seq, F.lit("near_miss").alias("outcome"), F.col("detail.rf_threat_class").alias("rf_threat_class")))
        .unionByName(rejected.select("seq", F.lit("rejected").alias("outcome"), "rf_threat_class"))
    )


@query(
    "branch_signals",
    f"""WITH {_GATE}, e AS (SELECT * FROM events)
    SELECT 'ML_BRANCH_SIGNAL' AS signal_type, CASE WHEN c = 'Bots' THEN 'Bots (RF) corroborated by Isolation Forest' ELSE c || ' (RF)' END AS detail, count(*) AS signals FROM g
      WHERE c IN ('DDoS', 'Port Scanning') OR (c = 'Bots' AND s < -0.447) GROUP BY 2
    UNION ALL SELECT 'DNS_BRANCH_SIGNAL', 'DGA on domain ' || event_type || '.com', count(*) FROM e WHERE event_type = 'signup' GROUP BY event_type
    UNION ALL SELECT 'TLS_BRANCH_SIGNAL', CASE WHEN value > 50 THEN 'JA3 match (family)' ELSE 'JA3 match (unknown family)' END, count(*) FROM e WHERE event_type = 'purchase' GROUP BY 2
    UNION ALL SELECT 'BEHAVIORAL_SIGNAL', CASE WHEN event_type = 'click' THEN 'volume baseline drift (z=4.50)' ELSE 'volume baseline drift (z=4.50) + low-and-slow (duration=5000s, pps=0.80)' END, count(*) FROM e WHERE event_type IN ('click', 'view') GROUP BY 2""",
)
def branch_signals(spark, path):
    """All four branches through their gates into one signal table."""
    rows = D.events(spark, path, D.FUSION_SCALE).select(
        F.col("user_id").cast("string").alias("source_ip"),
        "timestamp",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("flow_id"),
        "event_type",
        "value",
    )
    kind = F.col("event_type")
    dns = rows.select("*", F.concat(kind, F.lit(".com")).alias("domain"), F.when(kind == "signup", "DGA").alias("dns_flag"))
    tls = rows.select(
        "*",
        (kind == "purchase").alias("ja3_match"),
        F.lit("0" * 32).alias("ja3_hash"),
        F.when(F.col("value") > 50, "family").alias("matched_signature"),
    )
    slow = kind == "view"
    behavior = rows.select(
        "*",
        kind.isin("click", "view").alias("alert_triggered"),
        F.lit(True).alias("drift"),
        F.lit(4.5).alias("z_score"),
        slow.alias("low_and_slow"),
        F.lit(5000.0).alias("flow_duration"),
        F.lit(0.8).alias("pps"),
        F.struct(F.lit(4.5).alias("z")).alias("metrics"),
        F.lit("d").alias("dest_ip"),
    )
    ml, _, _ = FU.ml_gate(_scored_flows(spark, path), -0.447)
    merged = FU.merge_signals(ml, FU.dns_gate(dns), FU.tls_gate(tls), FU.behavior_gate(behavior))
    return merged.groupBy("signal_type", "detail").agg(F.count(F.lit(1)).alias("signals"))


@query(
    "fusion_listing",
    f"{_CATS}, {_GATE.replace('g AS', 'gg AS', 1)} SELECT 'high_alert' AS kind, seq, replace(signals, ',', ', ') AS text FROM oc WHERE severity = 'HIGH' UNION ALL SELECT 'near_miss', seq, 'anomaly score did not corroborate the rare class' FROM gg WHERE c = 'Bots' AND s >= -0.447",
)
def fusion_listing(spark, path):
    _, near, _ = FU.ml_gate(_scored_flows(spark, path), -0.447)
    out = FU.run_listing(FU.fuse(D.signals(spark, path)), near)
    return out.select("kind", F.substring("flow_id", 3, 20).cast("long").alias("seq"), "text")
