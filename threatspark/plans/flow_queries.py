"""Queries on packets, flows and flow verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatspark.operators import alerts as A, cleaning, flows as FL, profiling as P, rules as R
from threatspark.plans import adapters as D
from threatspark.plans.registry import query, rounded

RULES = dict(min_syn_ratio=0.9, min_pps=0.5, min_ports=10, max_packets=1, max_variation=0.35)
SYN = dict(min_syn=2, min_pps=0.5)

FEATURES = """flow_id, src_ip, dst_ip, src_port, dst_port, protocol, flow_start_us, last_us, packet_count, byte_count,
  flow_duration, round(packets_per_second, 6) AS packets_per_second, round(avg_packet_size, 6) AS avg_packet_size,
  round(iat_mean, 3) AS iat_mean, round(iat_std, 3) AS iat_std, syn_count,
  round(flow_bytes_per_second, 6) AS flow_bytes_per_second, fwd_packet_length_min"""


def _packets(spark, path):
    return D.packets(spark, path)


def _flows(spark, path):
    return FL.flow_features(_packets(spark, path))


def _running(spark, path):
    return FL.with_running_cardinalities(_flows(spark, path))


def _classified(spark, path):
    return R.classify_by_rules(_running(spark, path), **RULES)


def _tidy(df):
    return rounded(df.drop("timestamp"), iat_mean=3, iat_std=3)


@query(
    "packet_sessions",
    f"WITH {D.FLOWS_SQL} SELECT src_ip, dst_ip, dst_port, t_us AS ts_us, flow_start_us, coalesce(gap_us, -1) AS gap_us, packet_size AS bytes FROM fs",
)
def packet_sessions(spark, path):
    rows = FL.sessionize(_packets(spark, path))
    gap = F.coalesce("gap_us", F.lit(-1)).alias("gap_us")
    return rows.select("src_ip", "dst_ip", "dst_port", "ts_us", "flow_start_us", gap, "bytes")


@query("flow_features", f"WITH {D.FLOWS_SQL} SELECT {FEATURES} FROM fl")
def flow_features(spark, path):
    return _tidy(_flows(spark, path))


@query(
    "source_cardinalities",
    f"""WITH {D.FLOWS_SQL} SELECT src_ip, count(DISTINCT dst_ip) AS unique_destinations,
    count(DISTINCT dst_port) AS unique_dest_ports FROM fl GROUP BY src_ip""",
)
def source_cardinalities(spark, path):
    return FL.source_cardinalities(_flows(spark, path))


@query(
    "flows_with_source_cardinalities",
    f"""WITH {D.FLOWS_SQL}, sc AS (SELECT src_ip, count(DISTINCT dst_ip) AS unique_destinations,
    count(DISTINCT dst_port) AS unique_dest_ports FROM fl GROUP BY src_ip)
    SELECT flow_id, unique_destinations, unique_dest_ports FROM fl JOIN sc USING (src_ip)""",
)
def flows_with_source_cardinalities(spark, path):
    return FL.with_batch_cardinalities(_flows(spark, path)).select(
        "flow_id", "unique_destinations", "unique_dest_ports"
    )


@query("flows_with_running_cardinalities", f"WITH {D.RUNNING_SQL} SELECT flow_id, unique_destinations, unique_dest_ports FROM rc")
def flows_with_running_cardinalities(spark, path):
    return _running(spark, path).select("flow_id", "unique_destinations", "unique_dest_ports")


@query("open_flows", f"WITH {D.FLOWS_SQL} SELECT flow_id, last_us FROM fl WHERE last_us >= (SELECT max(last_us) FROM fl) - 5000000")
def open_flows(spark, path):
    return FL.open_flows(_flows(spark, path)).select("flow_id", "last_us")


@query("open_flow_count", f"WITH {D.FLOWS_SQL} SELECT count(*) AS open_flows FROM fl WHERE last_us >= (SELECT max(last_us) FROM fl) - 5000000")
def open_flow_count(spark, path):
    return FL.open_flows(_flows(spark, path)).agg(F.count(F.lit(1)).alias("open_flows"))


@query("flow_by_key", f"WITH {D.FLOWS_SQL} SELECT flow_id, packet_count, byte_count FROM fl WHERE src_ip = 'h3' AND dst_ip = 'error' AND dst_port = 7")
def flow_by_key(spark, path):
    found = FL.find_flow(_flows(spark, path), "h3", "error", 40000, 7, "TCP")
    return found.select("flow_id", "packet_count", "byte_count")


@query(
    "flow_rate",
    f"""WITH {D.FLOWS_SQL}, w AS (
      SELECT (last_us // 1000000 - k) * 1000000 AS window_start_us FROM fl, (SELECT unnest(range(5)) AS k))
    SELECT window_start_us, count(*) AS events, round(count(*) / 5.0, 1) AS per_second FROM w GROUP BY 1""",
)
def flow_rate(spark, path):
    rate = FL.event_rate(_flows(spark, path))
    return rate.select(F.unix_micros("window_start").alias("window_start_us"), "events", "per_second")


@query(
    "last_hundred_mean",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id
       ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS last_n_mean FROM events""",
)
def last_hundred_mean(spark, path):
    rows = D.events(spark, path)
    return rounded(FL.last_n_mean(rows, ["event_type"], ["t_us", "event_id"], "value").select("event_id", "last_n_mean"), 9)


_RATIO = "CASE WHEN packet_count > 0 THEN syn_count / packet_count ELSE 0.0 END"
_VERDICT_SQL = f"""{D.RUNNING_SQL},
cv AS (
  SELECT *, {_RATIO} AS syn_ratio, CASE WHEN iat_mean > 0 THEN iat_std / iat_mean END AS variation FROM rc),
rv AS (
  SELECT *, CASE WHEN syn_ratio > 0.9 AND packets_per_second > 0.5 THEN 'SYN_FLOOD'
      WHEN unique_dest_ports >= 10 AND packet_count <= 1 THEN 'PORT_SCAN'
      WHEN iat_mean > 1000000 AND packet_count >= 3 AND variation < 0.35 THEN 'C2_BEACONING' ELSE 'BENIGN' END AS threat_class
  FROM cv),
ru AS (
  SELECT *, CASE threat_class WHEN 'SYN_FLOOD' THEN least(0.99, 0.7 + syn_ratio * 0.3)
      WHEN 'PORT_SCAN' THEN least(0.99, 0.6 + unique_dest_ports / 100) WHEN 'C2_BEACONING' THEN least(0.99, 0.9 - variation) ELSE 0.85 END AS confidence,
    CASE threat_class WHEN 'SYN_FLOOD' THEN least(0.99, packets_per_second / 500)
      WHEN 'PORT_SCAN' THEN least(0.99, unique_dest_ports / 50) WHEN 'C2_BEACONING' THEN least(0.99, 0.9 - variation) ELSE 0.1 END AS anomaly_score,
    CASE threat_class WHEN 'SYN_FLOOD' THEN 'syn_count, packets_per_second' WHEN 'PORT_SCAN' THEN 'unique_dest_ports, packet_count'
      WHEN 'C2_BEACONING' THEN 'iat_std, iat_mean' ELSE 'packet_count' END AS top_features,
    'mock-v0' AS model_version
  FROM rv)"""
_SEVERITY = """CASE WHEN threat_class = 'PORT_SCAN' THEN 'HIGH' WHEN confidence >= 0.9 THEN 'HIGH'
      WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END"""
RULE_SQL = f"{_VERDICT_SQL}, al AS (SELECT 'a_' || md5(flow_id || '|' || threat_class || '|' || model_version) AS alert_id, *, {_SEVERITY} AS severity FROM ru WHERE threat_class <> 'BENIGN')"


@query(
    "rule_verdicts",
    f"WITH {_VERDICT_SQL} SELECT flow_id, threat_class, round(confidence, 6) AS confidence, round(anomaly_score, 6) AS anomaly_score, top_features, model_version FROM ru",
)
def rule_verdicts(spark, path):
    out = _classified(spark, path).select(
        "flow_id",
        "threat_class",
        "confidence",
        "anomaly_score",
        F.array_join("top_features", ", ").alias("top_features"),
        "model_version",
    )
    return rounded(out)


@query(
    "syn_flood_verdicts",
    f"""WITH {D.RUNNING_SQL} SELECT flow_id, round(least(0.99, 0.80 + least(syn_count / 1000, 0.19)), 6) AS confidence,
    round(least(0.99, 0.80 + least(packets_per_second / 10000, 0.19)), 6) AS anomaly_score, 'rf-if-v3+syn-rule' AS model_version
    FROM rc WHERE upper(protocol) = 'TCP' AND syn_count >= 2 AND packets_per_second >= 0.5""",
)
def syn_flood_verdicts(spark, path):
    rows = _running(spark, path).withColumn("v", R.syn_flood_rule(**SYN)).where("v is not null")
    return rounded(rows.select("flow_id", "v.confidence", "v.anomaly_score", "v.model_version"))


@query(
    "port_scan_verdicts",
    f"""WITH {D.RUNNING_SQL} SELECT flow_id, round(least(0.99, 0.6 + unique_dest_ports / 100), 6) AS confidence,
    round(least(0.99, unique_dest_ports / 50), 6) AS anomaly_score FROM rc WHERE unique_dest_ports >= 10 AND packet_count <= 5""",
)
def port_scan_verdicts(spark, path):
    rows = _running(spark, path).withColumn("v", R.port_scan_rule()).where("v is not null")
    return rounded(rows.select("flow_id", "v.confidence", "v.anomaly_score"))


_MODEL_SQL = """mi AS (
  SELECT *, CASE dst_ip WHEN 'error' THEN 'Bots' WHEN 'click' THEN 'DDoS' WHEN 'signup' THEN 'Port Scanning' WHEN 'view' THEN 'Unknown' ELSE 'Normal Traffic' END AS rf_label,
    0.5 + (byte_count % 50) / 100 AS rf_confidence, -0.40 - (byte_count % 100) / 1000 AS raw_anomaly, byte_count > 400 AS alert_triggered
  FROM rc)"""


def _model_inputs(df):
    label = (
        F.when(F.col("dst_ip") == "error", "Bots")
        .when(F.col("dst_ip") == "click", "DDoS")
        .when(F.col("dst_ip") == "signup", "Port Scanning")
        .when(F.col("dst_ip") == "view", "Unknown")
        .otherwise("Normal Traffic")
    )
    return df.withColumns(
        {
            "rf_label": label,
            "rf_confidence": F.lit(0.5) + (F.col("byte_count") % 50) / 100,
            "raw_anomaly": F.lit(-0.40) - (F.col("byte_count") % 100) / 1000,
            "alert_triggered": F.col("byte_count") > 400,
        }
    )


_MODEL_CLASS = """CASE rf_label WHEN 'Port Scanning' THEN 'PORT_SCAN' WHEN 'DDoS' THEN 'SYN_FLOOD'
   WHEN 'Bots' THEN CASE WHEN raw_anomaly > -0.447 THEN 'BENIGN' ELSE 'C2_BEACONING' END ELSE 'BENIGN' END"""


@query(
    "gated_model_verdicts",
    f"""WITH {D.RUNNING_SQL}, {_MODEL_SQL} SELECT flow_id, {_MODEL_CLASS} AS threat_class, round(rf_confidence, 6) AS confidence,
    round(1 / (1 + exp(-((-0.447 - raw_anomaly) / 0.05))), 6) AS anomaly_score FROM mi""",
)
def gated_model_verdicts(spark, path):
    rows = _model_inputs(_running(spark, path)).withColumn("v", R.model_verdict(-0.447, ["Flow Duration", "Flow IAT Std"]))
    return rounded(rows.select("flow_id", "v.threat_class", "v.confidence", "v.anomaly_score"))


@query(
    "flow_decisions",
    f"""WITH {D.RUNNING_SQL}, {_MODEL_SQL}, dc AS (
      SELECT *, CASE WHEN alert_triggered THEN 1 WHEN syn_count >= 2 AND packets_per_second >= 0.5 THEN 2
        WHEN unique_dest_ports >= 10 AND packet_count <= 1 THEN 3 ELSE 4 END AS branch FROM mi)
    SELECT flow_id,
      CASE branch WHEN 1 THEN 'DATA_EXFILTRATION' WHEN 2 THEN 'SYN_FLOOD' WHEN 3 THEN 'PORT_SCAN' ELSE {_MODEL_CLASS} END AS threat_class,
      round(CASE branch WHEN 1 THEN 0.0 WHEN 2 THEN least(0.99, 0.80 + least(syn_count / 1000, 0.19))
        WHEN 3 THEN least(0.99, 0.6 + unique_dest_ports / 100) ELSE rf_confidence END, 6) AS confidence,
      CASE branch WHEN 1 THEN 'behavioral-exfil-v1' WHEN 2 THEN 'rf-if-v3+syn-rule' ELSE 'rf-if-v3' END AS model_version
    FROM dc""",
)
def flow_decisions(spark, path):
    rows = _model_inputs(_running(spark, path))
    out = R.decide_flows(rows, -0.447, ["Flow Duration", "Flow IAT Std"], max_packets=1, **SYN)
    return rounded(out.select("flow_id", "threat_class", "confidence", "model_version"))


@query(
    "threats_by_class_and_severity",
    f"WITH {RULE_SQL} SELECT threat_class, severity, count(*) AS alerts FROM al GROUP BY 1, 2",
)
def threats_by_class_and_severity(spark, path):
    """Flagship: packets to flows to features to verdicts to alert counts."""
    hits = _classified(spark, path).where(F.col("threat_class") != "BENIGN")
    graded = hits.select("threat_class", A.severity(F.col("threat_class"), F.col("confidence")).alias("severity"))
    return graded.groupBy("threat_class", "severity").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "feature_contract",
    f"""WITH {D.RUNNING_SQL} SELECT CASE WHEN protocol NOT IN ('TCP', 'UDP') THEN 'protocol unknown' ELSE 'ok' END AS reason, count(*) AS flows FROM rc GROUP BY 1""",
)
def feature_contract(spark, path):
    rows = _running(spark, path).withColumn("reason", F.coalesce(cleaning.feature_reason(), F.lit("ok")))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("flows"))


@query(
    "model_input_rows",
    f"""WITH {D.RUNNING_SQL} SELECT flow_id, CAST(dst_port AS DOUBLE) AS "Destination Port", flow_duration AS "Flow Duration",
      CAST(packet_count AS DOUBLE) AS "Total Fwd Packets", CAST(byte_count AS DOUBLE) AS "Total Length of Fwd Packets",
      round(flow_bytes_per_second, 6) AS "Flow Bytes/s", round(packets_per_second, 6) AS "Fwd Packets/s", round(iat_mean, 3) AS "Flow IAT Mean",
      round(iat_std, 3) AS "Flow IAT Std", round(avg_packet_size, 6) AS "Fwd Packet Length Mean",
      CAST(fwd_packet_length_min AS DOUBLE) AS "Fwd Packet Length Min" FROM rc""",
)
def model_input_rows(spark, path):
    rows = cleaning.model_row(_running(spark, path)).select("flow_id", *cleaning.S.MODEL_FEATURES)
    return rounded(rows, **{"Flow IAT Mean": 3, "Flow IAT Std": 3})


@query(
    "gap_variation",
    f"WITH {D.FLOWS_SQL} SELECT flow_id, round(CASE WHEN iat_mean > 0 THEN iat_std / iat_mean ELSE -1.0 END, 6) AS iat_cv FROM fl",
)
def gap_variation(spark, path):
    return rounded(P.with_variation(_flows(spark, path), "iat_mean", "iat_std").select("flow_id", "iat_cv"))


@query(
    "flow_table",
    f"WITH {D.FLOWS_SQL} SELECT flow_id, last_us AS ts_us, {D.FIVE}, flow_duration AS duration, packet_count, byte_count FROM fl",
)
def flow_table(spark, path):
    rows = FL.flow_table(_flows(spark, path))
    return rows.withColumn("ts_us", F.unix_micros("timestamp")).drop("timestamp")


@query(
    "flow_upsert",
    f"""WITH {D.FLOWS_SQL}, more AS (
      SELECT flow_id, last_us AS ts_us, byte_count, 0 AS v FROM fl
      UNION ALL SELECT flow_id, last_us, byte_count + 1, 1 FROM fl WHERE dst_ip = 'click'
      UNION ALL SELECT 'n_' || flow_id, last_us, byte_count, 1 FROM fl WHERE dst_ip = 'view')
    SELECT flow_id, ts_us, byte_count FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY v DESC) AS rn FROM more) WHERE rn = 1""",
)
def flow_upsert(spark, path):
    stored = FL.flow_table(_flows(spark, path))
    changed = stored.where("dst_ip = 'click'").withColumn("byte_count", F.col("byte_count") + 1)
    added = stored.where("dst_ip = 'view'").withColumn("flow_id", F.concat(F.lit("n_"), F.col("flow_id")))
    out = A.upsert(stored, changed.unionByName(added), "flow_id")
    return out.select("flow_id", F.unix_micros("timestamp").alias("ts_us"), "byte_count")


@query(
    "flow_latency_report",
    f"""WITH {D.FLOWS_SQL} SELECT dst_ip, count(*) AS rows, round(count(*) * 1e6 / sum(flow_duration), 6) AS rows_per_second,
      round(quantile_cont(flow_duration, 0.5), 3) AS p50, round(quantile_cont(flow_duration, 0.95), 3) AS p95,
      round(quantile_cont(flow_duration, 0.99), 3) AS p99 FROM fl WHERE flow_duration > 0 GROUP BY dst_ip""",
)
def flow_latency_report(spark, path):
    rows = _flows(spark, path).where("flow_duration > 0")
    return rounded(P.latency_report(rows, ["dst_ip"], "flow_duration"), p50=3, p95=3, p99=3)


@query(
    "port_ranges",
    """SELECT CASE WHEN p < 1024 THEN 'well_known' WHEN p < 49152 THEN 'registered' ELSE 'ephemeral' END AS port_range,
       count(*) AS rows FROM (SELECT (l_partkey * 37) % 65536 AS p FROM lineitem) GROUP BY 1""",
)
def port_ranges(spark, path):
    rows = D.table(spark, path, "lineitem").select(((F.col("l_partkey") * 37) % 65536).alias("p"))
    return P.port_ranges(rows, "p")


@query(
    "top_destinations",
    f"WITH {D.PACKETS_SQL} SELECT dst_port AS value, count(*) AS rows FROM pk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_destinations(spark, path):
    return P.top_values(_packets(spark, path), "dst_port")


@query(
    "packet_cardinality",
    f"""WITH {D.PACKETS_SQL} SELECT 'src_ip' AS "column", count(DISTINCT src_ip) AS distinct_values FROM pk
     UNION ALL SELECT 'dst_ip', count(DISTINCT dst_ip) FROM pk UNION ALL SELECT 'dst_port', count(DISTINCT dst_port) FROM pk""",
)
def packet_cardinality(spark, path):
    return P.cardinality(_packets(spark, path), ["src_ip", "dst_ip", "dst_port"])


@query("packet_time_span", f"WITH {D.PACKETS_SQL} SELECT min(t_us) AS first_us, max(t_us) AS last_us, max(t_us) - min(t_us) AS span_us FROM pk")
def packet_time_span(spark, path):
    return P.time_span(_packets(spark, path), "timestamp")
