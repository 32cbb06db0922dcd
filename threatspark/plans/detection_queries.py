"""Queries on the detection pipeline as a whole: packets to alerts, in a batch and as a stream, and stored models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threatspark import schemas as S
from threatspark.operators import calibration, detection as DT, flows as FL, inference as I, splitting as SP
from threatspark.plans import adapters as D
from threatspark.plans.alert_queries import _RULE, _TEMPORAL, _TRAFFIC
from threatspark.plans.registry import query, rounded
from threatspark.session import ensure_checkpoint_dir
from threatspark.sources import sinks

SETTINGS = DT.Settings(min_syn=2, min_pps=0.5, max_packets=1, warmup=3, z_limit=2.0, slow_seconds=4.0, slow_pps=1.0)

# Flows in close order, the baseline before each of them, the first branch that applies, and what suppression leaves.
DETECTION_SQL = f"""WITH RECURSIVE {D.RUNNING_SQL.strip()},
o AS (SELECT *, byte_count::DOUBLE AS x, row_number() OVER (PARTITION BY src_ip ORDER BY last_us, flow_id) AS rn FROM rc),
st AS (SELECT src_ip, rn, x, CAST(NULL AS DOUBLE) AS pm, CAST(NULL AS DOUBLE) AS pv, x AS m, 0::DOUBLE AS v FROM o WHERE rn = 1
  UNION ALL SELECT o.src_ip, o.rn, o.x, st.m, st.v, st.m + 0.2::DOUBLE * (o.x - st.m), 0.8::DOUBLE * (st.v + 0.2::DOUBLE * (o.x - st.m) * (o.x - st.m))
  FROM st JOIN o ON o.src_ip = st.src_ip AND o.rn = st.rn + 1),
bz AS (SELECT o.*, greatest(-999.0, least(999.0, CASE WHEN o.rn <= 3 THEN 0.0 WHEN pv > 0 THEN (o.x - pm) / sqrt(pv) WHEN o.x > pm THEN 999.0 ELSE 0.0 END)) AS z
  FROM o JOIN st USING (src_ip, rn)),
br AS (SELECT *, CASE WHEN z > 2 OR (flow_duration / 1000000 > 4 AND packets_per_second < 1) THEN 1 WHEN syn_count >= 2 AND packets_per_second >= 0.5 THEN 2
  WHEN unique_dest_ports >= 10 AND packet_count <= 1 THEN 3 ELSE 4 END AS branch FROM bz),
dc AS (SELECT *,
  CASE branch WHEN 1 THEN 'DATA_EXFILTRATION' WHEN 2 THEN 'SYN_FLOOD' WHEN 3 THEN 'PORT_SCAN' ELSE 'BENIGN' END AS threat_class,
  CASE branch WHEN 2 THEN least(0.99, 0.80 + least(syn_count / 1000, 0.19)) WHEN 3 THEN least(0.99, 0.6 + unique_dest_ports / 100) ELSE 0.0 END AS confidence,
  CASE branch WHEN 1 THEN 1.0 WHEN 2 THEN least(0.99, 0.80 + least(packets_per_second / 10000, 0.19)) WHEN 3 THEN least(0.99, unique_dest_ports / 50) ELSE 0.0 END AS anomaly_score,
  CASE branch WHEN 1 THEN 'behavioral-exfil-v1' WHEN 2 THEN 'rf-if-v3+syn-rule' ELSE 'rf-if-v3' END AS model_version
  FROM br),
hs AS (SELECT *, coalesce(last_us - lag(last_us) OVER (PARTITION BY src_ip, threat_class ORDER BY last_us, flow_id) < 10000000, false) AS suppressed
  FROM dc WHERE branch < 4)"""

_SEVERITY = "CASE WHEN threat_class = 'PORT_SCAN' OR confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END"
ALERTS_SQL = f"""{DETECTION_SQL} SELECT 'a_' || md5(flow_id || '|' || threat_class || '|' || model_version) AS alert_id, last_us AS ts_us, flow_id, threat_class,
  {_SEVERITY} AS severity, round(confidence, 6) AS confidence, round(anomaly_score, 6) AS anomaly_score, {_TRAFFIC} AS traffic, {_TEMPORAL} AS temporal, {_RULE} AS rule, model_version
  FROM hs WHERE NOT suppressed"""


def flat(alerts):
    shown = alerts.select(
        "alert_id", F.unix_micros("timestamp").alias("ts_us"), "flow_id", "threat_class", "severity", "confidence", "anomaly_score",
        "evidence.traffic", "evidence.temporal", "evidence.rule", "model_version",
    )
    return rounded(shown)


@query("detection_alerts", ALERTS_SQL)
def detection_alerts(spark, path):
    """Packets to alerts by behaviour and rules, nothing given but packets."""
    return flat(DT.detect(D.packets(spark, path), settings=SETTINGS))


@query(
    "detection_decisions",
    f"""{DETECTION_SQL} SELECT flow_id, threat_class, round(confidence, 6) AS confidence, round(anomaly_score, 6) AS anomaly_score, model_version,
    unique_destinations, unique_dest_ports, round(z, 6) AS z_score FROM dc""",
)
def detection_decisions(spark, path):
    """The verdict on every flow, with the state of its source that led to it."""
    rows = DT.decide(DT.with_state(FL.flow_features(D.packets(spark, path)), SETTINGS), None, SETTINGS)
    return rounded(rows.select("flow_id", "threat_class", "confidence", "anomaly_score", "model_version", "unique_destinations", "unique_dest_ports", "z_score"))


def stored_models(spark, path, rows, row_id, features, **how) -> I.Models:
    """Models trained, saved in the shared folder and loaded again, as a later job would do it."""
    place = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    I.train(rows, row_id, features, **how).save(place)
    return I.load(spark, place)


def _flow_models(spark, path) -> I.Models:
    """Models of the cleaned, labelled flow table."""
    from threatspark.operators import cleaning as C

    names = list(S.MODEL_FEATURES)
    rows = C.supervised_table(C.clean(D.flow_table_raw(spark, path))).withColumn("row", F.xxhash64(*[F.col(f"`{c}`") for c in [*names, S.TARGET]]))
    split = SP.split_by_hash(rows, "row")
    return stored_models(spark, path, split, "row", names, forest=dict(trees=20, depth=8), isolation=dict(trees=50), thresholds=calibration.grid(-0.30, -0.80, -0.001))


@query("detection_with_models")
def detection_with_models(spark, path):
    """Packets to alerts with both stored models, trained and calibrated on the labelled flow table."""
    return flat(DT.detect(D.packets(spark, path), _flow_models(spark, path), SETTINGS))


@query("detection_stream", ALERTS_SQL)
def detection_stream(spark, path):
    """The same alerts from a stream of packets through three chained stateful operators."""
    from threatspark.streaming import chain

    packets = D.packets(spark, path).drop("seq")
    return flat(chain.replay(packets, SETTINGS))


@query(
    "stored_alerts",
    f"""{DETECTION_SQL} SELECT 'a_' || md5(flow_id || '|' || threat_class || '|' || model_version) AS alert_id, last_us AS ts_us, threat_class,
    CASE WHEN threat_class = 'SYN_FLOOD' THEN 'REVIEWED' ELSE {_SEVERITY} END AS severity FROM hs WHERE NOT suppressed""",
)
def stored_alerts(spark, path):
    """Alerts in the store after two upserts: all of them, and those of one class again with another severity."""
    store = sinks.AlertStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    alerts = DT.detect(D.packets(spark, path), settings=SETTINGS)
    store.upsert("alerts", alerts)
    store.upsert("alerts", store.read("alerts").where(F.col("threat_class") == S.SYN_FLOOD).withColumn("severity", F.lit("REVIEWED")))
    return store.read("alerts").select("alert_id", F.unix_micros("timestamp").alias("ts_us"), "threat_class", "severity")
