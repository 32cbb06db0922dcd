"""Hand-made cases with known results."""

import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from threatspark import schemas as S
from threatspark.functions import text as X
from threatspark.operators import (
    alerts as A, behavior as B, calibration as K, cleaning as C, dns as N, flows as FL, forest as RF, fusion as FU,
    isolation as IF, profiling as P, rules as R, splitting as SP, tls as TL,
)
from threatspark.sources import feeds, records, sinks

T0 = dt.datetime(2026, 9, 11, 10, 0, 0)


def packets(spark, rows):
    """rows: (seconds, src, dst, dst_port, size[, syn[, protocol]])."""
    full = [
        (T0 + dt.timedelta(seconds=r[0]), r[1], r[2], 51000, r[3], (r[6] if len(r) > 6 else "TCP"), r[4], bool(len(r) > 5 and r[5]))
        for r in rows
    ]
    return spark.createDataFrame(full, S.PACKETS)


# --- flows ---------------------------------------------------------------------------------------------------
def test_known_features(spark):
    rows = [(0, "a", "b", 80, 100, True), (1, "a", "b", 80, 200), (2, "a", "b", 80, 300)]
    f = FL.with_batch_cardinalities(FL.flow_features(packets(spark, rows))).first()
    assert (f.packet_count, f.byte_count, f.avg_packet_size, f.flow_duration) == (3, 600, 200.0, 2_000_000.0)
    assert (f.packets_per_second, f.iat_mean, f.iat_std, f.syn_count) == (1.5, 1_000_000.0, 0.0, 1)
    assert (f.unique_destinations, f.unique_dest_ports, f.fwd_packet_length_min) == (1, 1, 100)


def test_single_packet_gives_zeros(spark):
    f = FL.flow_features(packets(spark, [(0, "a", "b", 80, 60)])).first()
    assert (f.flow_duration, f.packets_per_second, f.flow_bytes_per_second, f.iat_mean, f.iat_std) == (0, 0, 0, 0, 0)


def test_direction_and_cardinality(spark):
    rows = [(0, "a", "b", 80, 1), (0, "b", "a", 80, 1), (1, "a", "c", 80, 1), (2, "a", "c", 443, 1)]
    flows = FL.with_batch_cardinalities(FL.flow_features(packets(spark, rows))).collect()
    assert len(flows) == 4
    assert {(f.unique_destinations, f.unique_dest_ports) for f in flows if f.src_ip == "a"} == {(2, 2)}


def test_gap_is_strict(spark):
    at_gap = FL.flow_features(packets(spark, [(0, "a", "b", 80, 1), (5, "a", "b", 80, 1)]))
    beyond = FL.flow_features(packets(spark, [(0, "a", "b", 80, 1), (5.000001, "a", "b", 80, 1)]))
    assert (at_gap.count(), beyond.count()) == (1, 2)


def test_copies_of_a_packet_with_a_hot_key(spark):
    rows = [(0, "a", "b", 80, 10)] * 40 + [(1, "a", "b", 80, 20)] * 3 + [(9, "a", "b", 80, 20)]
    plain = FL.flow_features(packets(spark, rows)).toPandas().sort_values("flow_start_us")
    hot = FL.flow_features(packets(spark, rows), chunk_rows=2).toPandas().sort_values("flow_start_us")
    pd.testing.assert_frame_equal(plain.reset_index(drop=True), hot.reset_index(drop=True))
    gaps = [0.0] * 39 + [1e6] + [0.0] * 2
    assert plain["iat_std"].iloc[0] == pytest.approx(np.std(gaps, ddof=1))


# --- rules and alerts ------------------------------------------------------------------------------------------
def test_scenarios(spark):
    scan = [(i * 0.01, "s", "t", i, 60, True) for i in range(40)]
    flood = [(i * 0.001, "f", "t", 80, 60, True) for i in range(60)]
    beacon = [(i * 2.0, "c", "t", 8080, 60) for i in range(6)]
    quiet = [(i * 0.3 + (i % 3) * 0.2, "q", "t", 443, 500, i == 0) for i in range(20)]
    flows = FL.with_running_cardinalities(FL.flow_features(packets(spark, scan + flood + beacon + quiet)))
    out = R.classify_by_rules(flows)
    by = {(r.src_ip, r.threat_class): r["count"] for r in out.groupBy("src_ip", "threat_class").count().collect()}
    assert by[("s", "PORT_SCAN")] == 31  # from the tenth port on
    assert by[("f", "SYN_FLOOD")] == 1 and by[("c", "C2_BEACONING")] == 1 and by[("q", "BENIGN")] == 1
    alerts = A.flow_alerts(out)
    assert {r.severity for r in alerts.where("threat_class = 'PORT_SCAN'").collect()} == {"HIGH"}
    assert alerts.where("threat_class = 'BENIGN'").count() == 0
    text = alerts.where("threat_class = 'C2_BEACONING'").first().evidence
    assert text.traffic == "6 packets observed (360 bytes total) over 10.00s, averaging 60.0 bytes/packet"
    assert text.temporal == (
        "mean inter-arrival time = 2.00s, std = 0.00s (0.0% of mean) — highly regular, consistent with "
        "periodic/automated behavior"
    )
    assert text.ml == (
        "Model classified as C2_BEACONING (confidence 90%, anomaly score 0.90). "
        "Top contributing features: iat_std, iat_mean"
    )
    assert text.rule == "no rule-based indicators triggered"


@pytest.mark.parametrize("syn,pps,hit", [(20, 100.0, True), (19, 100.0, False), (20, 99.9, False)])
def test_syn_rule_edges(spark, syn, pps, hit):
    row = spark.createDataFrame([("TCP", syn, pps)], "protocol string, syn_count long, packets_per_second double")
    v = row.select(R.syn_flood_rule().alias("v")).first().v
    assert (v is not None) == hit
    if hit:
        assert v.confidence == pytest.approx(0.82) and v.anomaly_score == pytest.approx(0.81)


def test_rare_class_gate(spark):
    rows = [("Bots", -0.4470), ("Bots", -0.4469), ("Bots", -0.5), ("DDoS", -0.1), ("What", -0.9)]
    df = spark.createDataFrame([(*r, 0.8) for r in rows], "rf_label string, raw_anomaly double, rf_confidence double")
    got = [r.v.threat_class for r in df.select(R.model_verdict(-0.447, ["x", "y"]).alias("v")).collect()]
    assert got == ["C2_BEACONING", "BENIGN", "C2_BEACONING", "SYN_FLOOD", "BENIGN"]
    half = df.where("raw_anomaly = -0.4470").select(R.model_verdict(-0.447, ["x"]).alias("v")).first().v
    assert half.anomaly_score == pytest.approx(0.5)


def test_repeats_refresh_the_window(spark):
    rows = [(T0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 9, 18, 28, 50])]
    df = spark.createDataFrame(rows, "ts timestamp, id int").withColumn("k", F.lit(1))
    out = A.suppress_repeats(df, ["k"], "ts", ["id"], 10.0, keep_suppressed=True).orderBy("id").collect()
    assert [r.suppressed for r in out] == [False, True, True, False, False]  # a distance of 10 s passes


def test_feed_views(spark):
    ev = T.StructType.fromJson(S.EVIDENCE.jsonValue())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("alert_id", "flow_id", "threat_class", "severity", "src_ip", "dst_ip", "protocol", "scenario", "model_version")] + [T.StructField("evidence", ev)])
    rows = [
        ("1", "f1", "PORT_SCAN", "HIGH", "10.0.0.1", None, "TCP", None, None, ("Seen TWICE", "", "", "")),
        ("2", "f2", "SYN_FLOOD", None, "10.0.0.2", "x", "TCP", "port_scan", "behavioral-exfil-v1", ("", "", "", "")),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r.alert_id for r in A.feed_filter(df, text=" twice ").collect()] == ["1"]
    assert A.feed_filter(df, severity="HIGH", threat_class="SYN_FLOOD").count() == 0
    assert {r.alert_id for r in A.of_scenario(df, "port_scan").collect()} == {"1", "2"}
    assert {r.severity: r.alerts for r in A.severity_counts(df).collect()} == {"HIGH": 1, "UNKNOWN": 1}
    assert [r[0] for r in df.orderBy("alert_id").select(A.is_behavioral(F.col("model_version"))).collect()] == [False, True]
    assert A.top_severity_by_class(df).where("threat_class = 'SYN_FLOOD'").first().severity == "LOW"


# --- TLS ---------------------------------------------------------------------------------------------------------
HANDSHAKES = [
    ("tls", "client", 771, [0x0A0A, 4865, 4866, 4867, 49195, 49199], [0, 23, 65281, 10, 11, 35, 16, 5, 51, 43, 13], [0x0A0A, 29, 23, 24], [0], None),
    ("quic", "client", 772, [4865, 4866, 4867], [0, 10, 16, 43, 51], [29, 23], [0], None),
    ("tls", "server", 771, None, [0, 23, 65281, 11], None, None, 4865),
    ("tls", "client", 771, [], [], [], [], None),
    ("tls", "client", 771, [0x0A0A, 0x1A1A], [], [], [], None),
    ("tls", "client", None, [4865], None, None, None, None),
    ("http", "client", 771, None, None, None, None, None),
    (None, None, None, None, None, None, None, None),
]
HASHES = [
    "27a8394ba48176f6a534a68a4d44e391",
    "0643f8b1c8e275bf800747abfc0343a3",
    "ef2883f9861e9cbc9e3b10a533129529",
    "bddda940f9963577c41d7c28b1a5f65f",
    "bddda940f9963577c41d7c28b1a5f65f",
    None,
    None,
    None,
]


def test_fingerprints(spark):
    df = spark.createDataFrame([(*h, i) for i, h in enumerate(HANDSHAKES)], T.StructType([*S.TLS_HANDSHAKES.fields, T.StructField("i", T.IntegerType())]))
    block = spark.createDataFrame([(HASHES[1],)], "ja3_md5 string")
    out = TL.analyze_handshakes(df, block).orderBy("i").collect()
    assert [r.fingerprint for r in out] == HASHES
    assert [r.reason for r in out] == ["clean", "blocklist_match", "clean", "clean", "clean", "missing_tls_version", "invalid_session", "invalid_session"]
    assert [r.flagged for r in out] == [i == 1 for i in range(8)]


def test_session_order_of_checks(spark):
    h = "a" * 32
    rows = [(h.upper() + " ", "tls", "client"), (h, "ssh", "client"), (h, "tls", "peer"), ("xyz", "tls", "client"), (None, "quic", "server"), ("b" * 32, "tls", "server")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "fingerprint string, transport string, role string, i int")
    out = TL.classify_sessions(df, spark.createDataFrame([(h,)], "ja3_md5 string")).orderBy("i").collect()
    assert [r.reason for r in out] == ["blocklist_match", "invalid_transport", "invalid_role", "invalid_fingerprint_format", "invalid_fingerprint_format", "clean"]
    assert (out[0].matched_hash, out[0].confidence, out[5].matched_hash) == (h, 1.0, None)


# --- DNS ---------------------------------------------------------------------------------------------------------
def test_entropy_and_pieces(spark):
    df = spark.createDataFrame([("xk29fj2q8zpmw1n.net",), ("",), (None,), ("...",), ("aab.é",)], "d string")
    got = [r[0] for r in df.select(X.shannon_entropy(F.col("d"))).collect()]
    assert round(got[0], 3) == 3.948 and got[1:4] == [0.0, 0.0, 0.0]
    assert got[4] == pytest.approx(1.5)
    one = spark.createDataFrame([("a.b.example.com",)], "d string").select(
        X.suffixes(F.col("d")).alias("s"), X.ngrams(F.lit("abcd"), 3).alias("n"), X.ngrams(F.lit("a"), 2).alias("e"), X.longest_subdomain_label(F.lit("aaa.bb.c.d")).alias("l"), X.longest_subdomain_label(F.lit("aaa.bb")).alias("l2"),
    ).first()
    assert one.s == ["a.b.example.com", "b.example.com", "example.com"]
    assert (one.n, one.e, one.l, one.l2) == (["abc", "bcd"], [], 3, 0)


def test_domain_verdicts(spark):
    good = spark.createDataFrame([(1, "google.com"), (2, "facebook.com"), (3, "goggles.org")], "position long, domain string")
    model = N.ngram_model(good)
    size = 5 + 7 + 6 + len({"go", "oo", "og", "gl", "le", "fa", "ac", "ce", "eb", "bo", "ok", "gg", "es"})
    by = {r.gram: r.logp for r in model.collect()}
    assert by[N.UNSEEN] == pytest.approx(np.log(1 / size)) and by["go"] == pytest.approx(np.log(3 / size))
    names = ["Google.com", "static.facebook.com", "xk29fj2q8zpmw1n.net", "evil.test", "", "no-dots-here", None, "goggle.net", "com.", "x.y"]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    block = spark.createDataFrame([("evil.test",)], "domain string")
    out = {r.domain: r for r in N.classify_domains(df, block, model, 3.2, -3.4, N.allowlist(good, 2)).collect()}
    assert out["google.com"].reason == out["static.facebook.com"].reason == "allowlisted"
    assert (out["evil.test"].reason, out["evil.test"].confidence, out["evil.test"].flagged) == ("blocklist_match", 1.0, True)
    assert (out["xk29fj2q8zpmw1n.net"].reason, out["xk29fj2q8zpmw1n.net"].entropy) == ("entropy+ngram", 3.948)
    assert out[""].reason == out["no-dots-here"].reason == "invalid_domain"
    assert out["goggle.net"].reason is None and not out["goggle.net"].flagged
    assert out["x.y"].ngram_score == pytest.approx(round(np.log(1 / size), 3)) and out["x.y"].confidence == 0.6


def test_query_verdicts(spark):
    names = ["clean.example.com"] * 25 + ["l" * 30 + ".example.com"]
    rows = [(i, n, "A", T0 + dt.timedelta(seconds=i * 0.2), "h") for i, n in enumerate(names)]
    queries = spark.createDataFrame(rows, "seq long, domain string, query_type string, timestamp timestamp, src_ip string")
    verdicts = spark.createDataFrame(
        [("clean.example.com", False, None, 1.0, -2.0, 0.0), ("l" * 30 + ".example.com", True, "entropy_or_ngram", 3.0, -9.0, 0.6)],
        "domain string, flagged boolean, reason string, entropy double, ngram_score double, confidence double",
    )
    out = N.classify_queries(queries, verdicts, seq="seq").orderBy("seq").collect()
    assert [r.reason for r in out[:19]] == ["clean"] * 19
    assert out[19].reason == "high_query_rate" and out[19].confidence == 0.8 and out[19].dns_flag == "DNS_TUNNELING"
    assert out[25].reason == "entropy_or_ngram+high_query_rate+long_subdomain"
    assert (out[25].confidence, out[25].dns_flag) == (0.95, "DGA")


def test_rate_window_edges(spark):
    rows = [(i, "a.b", T0 + dt.timedelta(seconds=s), "h") for i, s in enumerate([0, 5, 5])]
    queries = spark.createDataFrame(rows, "seq long, domain string, timestamp timestamp, src_ip string")

    def counts(**kw):
        return [r.recent_queries for r in N.query_rates(queries, seq="seq", **kw).orderBy("seq").collect()]

    assert counts() == [1, 2, 3]
    assert counts(closed="right") == [1, 1, 2]
    assert counts(peers=True) == [1, 3, 3]


# --- behaviour -----------------------------------------------------------------------------------------------------
def observe(spark, values, duration=15.0, pps=35.0):
    rows = [("h", T0 + dt.timedelta(seconds=i), f"f{i:03}", float(v), duration, pps, "d") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "source_ip string, timestamp timestamp, flow_id string, byte_count double, flow_duration double, pps double, dest_ip string")


def test_behavior_cases(spark):
    steady = [50_000, 51_000, 49_500, 50_200, 50_800, 49_900, 50_100, 50_400, 49_700, 50_300]
    out = B.classify_behavior(observe(spark, steady + [50_600, 2_000_000])).orderBy("flow_id").collect()
    assert {r.status for r in out[:10]} == {"INSUFFICIENT_HISTORY"} and not any(r.alert_triggered for r in out[:11])
    assert out[10].status == "SCORED" and out[11].alert_triggered and out[11].drift
    slow = B.classify_behavior(observe(spark, [100], 5000.0, 0.8)).first()
    assert slow.alert_triggered and slow.metrics.low_and_slow.triggered and not slow.drift
    flat = B.classify_behavior(observe(spark, [10_000] * 10 + [10_500])).orderBy("flow_id").collect()
    assert flat[10].z_score == 999.0 and flat[10].drift
    edge = B.classify_behavior(observe(spark, [1], 3600.0, 0.5)).first()
    assert not edge.low_and_slow


def test_alpha_is_honoured(spark):
    rows = observe(spark, [0, 10])
    assert B.classify_behavior(rows, alpha=0.5).orderBy("flow_id").collect()[1].ewma_mean == 5.0


def test_translator(spark):
    row = {"Flow Duration": 5_000_000.0, "Total Length of Fwd Packets": 48_000.0, "Fwd Packets/s": 24.0, "source_ip": "a", "dest_ip": "b", "timestamp": 1.0, "flow_id": "f"}
    df = spark.createDataFrame([row])
    out = B.behavior_payload(df).first()
    assert (out.flow_duration, out.byte_count, out.pps, out.reject_reason) == (5.0, 48_000.0, 24.0, None)
    assert B.behavior_payload(df, duration_unit="seconds").first().flow_duration == 5_000_000.0
    with pytest.raises(KeyError, match="dest_ip"):
        B.behavior_payload(df.drop("dest_ip"))
    with pytest.raises(ValueError):
        B.behavior_payload(df, duration_unit="hours")


# --- fusion ----------------------------------------------------------------------------------------------------------
def signal_rows(spark, rows):
    full = [(src, T0 + dt.timedelta(seconds=s), i, kind, f"f{i}", "d", "{}") for i, (src, s, kind) in enumerate(rows)]
    return spark.createDataFrame(full, S.SIGNALS)


def test_worked_example(spark):
    signals = signal_rows(spark, [("x", 0, S.ML_SIGNAL), ("x", 15, S.DNS_SIGNAL), ("x", 25, S.TLS_SIGNAL)])
    out = FU.fuse(signals, keep_suppressed=True).orderBy("seq").collect()
    assert [r.severity for r in out] == ["LOW", "HIGH", "SUPPRESSED"]
    assert out[0].alert_type == "ML_BRANCH_SIGNAL_DETECTION" and out[1].alert_type == "DATA_EXFILTRATION"
    assert out[1].signals == [S.DNS_SIGNAL, S.ML_SIGNAL]
    entries = FU.alert_entries(FU.fuse(signals), signals).orderBy("alert_seq", "entry_seq").collect()
    assert [(e.alert_seq, e.entry_seq) for e in entries] == [(0, 0), (1, 0), (1, 1)]


def test_window_and_cooldown_edges(spark):
    kinds = [S.ML_SIGNAL, S.DNS_SIGNAL]
    at = FU.fuse(signal_rows(spark, [("a", 0, kinds[0]), ("a", 60, kinds[1])])).orderBy("seq").collect()
    assert [r.severity for r in at] == ["LOW", "HIGH"]  # the window is closed
    past = FU.fuse(signal_rows(spark, [("a", 0, kinds[0]), ("a", 60.000001, kinds[1])])).collect()
    assert {r.severity for r in past} == {"LOW"}
    again = FU.fuse(signal_rows(spark, [("a", 0, kinds[0]), ("a", 1, kinds[1]), ("a", 60, kinds[0]), ("a", 61, kinds[1])]), keep_suppressed=True)
    assert [r.severity for r in again.orderBy("seq").collect()] == ["LOW", "HIGH", "SUPPRESSED", "HIGH"]


def test_arrival_order_at_one_instant(spark):
    rows = signal_rows(spark, [("a", 0, S.ML_SIGNAL), ("a", 0, S.DNS_SIGNAL)])
    assert [r.severity for r in FU.fuse(rows).orderBy("seq").collect()] == ["LOW", "HIGH"]


def test_model_gate(spark):
    rows = [("Normal Traffic", 0.9, None), ("Bots", 0.8, -0.55), ("Bots", 0.8, -0.447), ("Bots", 0.8, None), ("DDoS", 0.9, None), ("Odd", 0.9, None)]
    df = spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], "flow_id string, rf_threat_class string, rf_confidence double, iforest_raw_score double").withColumns({"source_ip": F.lit("s"), "timestamp": F.lit(T0), "seq": F.lit(1)})
    signals, near, rejected = FU.ml_gate(df, -0.447)
    assert {r.flow_id for r in signals.collect()} == {"f1", "f4"}
    assert {r.flow_id for r in near.collect()} == {"f2"}
    assert {r.flow_id for r in rejected.collect()} == {"f3", "f5"}
    assert json.loads(signals.where("flow_id = 'f1'").first().evidence)["iforest_raw_score"] == -0.55


# --- cleaning, profiling, splits ------------------------------------------------------------------------------------
def test_degenerate_tables(spark):
    schema = "`Flow Duration` double, `Attack Type` string"
    empty = spark.createDataFrame([], schema)
    assert P.label_distribution(empty).count() == 0
    assert P.describe(empty, ["Flow Duration"]).first()["count"] == 0
    one = spark.createDataFrame([(5.0, "DDoS")], schema)
    d = P.describe(one, ["Flow Duration"]).first()
    assert (d["mean"], d["std"], d["median"]) == (5.0, None, 5.0)
    assert P.class_statistics(one, ["Flow Duration"]).first()["std"] is None
    nan = spark.createDataFrame([(float("nan"), "DDoS"), (None, "DDoS")], schema)
    assert C.drop_missing(nan).count() == 0
    assert C.missing_counts(nan).where("`column` = 'Flow Duration'").first()["missing"] == 2
    inf = spark.createDataFrame([(float("-inf"), "DDoS"), (1.0, "DDoS")], schema)
    assert C.drop_infinite(inf).count() == 1 and C.drop_infinite(inf, "columns").columns == ["Attack Type"]
    with pytest.raises(Exception, match="missing or infinite values remain"):
        C.assert_clean(inf).collect()
    with pytest.raises(Exception, match="missing or infinite values remain"):
        C.assert_clean(nan).count()
    with pytest.raises(KeyError):
        C.clean(one)
    junk = spark.createDataFrame([("1.5",), ("abc",), (None,)], "x string")
    assert C.non_numeric_counts(junk, ["x"]).first()["non_numeric"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.read_flow_table(spark, "/tmp/definitely-not-here.csv")


def test_label_spellings(spark):
    df = spark.createDataFrame([("Port Scanning",), ("PORT_SCANNING",), ("port-scanning",), ("port scanning",), ("DoS",), (None,)], "l string")
    got = [r[0] for r in df.select(C.canonical_label(F.col("l"))).collect()]
    assert got == ["Port Scanning"] * 4 + [None, None]


def test_shape_of_columns_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.exponential(2, 500), "b": rng.normal(40, 1e-3, 500), "k": 7.1})
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame(pdf).repartition(3)
    got = P.skew_kurtosis(df, ["a", "b"]).toPandas().set_index("column")
    np.testing.assert_allclose(got["skewness"], pdf[["a", "b"]].skew(), rtol=1e-6)
    np.testing.assert_allclose(got["kurtosis"], pdf[["a", "b"]].kurt(), rtol=1e-6)
    m = P.correlation_matrix(df, ["a", "b", "c", "k"]).toPandas().set_index("feature").loc[["a", "b", "c", "k"]]
    np.testing.assert_allclose(m.to_numpy(dtype=float), pdf[["a", "b", "c", "k"]].corr().to_numpy(), rtol=1e-9)
    pairs = P.correlated_pairs(df, ["a", "b", "c", "k"]).collect()
    assert [(r.feature_a, r.feature_b) for r in pairs] == [("a", "c")]


def test_threshold_selection_on_published_shape(spark):
    marks = K.grid()
    assert len(marks) == 161 and marks[0] == -0.44 and marks[-1] == -0.52 and marks[14] == -0.447
    scan = spark.createDataFrame([(-0.44, 1.0, 0.57), (-0.4465, 0.95, 0.53), (-0.447, 0.9278, 0.5223), (-0.4475, 0.893, 0.52)], "threshold double, bots_recall double, normal_fpr double")
    assert K.calibrated(scan) == (-0.447, 0.9278, 0.5223)
    with pytest.raises(RuntimeError):
        K.calibrated(scan, 1.01)
    scores = spark.createDataFrame([(-0.447, "Bots"), (-0.4469, "Bots"), (-0.9, "Normal Traffic"), (-0.1, "Normal Traffic")], "score double, label string")
    got = {r.threshold: (r.bots_recall, r.normal_fpr) for r in K.scan_thresholds(scores).collect()}
    assert got[-0.4465] == (1.0, 0.5) and got[-0.447] == (0.5, 0.5) and got[-0.4475] == (0.0, 0.5)


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(0, 1, (3000, 4)), columns=list("abcd"))
    pdf["id"] = np.arange(3000)
    train = spark.createDataFrame(pdf)
    forest = IF.fit(train, list("abcd"), "id", trees=60)
    probe = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 6.0, -6.0, 6.0, 6.0)], "id int, a double, b double, c double, d double")
    inner, outer = [r.raw_anomaly for r in forest.score(probe).orderBy("id").collect()]
    assert outer < -0.65 < -0.5 < inner < 0
    again = [r.raw_anomaly for r in IF.fit(train.repartition(7), list("abcd"), "id", trees=60).score(probe).orderBy("id").collect()]
    assert again == [inner, outer]  # same seed, same trees, whatever the partitioning
    assert float(IF.average_path(256)) == pytest.approx(10.244770920116851)
    assert forest.nodes.count() <= 60 * 511
    large = IF.fit(train, list("abcd"), "id", trees=10, sample=64)  # one tree per row at most
    assert [r.raw_anomaly for r in large.score(probe).orderBy("id").collect()][1] < -0.6
    scored = forest.score(train)
    decided = IF.with_decision(scored, scored, 0.05)
    share = decided.agg(F.avg((F.col("anomaly") == -1).cast("double"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.002)


def test_models_are_saved_and_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3))
    label = np.where(x[:, 0] > 0.5, "DDoS", np.where(x[:, 1] > 1.2, "Bots", "Normal Traffic"))
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "Attack Type": label}))
    model = RF.fit_forest(df, list("abc"), trees=15, depth=6, min_leaf=2)
    RF.save_model(model, str(tmp_path / "rf"))
    out = RF.predict(RF.load_model(str(tmp_path / "rf")), df)
    report = RF.overall_report(out, "Attack Type", "rf_label").first()
    assert report.accuracy > 0.95 and report.macro_f1 > 0.9
    assert RF.top_features(model, df, 2)[0] in ("a", "b")
    forest = IF.fit(df, list("abc"), "id", trees=10)
    forest.save(str(tmp_path / "if"))
    a = forest.score(df).agg(F.sum("raw_anomaly")).first()[0]
    assert IF.IsolationForest.load(spark, str(tmp_path / "if")).score(df).agg(F.sum("raw_anomaly")).first()[0] == pytest.approx(a)


def test_weights_and_balance(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "`Attack Type` string").withColumn("id", F.monotonically_increasing_id())
    got = {r.label: r.weight for r in SP.class_weights(df).collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


# --- sources and sinks -----------------------------------------------------------------------------------------------
def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_packet_file(spark, tmp_path):
    good = {"timestamp": "2026-09-11T10:00:00.078718Z", "src_ip": "a", "dst_ip": "b", "src_port": 1, "dst_port": 2, "protocol": "TCP", "packet_size": 60}
    lines = [json.dumps(good), "", json.dumps(good | {"dst_port": 70000}), "{broken", json.dumps(good | {"protocol": "ICMP"}), json.dumps({k: v for k, v in good.items() if k != "src_ip"})]
    rows = records.read_packets(spark, write(tmp_path / "p" / "x.jsonl", "\n".join(lines)))
    kept = records.accepted(rows).collect()
    assert len(kept) == 1 and kept[0].syn_flag is False and kept[0].timestamp.microsecond == 78718
    assert records.load_summary(rows).first().asDict() == {"accepted": 1, "rejected": 4}
    reasons = {r.reject_reason for r in records.rejected(rows).collect()}
    assert reasons == {"dst_port out of range", "malformed line", "protocol unknown", "src_ip missing"}


def test_dns_and_tls_files(spark, tmp_path):
    dns = [{"domain": "a.b", "query_type": "A", "timestamp": "2026-09-11T12:00:00.400Z", "src_ip": "h"}, {"domain": "a.b", "query_type": "A", "timestamp": "soon", "src_ip": "h"}]
    rows = records.read_dns_queries(spark, write(tmp_path / "d" / "x.jsonl", "\n".join(map(json.dumps, dns))))
    assert records.accepted(rows).first().timestamp == dt.datetime(2026, 9, 11, 12, 0, 0, 400_000)
    assert records.rejected(rows).first().reject_reason == "timestamp unreadable"
    tls = [{"fingerprint": "0" * 32, "transport": t, "role": "client", "timestamp": "2026-09-11T13:00:00Z", "src_ip": "h"} for t in ("tls", "smtp")]
    rows = records.read_tls_sessions(spark, write(tmp_path / "t" / "x.jsonl", "\n".join(map(json.dumps, tls))))
    assert records.load_summary(rows).first().asDict() == {"accepted": 1, "rejected": 1}


def test_reference_lists(spark, tmp_path):
    block = feeds.read_blocklist(spark, write(tmp_path / "b.csv", "# note\nEvil.NET,x\n\nevil.net\nabc\na.b\n"))
    assert [r.domain for r in block.collect()] == ["evil.net"]
    with pytest.raises(ValueError):
        feeds.read_blocklist(spark, write(tmp_path / "e.csv", "# only\n"))
    ranked = feeds.read_ranked_domains(spark, write(tmp_path / "r.csv", "rank,domain\n1,Google.com\n2,a.b\n3,google.com\n4,w3.org\n5,late.com\n"), 5)
    assert [(r.position, r.domain) for r in ranked.orderBy("position").collect()] == [(1, "google.com"), (2, "w3.org")]
    plain = feeds.read_ranked_domains(spark, write(tmp_path / "q.csv", "google.com\nw3.org\n"))
    assert [r.domain for r in plain.orderBy("position").collect()] == ["google.com", "w3.org"]
    h = "0123456789abcdef" * 2
    fine = feeds.read_fingerprints(spark, write(tmp_path / "f.csv", f" JA3_md5 ,when\n{h},1\n{h},2\n# END (1) entries\n"))
    assert [r.ja3_md5 for r in fine.collect()] == [h]
    with pytest.raises(ValueError, match="malformed"):
        feeds.read_fingerprints(spark, write(tmp_path / "g.csv", "hash\nnothash\n"))
    with pytest.raises(ValueError, match="no fingerprint column"):
        feeds.read_fingerprints(spark, write(tmp_path / "h.csv", "name\nx\n"))


def test_flow_table_file(spark, tmp_path):
    head = [f" {c} " for c in S.FLOW_TABLE_FIELDS] + ["extra", "Attack Type"]
    row = ["80"] + ["1.5" if t.simpleString() == "double" else "3" for t in list(S.FLOW_TABLE_FIELDS.values())[1:]] + ["x", "DDoS"]
    bad = list(row)
    bad[4] = "inf"
    table = feeds.read_flow_table(spark, write(tmp_path / "flows.csv", "\n".join(",".join(r) for r in (head, row, row, bad))))
    assert table.columns == [*S.FLOW_TABLE_FIELDS, S.TARGET]
    assert C.clean(table).count() == 1
    assert [r.rows_after for r in C.cleaning_account(table).orderBy("step_no").collect()] == [3, 2, 2, 1, 1]
    sup, anom = C.supervised_table(C.clean(table)), C.anomaly_table(C.clean(table))
    sinks.write_training_tables(sup, anom, str(tmp_path / "train"))
    assert spark.read.parquet(str(tmp_path / "train" / "anomaly")).first()["Flow Duration"] == pytest.approx(np.log1p(1.5))


def test_threshold_record(spark, tmp_path):
    scan = spark.createDataFrame([(-0.447, 0.93, 0.52)], "threshold double, bots_recall double, normal_fpr double")
    sinks.write_threshold(K.threshold_record(scan, trees=200), str(tmp_path / "t"))
    assert feeds.threshold_value(feeds.read_threshold(spark, str(tmp_path / "t"))) == -0.447
    pretty = write(tmp_path / "p.json", json.dumps({"calibrated_threshold": -0.447, "rule": "x"}, indent=2))
    assert feeds.threshold_value(feeds.read_threshold(spark, pretty)) == -0.447
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.read_threshold(spark, str(tmp_path / "none"))


def test_alert_store(spark, tmp_path):
    store = sinks.AlertStore(spark, str(tmp_path / "store"))
    assert store.read("alerts").count() == 0
    flows = FL.flow_features(packets(spark, [(0, "a", "b", 80, 100), (1, "a", "c", 80, 10)]))
    store.upsert("flows", FL.flow_table(flows))
    store.upsert("flows", FL.flow_table(flows).withColumn("byte_count", F.col("byte_count") * 2))
    assert sorted(r.byte_count for r in store.read("flows").collect()) == [20, 200]
    store.reset()
    assert store.read("flows").count() == 0


def test_streamed_alert_feed(spark, tmp_path):
    flows = FL.with_running_cardinalities(FL.flow_features(packets(spark, [(i * 0.01, "s", "t", i, 60, True) for i in range(12)])))
    alerts = A.flow_alerts(R.classify_by_rules(flows))
    alerts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.ALERTS).parquet(str(tmp_path / "in"))
    sinks.start_feed(stream, str(tmp_path / "feed"), str(tmp_path / "ck1")).awaitTermination(120)
    body = json.loads(spark.read.json(str(tmp_path / "feed")).first()["value"])
    assert body["type"] == "alert" and body["alert"]["threat_class"] == "PORT_SCAN"
    store = sinks.AlertStore(spark, str(tmp_path / "store"))
    store.upsert_stream("alerts", stream, str(tmp_path / "ck2")).awaitTermination(120)
    assert store.read("alerts").count() == alerts.count() == 3


def test_dns_calibration_is_saved(spark, tmp_path):
    bad = spark.createDataFrame([("xk29fj2q8z.net",), ("q9w8e7r6t5.net",), ("zzxqkvjw.org",)], "domain string")
    good = spark.createDataFrame([(1, "google.com"), (2, "facebook.com"), (3, "wikipedia.org")], "position long, domain string")
    N.calibrate(bad, good).save(str(tmp_path / "dns"))
    cal = N.DnsCalibration.load(spark, str(tmp_path / "dns"))
    assert {r.measure for r in cal.thresholds.collect()} == {"entropy", "ngram"}
    rows = [(1, "mail.google.com", "A", T0, "h"), (2, "xk29fj2q8z.net", "A", T0, "h"), (3, "x7q2z9kvw3.biz", "A", T0, "h")]
    queries = spark.createDataFrame(rows, "seq long, domain string, query_type string, timestamp timestamp, src_ip string")
    out = cal.classify(queries, seq="seq").orderBy("seq").collect()
    assert [r.reason for r in out[:2]] == ["allowlisted", "blocklist_match"] and out[2].flagged


def test_fixed_text_rounds_the_binary_value(spark):
    values = [0.125, 0.375, 2.5, 8285 / 1e6 * 1000, 6.055, 1.005, 6055000 / 1e6, -0.001, -2.675, 0.0, 1234567.125]
    values += [i / 1e6 * 1000 for i in range(5, 9995, 10)] + [i / 1e6 for i in range(5000, 9_000_000, 50_000)]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 1, 2):
        got = rows.select("x", A.fixed(F.col("x"), digits).alias("text")).collect()
        assert [(r.x, r.text) for r in got if r.text != f"{r.x:.{digits}f}"] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.text for r in odd.select(A.fixed(F.col("x"), 2).alias("text")).collect()] == [None, "nan", "inf", "-inf"]
