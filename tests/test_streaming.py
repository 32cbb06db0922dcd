"""Streams over split files must give what the batch operators give."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatspark.operators import alerts as A, behavior as B, dns as N, flows as FL, fusion as FU
from threatspark.plans import adapters as D
from threatspark.sources import records
from threatspark.streaming import stateful as ST

LAST = pd.Timestamp("1970-01-03")


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream(spark, df, time, parts=3):
    """The table as a stream of files in time order."""
    path = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    pdf = df.toPandas().sort_values(time).reset_index(drop=True)
    size = -(-len(pdf) // parts)
    for i in range(parts):
        piece = spark.createDataFrame(pdf.iloc[i * size : (i + 1) * size], df.schema).coalesce(1)
        piece.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, df, name):
    folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    q = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", folder).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(600)
    return spark.table(name).toPandas(), q


def equal(got, want, on, columns):
    got = got[columns].sort_values(on).reset_index(drop=True)
    want = want[columns].sort_values(on).reset_index(drop=True)
    for c in columns:
        if got[c].map(lambda v: hasattr(v, "__len__") and not isinstance(v, str)).any():
            got[c], want[c] = got[c].map(list), want[c].map(list)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-6)


def test_flows(spark, sf):
    packets = D.packets(spark, sf).drop("seq")
    tail = packets.limit(1).withColumns(
        {"timestamp": F.lit(LAST).cast("timestamp"), "src_ip": F.lit("end")}
    )  # moves the watermark past every real flow
    batch = FL.flow_features(packets).toPandas()
    columns = ["flow_id", "packet_count", "byte_count", "flow_duration", "iat_mean", "iat_std", "syn_count",
               "fwd_packet_length_min", "packets_per_second"]
    source = stream(spark, packets.unionByName(tail), "timestamp")
    got, _ = collect(spark, ST.flow_features(source), "flows_out")
    equal(got, batch, "flow_id", columns)
    got, _ = collect(spark, ST.flow_windows(source), "windows_out")
    equal(got, batch, "flow_id", [c for c in columns if c != "iat_std"])


def test_late_packets_are_dropped_and_counted(spark, sf):
    packets = D.packets(spark, sf).drop("seq")
    path = tempfile.mkdtemp(prefix="spark-late-", dir="/tmp")
    packets.coalesce(1).write.mode("append").parquet(path)
    # Windowed operators judge lateness by the watermark of the batch before, so one batch lies between.
    packets.limit(1).withColumn("timestamp", F.lit(LAST).cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    late = packets.limit(5).withColumn("timestamp", F.lit(pd.Timestamp("1970-01-01")).cast("timestamp"))
    late.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    noon = pd.Timestamp("1970-01-01 12:00")
    got, q = collect(spark, ST.flow_features(source, delay="1 second"), "late_out")
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 5
    assert len(got) and (got["timestamp"] > noon).all()
    got, _ = collect(spark, ST.flow_windows(source, delay="1 second"), "late_windows_out")
    assert len(got) and (got["timestamp"] > noon).all()


def test_behavior(spark, sf):
    rows = D.observations(spark, sf).withColumn("source_ip", F.concat(F.lit("h"), (F.col("flow_id") % 7).cast("string")))
    got, _ = collect(spark, ST.classify_behavior(stream(spark, rows, "timestamp")), "behavior_out")
    want = B.classify_behavior(rows).toPandas()
    equal(got, want, "flow_id", ["flow_id", "flow_count", "z_score", "status", "drift", "low_and_slow", "alert_triggered"])


def test_query_rates(spark, sf):
    rows = D.dns_queries(spark, sf).drop("t_us")
    got, _ = collect(spark, ST.query_rates(stream(spark, rows, "timestamp"), seq="seq"), "rates_out")
    equal(got, N.query_rates(rows, seq="seq").toPandas(), "seq", ["seq", "recent_queries"])


def test_fusion(spark, sf):
    rows = D.signals(spark, sf).withColumn("source_ip", F.concat(F.lit("s"), (F.col("seq") % 5).cast("string")))
    got, _ = collect(spark, ST.fuse(stream(spark, rows, "ts"), keep_suppressed=True), "fusion_out")
    want = FU.fuse(rows, keep_suppressed=True).toPandas()
    assert set(want["severity"]) == {"LOW", "HIGH", "SUPPRESSED"}
    equal(got, want, "seq", ["seq", "severity", "alert_type", "signals"])


def test_repeats(spark, sf):
    hits = D.events(spark, sf, D.DEDUP_SCALE).select("event_id", "event_type", "timestamp")
    out = ST.suppress_repeats(stream(spark, hits, "timestamp"), ["event_type"], "timestamp", "event_id", 5.0, keep_suppressed=True)
    got, _ = collect(spark, out, "repeats_out")
    want = A.suppress_repeats(hits, ["event_type"], "timestamp", ["event_id"], 5.0, keep_suppressed=True).toPandas()
    assert want["suppressed"].nunique() == 2
    equal(got, want, "event_id", ["event_id", "suppressed"])


def test_running_cardinalities(spark, sf):
    flows = FL.flow_features(D.packets(spark, sf)).select("flow_id", "timestamp", "src_ip", "dst_ip", "dst_port", "last_us")
    got, _ = collect(spark, ST.running_cardinalities(stream(spark, flows, "timestamp")), "cards_out")
    want = FL.with_running_cardinalities(flows).toPandas()
    equal(got, want, "flow_id", ["flow_id", "unique_destinations", "unique_dest_ports"])


def test_record_stream_feeds_the_flow_stream(spark, tmp_path):
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    base = {"src_ip": "a", "dst_ip": "b", "src_port": 1, "protocol": "TCP"}
    lines = [base | {"timestamp": f"2026-09-11T10:00:0{i}Z", "dst_port": 80, "packet_size": 10 * i} for i in range(4)]
    lines += [base | {"timestamp": "2026-09-11T10:00:01Z", "dst_port": 99999, "packet_size": 1}, {"x": 1}]
    (folder / "1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (folder / "2.jsonl").write_text(json.dumps(base | {"timestamp": "2026-09-11T11:00:00Z", "dst_port": 1, "packet_size": 1}))
    rows = records.read_packets(spark, str(folder), stream=True, maxFilesPerTrigger=1)
    got, _ = collect(spark, ST.flow_windows(records.accepted(rows)), "records_out")
    assert got[["packet_count", "byte_count", "flow_duration"]].values.tolist() == [[4, 60, 3_000_000.0]]
