"""Directional flows from packets, and the features of each flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threatspark import skew
from threatspark.functions.numeric import rate
from threatspark.schemas import FLOW_GAP_SECONDS

FIVE_TUPLE = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def sessionize(packets: DataFrame, gap_seconds: float = FLOW_GAP_SECONDS, *, chunk_rows: int | None = None) -> DataFrame:
    """Packet rows with ``flow_start_us`` and ``gap_us`` (time since the flow's previous packet).

    A flow ends when its 5-tuple stays silent for more than ``gap_seconds``. If a 5-tuple is hot, packets
    of one instant are added up first, so copies of one packet shrink to a row with a count ``n``.
    """
    gap_us = int(round(gap_seconds * 1_000_000))
    rows = packets.select(
        *FIVE_TUPLE,
        F.unix_micros("timestamp").alias("ts_us"),
        F.lit(1).cast("long").alias("n"),
        F.col("packet_size").cast("long").alias("bytes"),
        F.col("packet_size").cast("long").alias("min_size"),
        F.coalesce(F.col("syn_flag"), F.lit(False)).cast("long").alias("syn"),
    )
    ch = skew.chunked(rows, FIVE_TUPLE, ["ts_us"], chunk_rows=chunk_rows)
    if ch.hot:
        rows = rows.groupBy(*FIVE_TUPLE, "ts_us").agg(
            F.sum("n").alias("n"),
            F.sum("bytes").alias("bytes"),
            F.min("min_size").alias("min_size"),
            F.sum("syn").alias("syn"),
        )
        ch = skew.chunked(rows, FIVE_TUPLE, ["ts_us"], chunk_rows=chunk_rows)
    ch = skew.with_previous(ch, ["ts_us"])
    gap = F.col("ts_us") - F.col("prev_ts_us")
    opens = gap.isNull() | (gap > gap_us)
    ch = ch.replace(ch.df.withColumn("gap_us", F.when(~opens, gap)).drop("prev_ts_us"))
    ch = skew.with_running(ch, maxima={"flow_start_us": F.when(F.col("gap_us").isNull(), F.col("ts_us"))})
    return ch.done()


def flow_features(packets: DataFrame, gap_seconds: float = FLOW_GAP_SECONDS, *, chunk_rows: int | None = None) -> DataFrame:
    """One row per flow: identity, first and last packet time, and the per-flow features."""
    return features_of_sessions(sessionize(packets, gap_seconds, chunk_rows=chunk_rows))


def features_of_sessions(rows: DataFrame) -> DataFrame:
    flows = rows.groupBy(*FIVE_TUPLE, "flow_start_us").agg(
        F.sum("n").alias("packet_count"),
        F.sum("bytes").alias("byte_count"),
        F.max("ts_us").alias("last_us"),
        F.sum("syn").alias("syn_count"),
        F.min("min_size").alias("fwd_packet_length_min"),
        F.count("gap_us").alias("_gaps"),
        F.avg("gap_us").alias("_gap_mean"),
        F.var_pop("gap_us").alias("_gap_var"),
    )
    return _derive(flows)


def _derive(flows: DataFrame) -> DataFrame:
    duration = (F.col("last_us") - F.col("flow_start_us")).cast("double")
    count = F.col("packet_count")
    # Gaps of packets that share an instant are zero; they were not rows, so they are added by formula.
    gaps = count - 1
    zeros = gaps - F.col("_gaps")
    squares = F.col("_gap_var") * F.col("_gaps") + F.col("_gap_mean") * F.col("_gap_mean") * F.col(
        "_gaps"
    ) * zeros / F.greatest(gaps, F.lit(1))
    flow_key = F.concat_ws("|", *[F.col(c).cast("string") for c in FIVE_TUPLE], F.col("flow_start_us").cast("string"))
    return flows.select(
        F.concat(F.lit("f_"), F.md5(flow_key)).alias("flow_id"),
        F.timestamp_micros("last_us").alias("timestamp"),
        *FIVE_TUPLE,
        "flow_start_us",
        "last_us",
        "packet_count",
        "byte_count",
        duration.alias("flow_duration"),
        rate(count, duration).alias("packets_per_second"),
        (F.col("byte_count") / count).alias("avg_packet_size"),
        F.when(count >= 2, duration / gaps).otherwise(F.lit(0.0)).alias("iat_mean"),
        F.when(gaps >= 2, F.sqrt(F.coalesce(squares, F.lit(0.0)) / (gaps - 1))).otherwise(F.lit(0.0)).alias("iat_std"),
        "syn_count",
        rate(F.col("byte_count"), duration).alias("flow_bytes_per_second"),
        "fwd_packet_length_min",
    )


def source_cardinalities(flows: DataFrame) -> DataFrame:
    """Distinct destinations and ports per source over the whole batch."""
    return flows.groupBy("src_ip").agg(
        F.count_distinct("dst_ip").alias("unique_destinations"),
        F.count_distinct("dst_port").alias("unique_dest_ports"),
    )


def with_batch_cardinalities(flows: DataFrame) -> DataFrame:
    """Attach the batch cardinalities of the source to each of its flows."""
    return flows.join(source_cardinalities(flows), "src_ip")


def with_running_cardinalities(flows: DataFrame, *, chunk_rows: int | None = None) -> DataFrame:
    """Destinations and ports a source has contacted up to and including each flow, in close order."""
    order = ["last_us", "flow_id"]
    ch = skew.chunked(flows, ["src_ip"], order, chunk_rows=chunk_rows, settle=True)
    names = {"unique_destinations": "dst_ip", "unique_dest_ports": "dst_port"}
    if not ch.hot:
        # One exchange on the source serves all three windows.
        rows = ch.df.repartition("src_ip")
        for name, column in names.items():
            first = Window.partitionBy("src_ip", column).orderBy(*order)
            rows = rows.withColumn(f"_{name}", (F.row_number().over(first) == 1).cast("long"))
        ch = skew.Chunked(rows, ("src_ip",), tuple(order), False)
    else:
        rows = ch.df
        for name, column in names.items():
            earliest = ch.df.groupBy("src_ip", column).agg(F.min(F.struct(*order)).alias("_o"))
            firsts = earliest.select(F.col("_o.flow_id").alias("flow_id"), F.lit(1).cast("long").alias(f"_{name}"))
            rows = rows.join(firsts, "flow_id", "left")
        ch = ch.replace(rows)
    ch = skew.with_running(ch, sums={n: F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("long") for n in names})
    return ch.done().drop(*[f"_{n}" for n in names])


def open_flows(flows: DataFrame, gap_seconds: float = FLOW_GAP_SECONDS) -> DataFrame:
    """Flows that may still grow: last packet no older than the gap before the newest packet."""
    newest = flows.agg(F.max("last_us")).scalar()
    return flows.where(F.col("last_us") >= newest - int(round(gap_seconds * 1_000_000)))


def find_flow(flows: DataFrame, src_ip: str, dst_ip: str, src_port: int, dst_port: int, protocol: str) -> DataFrame:
    """All flows of one 5-tuple."""
    values = dict(zip(FIVE_TUPLE, (src_ip, dst_ip, src_port, dst_port, protocol)))
    out = flows
    for name, value in values.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def flow_table(flows: DataFrame) -> DataFrame:
    """Stored form of the flows."""
    return flows.select(
        "flow_id",
        "timestamp",
        *FIVE_TUPLE,
        F.col("flow_duration").alias("duration"),
        "packet_count",
        "byte_count",
    )


def metadata_flows(records: DataFrame, protocol: str, dst_port: int) -> DataFrame:
    """Flow rows standing for DNS or TLS records: one packet, no bytes, empty destination."""
    return records.select(
        "flow_id",
        "timestamp",
        "src_ip",
        F.lit("").alias("dst_ip"),
        F.lit(0).cast("long").alias("src_port"),
        F.lit(dst_port).cast("long").alias("dst_port"),
        F.lit(protocol).alias("protocol"),
        F.lit(0.0).alias("duration"),
        F.lit(1).cast("long").alias("packet_count"),
        F.lit(0).cast("long").alias("byte_count"),
    )


def event_rate(rows: DataFrame, time: str = "timestamp", window_seconds: int = 5, slide_seconds: int = 1) -> DataFrame:
    """Events per second in sliding windows, one decimal."""
    return (
        rows.groupBy(F.window(time, f"{window_seconds} seconds", f"{slide_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "events",
            F.round(F.col("events") / float(window_seconds), 1).alias("per_second"),
        )
    )


def last_n_mean(
    rows: DataFrame, keys: list[str], order: list[str], value: str, n: int = 100, *, chunk_rows: int | None = None
) -> DataFrame:
    """Mean of the last ``n`` values per key, the current row included."""
    ch = skew.chunked(rows, keys, order, chunk_rows=chunk_rows)
    if not ch.hot:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
        return rows.withColumn("last_n_mean", F.avg(value).over(frame))
    # Exact blocks by row number; the last n - 1 rows of a block also lead into the next one.
    block = max(10 * n, 10_000)
    numbered = skew.with_running(ch, sums={"_rn": F.lit(1).cast("long")}).done()
    own = numbered.withColumn("_block", F.floor((F.col("_rn") - 1) / block)).withColumn("_own", F.lit(True))
    lead = own.where((F.col("_rn") - 1) % block > block - n)
    lead = lead.withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False))
    frame = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(1 - n, 0)
    return (
        own.unionByName(lead)
        .withColumn("last_n_mean", F.avg(value).over(frame))
        .where("_own")
        .drop("_rn", "_block", "_own")
    )
