"""Structured Streaming forms of the ordered operators.

Each is a keyed state machine on event time. Rows of a micro-batch are taken in ``(time, seq)`` order; rows
behind the watermark are dropped by Spark and counted in the query progress. Timers free idle keys.
State is a handful of scalars, or the entries of the open window in buckets of time (``windows``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threatspark import schemas as S
from threatspark.operators.behavior import baseline_step, with_behavior_verdict
from threatspark.operators.flows import FIVE_TUPLE
from threatspark.streaming.windows import BUCKETS, TrailingCounts, TrailingDistinct

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "event_us"  # the Python side renames columns that start with an underscore


def _micros(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _expiry_ms(t_us: int, width_us: int) -> int:
    """First whole millisecond after ``t_us + width_us``."""
    return (t_us + width_us) // 1000 + 1


class KeyedProcessor(StatefulProcessor):
    """Feeds rows in time order to ``step`` and keeps one value state between batches."""

    state_schema: str = ""
    columns: tuple[str, ...] = ()

    def __init__(self, names: Sequence[str], seq: str):
        self.names, self.seq = list(names), seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def begin(self):
        """Open the key's state."""
        return self.state.get() if self.state.exists() else None

    def finish(self, value, last_us: int) -> None:
        """Keep the key's state."""
        if value is not None:
            self.state.update(value)

    def step(self, value, row: dict) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if batch.empty:
            return
        batch = batch.sort_values([TIME, self.seq], kind="mergesort")
        value, out = self.begin(), []
        for row in batch.to_dict("records"):
            value, produced = self.step(value, row)
            out.extend(produced)
        self.finish(value, int(batch[TIME].iloc[-1]))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def expire_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def run(
    rows: DataFrame,
    keys: Sequence[str],
    time: str,
    delay: str,
    processor: KeyedProcessor,
    schema: T.StructType,
) -> DataFrame:
    timed = rows.withColumn(TIME, F.unix_micros(time)).withWatermark(time, delay)
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _schema(rows: DataFrame, keep: Sequence[str], **extra: T.DataType) -> T.StructType:
    return T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(n, t) for n, t in extra.items()]])


# --- flows ---------------------------------------------------------------------------------------------------------
class FlowProcessor(KeyedProcessor):
    state_schema = (
        "n long, bytes long, first long, last long, syn long, least long, gaps long, mean double, m2 double"
    )

    def __init__(self, names: Sequence[str], gap_us: int, identity: Sequence[str] = FIVE_TUPLE):
        super().__init__(names, TIME)
        self.gap, self.identity = gap_us, tuple(identity)

    def step(self, value, row):
        t, size, syn = int(row[TIME]), int(row["packet_size"]), int(bool(row["syn_flag"]))
        out = []
        if value is not None and t - value[3] > self.gap:
            out.append(self.emit(row, value))
            value = None
        if value is None:
            return (1, size, t, t, syn, size, 0, 0.0, 0.0), out
        n, total, first, last, syns, least, gaps, mean, m2 = value
        gap = float(abs(t - last)) if t < last else float(t - last)
        delta = gap - mean
        mean += delta / (gaps + 1)
        m2 += delta * (gap - mean)
        return (
            (n + 1, total + size, min(first, t), max(last, t), syns + syn, min(least, size), gaps + 1, mean, m2),
            out,
        )

    def emit(self, identity: dict, value) -> tuple:
        n, total, first, last, syns, least, gaps, mean, m2 = value
        std = (m2 / (gaps - 1)) ** 0.5 if gaps > 1 else 0.0
        return (*[identity[c] for c in self.identity], first, last, n, total, syns, least, std)

    def finish(self, value, last_us):
        self.state.update(value)
        self.expire_at(_expiry_ms(value[3], self.gap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            value = self.state.get()
            self.state.clear()
            yield pd.DataFrame([self.emit(dict(zip(FIVE_TUPLE, key)), value)], columns=self.names)


def flow_features(packets: DataFrame, gap_seconds: float = S.FLOW_GAP_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """Flows with features, each emitted once when its silence has outlasted the gap.

    Flows still open when the input ends stay in state; finite replays use the batch operator.
    """
    names = [*FIVE_TUPLE, "flow_start_us", "last_us", "packet_count", "byte_count", "syn_count",
             "fwd_packet_length_min", "iat_std"]
    longs = {n: T.LongType() for n in names[5:-1]}
    schema = _schema(packets, FIVE_TUPLE, **longs, iat_std=T.DoubleType())
    rows = packets.select(*FIVE_TUPLE, "timestamp", "packet_size", "syn_flag")
    raw = run(rows, FIVE_TUPLE, "timestamp", delay, FlowProcessor(names, _micros(gap_seconds)), schema)
    return finish_flows(raw)


def finish_flows(raw: DataFrame) -> DataFrame:
    """Derived features of closed flows, with the ids the batch operator gives."""
    from threatspark.functions.numeric import rate

    duration = (F.col("last_us") - F.col("flow_start_us")).cast("double")
    count = F.col("packet_count")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*FIVE_TUPLE, "flow_start_us")])
    return raw.select(
        F.concat(F.lit("f_"), F.md5(key)).alias("flow_id"),
        F.timestamp_micros("last_us").alias("timestamp"),
        *FIVE_TUPLE,
        "flow_start_us",
        "last_us",
        "packet_count",
        "byte_count",
        duration.alias("flow_duration"),
        rate(count, duration).alias("packets_per_second"),
        (F.col("byte_count") / count).alias("avg_packet_size"),
        F.when(count >= 2, duration / (count - 1)).otherwise(0.0).alias("iat_mean"),
        *(["iat_std"] if "iat_std" in raw.columns else []),
        "syn_count",
        rate(F.col("byte_count"), duration).alias("flow_bytes_per_second"),
        "fwd_packet_length_min",
        *(["closed"] if "closed" in raw.columns else []),
    )


def flow_windows(packets: DataFrame, gap_seconds: float = S.FLOW_GAP_SECONDS, delay: str = "10 seconds") -> DataFrame:
    """Closed flows by session windows: every feature that needs no packet order (all but ``iat_std``).

    Sessions are merged within each input partition before the shuffle, so a flow that carries much of
    the traffic arrives as a few partial rows.
    """
    timed = packets.withWatermark("timestamp", delay)
    t = F.unix_micros("timestamp")
    sessions = timed.groupBy(F.session_window("timestamp", f"{_micros(gap_seconds)} microseconds").alias("w"), *FIVE_TUPLE)
    closed = sessions.agg(
        F.min(t).alias("flow_start_us"),
        F.max(t).alias("last_us"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.col("packet_size").cast("long")).alias("byte_count"),
        F.sum(F.coalesce("syn_flag", F.lit(False)).cast("long")).alias("syn_count"),
        F.min(F.col("packet_size").cast("long")).alias("fwd_packet_length_min"),
    )
    return finish_flows(closed)


# --- behaviour -----------------------------------------------------------------------------------------------------
class DriftProcessor(KeyedProcessor):
    state_schema = "n long, mean double, variance double"

    def __init__(self, names, keep, seq, value, alpha, warmup, z_limit):
        super().__init__(names, seq)
        self.keep, self.value, self.alpha, self.warmup, self.z_limit = keep, value, alpha, warmup, z_limit

    def step(self, state, row):
        n, mean, variance = state if state is not None else (0, 0.0, 0.0)
        z, scored, mean, variance = baseline_step(n, mean, variance, float(row[self.value]), self.alpha, self.warmup)
        status = "SCORED" if scored else "INSUFFICIENT_HISTORY"
        result = (*[row[c] for c in self.keep], n + 1, z, status, z > self.z_limit, mean, variance)
        return (n + 1, mean, variance), [result]


def classify_behavior(
    observations: DataFrame,
    *,
    seq: str = "flow_id",
    alpha: float = S.EWMA_ALPHA,
    warmup: int = S.BASELINE_MIN_FLOWS,
    z_limit: float = S.Z_LIMIT,
    delay: str = "10 seconds",
) -> DataFrame:
    """Behavioural verdicts with a baseline per source that lives as long as the query."""
    keep = list(observations.columns)
    scores = dict(flow_count=T.LongType(), z_score=T.DoubleType(), status=T.StringType(), drift=T.BooleanType(),
                  ewma_mean=T.DoubleType(), ewma_variance=T.DoubleType())
    schema = _schema(observations, keep, **scores)
    processor = DriftProcessor([*keep, *scores], keep, seq, "byte_count", alpha, warmup, z_limit)
    return with_behavior_verdict(run(observations, ["source_ip"], "timestamp", delay, processor, schema))


# --- windows over instants ------------------------------------------------------------------------------------------
class WindowProcessor(KeyedProcessor):
    """Trailing window as bucketed counts; subclasses turn the counts into an output row."""

    state_schema = "last long"

    def __init__(self, names, keep, seq, width_us, hold_us):
        super().__init__(names, seq)
        self.keep, self.width, self.hold = keep, width_us, hold_us

    def init(self, handle):
        super().init(handle)
        self.window = TrailingCounts(handle, "window", self.width)

    def begin(self):
        self.window.begin()
        return self.state.get()[0] if self.state.exists() else None

    def finish(self, value, last_us):
        self.window.finish()
        if value is not None:
            self.state.update((value,))
        self.expire_at(_expiry_ms(last_us, self.hold))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()
        self.state.clear()
        return iter(())


class RateProcessor(WindowProcessor):
    def step(self, value, row):
        counts = self.window.add(int(row[TIME]), "")
        return value, [(*[row[c] for c in self.keep], counts[""])]


def query_rates(
    queries: DataFrame, *, seq: str, window_seconds: float = S.DNS_WINDOW_SECONDS, delay: str = "10 seconds"
) -> DataFrame:
    """Queries of the source in the closed trailing window of each query."""
    keep = list(queries.columns)
    schema = _schema(queries, keep, recent_queries=T.LongType())
    width = _micros(window_seconds)
    processor = RateProcessor([*keep, "recent_queries"], keep, seq, width, width)
    return run(queries, ["src_ip"], "timestamp", delay, processor, schema)


class FusionProcessor(WindowProcessor):
    def __init__(self, names, keep, width_us, cooldown_us):
        super().__init__(names, keep, "seq", width_us, max(width_us, cooldown_us))
        self.cooldown = cooldown_us

    def step(self, last, row):
        t = int(row[TIME])
        present = sorted(self.window.add(t, row["signal_type"]))
        if len(present) < 2:
            severity, kind = "LOW", f"{row['signal_type']}_DETECTION"
        else:
            fresh = last is None or t - last >= self.cooldown
            severity, kind = ("HIGH" if fresh else "SUPPRESSED"), S.DATA_EXFILTRATION
            last = t if fresh else last
        return last, [(*[row[c] for c in self.keep], present, severity, kind)]


def fuse(
    signals: DataFrame,
    window_seconds: float = S.FUSION_WINDOW_SECONDS,
    cooldown_seconds: float | None = None,
    *,
    keep_suppressed: bool = False,
    delay: str = "10 seconds",
) -> DataFrame:
    """Fusion outcome per signal, as the batch operator gives it."""
    cooldown = window_seconds if cooldown_seconds is None else cooldown_seconds
    keep = ["source_ip", "ts", "seq", "signal_type", "flow_id"]
    extra = dict(signals=T.ArrayType(T.StringType()), severity=T.StringType(), alert_type=T.StringType())
    schema = _schema(signals, keep, **extra)
    processor = FusionProcessor([*keep, *extra], keep, _micros(window_seconds), _micros(cooldown))
    out = run(signals.select(*keep), ["source_ip"], "ts", delay, processor, schema)
    return out if keep_suppressed else out.where(F.col("severity") != "SUPPRESSED")


# --- repetition and cardinality ---------------------------------------------------------------------------------------
class RepeatProcessor(KeyedProcessor):
    state_schema = "last long"

    def __init__(self, names, keep, seq, width_us):
        super().__init__(names, seq)
        self.keep, self.width = keep, width_us

    def step(self, value, row):
        t = int(row[TIME])
        repeat = value is not None and t - value[0] < self.width
        return (t,), [(*[row[c] for c in self.keep], repeat)]

    def finish(self, value, last_us):
        super().finish(value, last_us)
        self.expire_at(_expiry_ms(last_us, self.width))


def suppress_repeats(
    hits: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    window_seconds: float = S.DEDUP_SECONDS,
    *,
    keep_suppressed: bool = False,
    delay: str = "10 seconds",
) -> DataFrame:
    keep = list(hits.columns)
    schema = _schema(hits, keep, suppressed=T.BooleanType())
    out = run(hits, keys, time, delay, RepeatProcessor([*keep, "suppressed"], keep, seq, _micros(window_seconds)), schema)
    return out if keep_suppressed else out.where(~F.col("suppressed")).drop("suppressed")


class CardinalityProcessor(KeyedProcessor):
    """Destinations and ports that a source has met, ever or within a time to live of event time."""

    state_schema = "newest long"

    def __init__(self, names, keep, seq, ttl_us):
        super().__init__(names, seq)
        self.keep, self.ttl = keep, ttl_us

    def init(self, handle):
        super().init(handle)
        self.seen = [TrailingDistinct(handle, name, self.ttl) for name in ("dst", "port")]

    def begin(self):
        for window in self.seen:
            window.begin()

    def step(self, value, row):
        t = int(row[TIME])
        counts = [window.add(t, str(x)) for window, x in zip(self.seen, (row["dst_ip"], int(row["dst_port"])))]
        return value, [(*[row[c] for c in self.keep], *counts)]

    def finish(self, value, last_us):
        for window in self.seen:
            window.finish()
        if self.ttl is not None:
            self.expire_at(_expiry_ms(last_us, self.ttl))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Take back what event time has left behind, and wake again for what remains."""
        now = timerValues.getCurrentWatermarkInMs()
        self.begin()
        left = [window.expire(now * 1000 - self.ttl) for window in self.seen]
        for window in self.seen:
            window.finish()
        if any(left):
            self.handle.registerTimer(now + max(1, self.ttl // 1000 // BUCKETS))
        return iter(())


def running_cardinalities(flows: DataFrame, delay: str = "10 seconds", ttl_seconds: float | None = None) -> DataFrame:
    """Destinations and ports a source has contacted up to each flow, in close order.

    With ``ttl_seconds`` only contacts of the closed window of that width count, as in a trailing distinct count.
    """
    keep = list(flows.columns)
    schema = _schema(flows, keep, unique_destinations=T.LongType(), unique_dest_ports=T.LongType())
    names = [*keep, "unique_destinations", "unique_dest_ports"]
    ttl = None if ttl_seconds is None else _micros(ttl_seconds)
    return run(flows, ["src_ip"], "timestamp", delay, CardinalityProcessor(names, keep, "flow_id", ttl), schema)
