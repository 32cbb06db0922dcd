"""The detection pipeline as one stream: flows, state of the source, decision and suppression, chained in one query.

Three stateful operators follow each other. The first one keeps packets until the watermark has passed them, so that it and all
that come after it see rows in the order of the batch operators, whatever order they arrive in within the allowed delay. A row
leaves with a time of its own, ``closed``, that lies just past the watermark: the next operator takes its event time from it, and
no row is late there. Order inside a source is kept, because a flow leaves as soon as the watermark passes its last packet by
more than the gap, and flows of one source do so in the order of their last packets.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from threatspark import schemas as S
from threatspark.operators import alerts as A, detection as DT
from threatspark.operators.behavior import baseline_step
from threatspark.operators.flows import FIVE_TUPLE
from threatspark.session import ensure_checkpoint_dir
from threatspark.streaming import stateful as ST
from threatspark.streaming.windows import BUCKETS, TrailingDistinct

CLOSED = "closed"
RAW_FLOW = (*FIVE_TUPLE, "flow_start_us", "last_us", "packet_count", "byte_count", "syn_count", "fwd_packet_length_min", "iat_std", CLOSED)
#: Groups that 5-tuples, sources and hits are dealt to by hash, so that a call of an operator and its state serve many keys at once; and
#: entries in one piece of a group's state.
SLOTS, PIECE = 512, 10_000


def _ceil_ms(t_us: int) -> int:
    return -(-t_us // 1000)


def _closed(watermark_ms: int) -> pd.Timestamp:
    return pd.Timestamp((watermark_ms + 1) * 1_000_000)


def _slot(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


class _Pieces:
    """List state that is read and written as a whole, as text in pieces."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getListState(name, "piece string")

    @staticmethod
    def _cut(entries: list) -> list[tuple[str]]:
        return [(json.dumps(entries[at : at + PIECE]),) for at in range(0, len(entries), PIECE)]

    def read(self) -> list:
        return [x for (piece,) in (self.state.get() if self.state.exists() else ()) for x in json.loads(piece)]

    def append(self, entries: list) -> None:
        self.state.appendList(self._cut(entries))

    def put(self, entries: list) -> None:
        if entries:
            self.state.put(self._cut(entries))
        else:
            self.state.clear()


def _wake(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer a slot: the earliest moment at which something can happen."""
    timers = list(handle.listTimers())
    if not timers or at_ms < min(timers):
        for t in timers:
            handle.deleteTimer(t)
        handle.registerTimer(at_ms)


class OrderedFlows(StatefulProcessor):
    """Packets of a slot of 5-tuples to flows, in event time.

    A slot holds all 5-tuples of one hash, so that calls and state are dealt with by the slot and not for every 5-tuple. State: the
    open flows as a few numbers each, and the packets that the watermark has not passed yet, both as text in pieces. A packet
    without size only moves the watermark.
    """

    def __init__(self, gap_us: int) -> None:
        self.gap = gap_us
        self.steps = ST.FlowProcessor(("five", *RAW_FLOW[5:-1]), gap_us, ["five"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.waiting = (_Pieces(handle, name) for name in ("open", "waiting"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch[batch["packet_size"].notna()]
            if len(batch):
                syns = [bool(syn) if syn is not None else False for syn in batch["syn_flag"]]
                packets = list(zip(map(int, batch[ST.TIME]), batch["five"], map(int, batch["packet_size"]), syns))
                self.waiting.append(packets)
                earliest = min(t for t, *_ in packets)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            _wake(self.handle, max(_ceil_ms(first), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        passed = now * 1000
        waiting = sorted(self.waiting.read(), key=lambda p: p[0])
        cut = bisect_right(waiting, passed, key=lambda p: p[0])
        ready, rest = waiting[:cut], waiting[cut:]
        flows = {five: value for five, *value in self.open.read()}
        out = []
        for t, five, size, syn in ready:
            flows[five], closed = self.steps.step(flows.get(five), {"five": five, ST.TIME: t, "packet_size": size, "syn_flag": syn})
            out.extend(closed)
        for five, value in [(f, v) for f, v in flows.items() if passed > v[3] + self.gap]:
            out.append(self.steps.emit({"five": five}, value))
            del flows[five]
        if ready:
            self.waiting.put(rest)
        self.open.put([(five, *value) for five, value in flows.items()])
        coming = [_ceil_ms(t) for t, *_ in rest[:1]] + ([ST._expiry_ms(min(v[3] for v in flows.values()), self.gap)] if flows else [])
        if coming:
            self.handle.registerTimer(max(min(coming), now + 1))
        if out:
            yield pd.DataFrame([(*row, _closed(now)) for row in out], columns=["five", *RAW_FLOW[5:]])

    def close(self) -> None:
        pass


class _OfSource:
    """State of one source inside a slot: a value, or a map, whose keys begin with the source."""

    def __init__(self, state: MapState) -> None:
        self.state, self.at = state, ()

    def exists(self) -> bool:
        return self.state.containsKey(self.at)

    def get(self) -> tuple:
        return self.state.getValue(self.at)

    def update(self, value: tuple) -> None:
        self.state.updateValue(self.at, value)

    def containsKey(self, key: tuple) -> bool:
        return self.state.containsKey((*self.at, *key))

    def getValue(self, key: tuple) -> tuple:
        return self.state.getValue((*self.at, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.state.updateValue((*self.at, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.state.removeKey((*self.at, *key))


class _Sources:
    """A handle whose states are those of the source chosen by ``turn_to``."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.made = handle, []

    def getValueState(self, name: str, schema: str) -> _OfSource:
        self.made.append(_OfSource(self.handle.getMapState(name, "source string", schema)))
        return self.made[-1]

    def getMapState(self, name: str, key: str, value: str) -> _OfSource:
        self.made.append(_OfSource(self.handle.getMapState(name, f"source string, {key}", value)))
        return self.made[-1]

    def turn_to(self, source: str | None) -> None:
        for state in self.made:
            state.at = (json.dumps(source),)


class SourceState(StatefulProcessor):
    """What a source has done up to each of its flows: destinations and ports contacted, and the volume baseline.

    Sources come in slots; with a time to live every source is a slot of its own, ``slot`` is its name then.
    """

    ADDED = ("unique_destinations", "unique_dest_ports", "z_score", "drift")

    def __init__(self, names: list[str], settings: DT.Settings, ttl_us: int | None) -> None:
        self.names, self.settings, self.ttl = names, settings, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sources = handle, _Sources(handle)
        self.baseline = self.sources.getValueState("baseline", "n long, mean double, variance double")
        self.seen = [TrailingDistinct(self.sources, name, self.ttl) for name in ("dst", "port")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["src_ip", "last_us", "flow_id"], kind="mergesort", ignore_index=True)
        out = []
        for source, flows in groupby(batch[["src_ip", "last_us", "dst_ip", "dst_port", "byte_count"]].itertuples(index=False), key=lambda row: row.src_ip):
            out.extend(self._added(source, flows))
        if self.ttl is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self._rest_ms())
        added = pd.DataFrame(out, columns=list(self.ADDED), index=batch.index)
        yield pd.concat([batch, added], axis=1)[self.names]

    def _added(self, source: str | None, flows: Iterator) -> Iterator[tuple]:
        """The state that each flow of a source finds, its own contacts included."""
        self.sources.turn_to(source)
        n, mean, variance = self.baseline.get() if self.baseline.exists() else (0, 0.0, 0.0)
        how = self.settings
        for window in self.seen:
            window.begin()
        for row in flows:
            z, _, mean, variance = baseline_step(n, mean, variance, float(row.byte_count), how.alpha, how.warmup)
            n += 1
            counts = [window.add(int(row.last_us), str(x)) for window, x in zip(self.seen, (row.dst_ip, row.dst_port))]
            yield (*counts, z, z > how.z_limit)
        self.baseline.update((n, mean, variance))
        for window in self.seen:
            window.finish()

    def _rest_ms(self) -> int:
        return max(1, self.ttl // 1000 // BUCKETS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Take back contacts that no flow to come can still count: such a flow has ended a gap before the watermark at most."""
        now = timerValues.getCurrentWatermarkInMs()
        left = 0
        self.sources.turn_to(key[0])
        for window in self.seen:
            window.begin()
            left += window.expire(now * 1000 - ST._micros(self.settings.gap_seconds) - self.ttl)
            window.finish()
        if left:
            self.handle.registerTimer(now + self._rest_ms())
        return iter(())

    def close(self) -> None:
        pass


class Suppression(StatefulProcessor):
    """Repeats of a source and threat class, in slots. State outlasts the window by the gap: a flow of that time may still be open."""

    def __init__(self, names: list[str], width_us: int, hold_us: int) -> None:
        self.names, self.width, self.hold = names, width_us, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.hits = handle, _Pieces(handle, "hits")

    def _ends(self, last_us: int) -> int:
        return ST._expiry_ms(last_us, self.width + self.hold)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["last_us", "flow_id"], kind="mergesort", ignore_index=True)
        lasts, repeats = {(source, kind): last for source, kind, last in self.hits.read()}, []
        for source, kind, t in zip(batch["src_ip"], batch["threat_class"], map(int, batch["last_us"])):
            last = lasts.get((source, kind))
            repeats.append(last is not None and t - last < self.width)
            lasts[source, kind] = t
        self.hits.put([(*who, last) for who, last in lasts.items()])
        _wake(self.handle, self._ends(min(lasts.values())))
        yield batch.assign(suppressed=repeats)[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = [(source, kind, last) for source, kind, last in self.hits.read() if self._ends(last) > now]
        self.hits.put(kept)
        if kept:
            self.handle.registerTimer(self._ends(min(last for *_, last in kept)))
        return iter(())

    def close(self) -> None:
        pass


def _stage(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", eventTimeColumnName=CLOSED
    )


def flows(packets: DataFrame, settings: DT.Settings = DT.Settings(), delay: str = "10 seconds") -> DataFrame:
    """Flows with features in close order; ``closed`` carries the event time on."""
    five = packets.select(*FIVE_TUPLE).schema
    schema = T.StructType([T.StructField("five", T.StringType()), *[T.StructField(n, T.LongType()) for n in RAW_FLOW[5:-2]],
                           T.StructField("iat_std", T.DoubleType()), T.StructField(CLOSED, T.TimestampType())])
    timed = packets.select(
        _slot(*FIVE_TUPLE).alias("slot"), F.to_json(F.struct(*FIVE_TUPLE)).alias("five"),
        "timestamp", "packet_size", "syn_flag", F.unix_micros("timestamp").alias(ST.TIME),
    ).withWatermark("timestamp", delay)
    raw = _stage(timed, ["slot"], OrderedFlows(ST._micros(settings.gap_seconds)), schema)
    raw = raw.withColumn("five", F.from_json("five", five)).select("five.*", *RAW_FLOW[5:])
    return ST.finish_flows(raw)


def with_state(flow_rows: DataFrame, settings: DT.Settings = DT.Settings(), ttl_seconds: float | None = None) -> DataFrame:
    """Flows with the state of their source.

    With ``ttl_seconds`` a destination or port counts only while the source has contacted it within that time; entries go, and
    the counts with them, as event time moves on.
    """
    keep = flow_rows.columns
    schema = ST._schema(flow_rows, keep, unique_destinations=T.LongType(), unique_dest_ports=T.LongType(), z_score=T.DoubleType(), drift=T.BooleanType())
    ttl = None if ttl_seconds is None else ST._micros(ttl_seconds)
    slotted = flow_rows.withColumn("slot", _slot("src_ip") if ttl is None else F.col("src_ip"))
    rows = _stage(slotted, ["slot"], SourceState([*keep, *SourceState.ADDED], settings, ttl), schema)
    slow = DT.is_slow(settings)
    return rows.withColumns({"low_and_slow": slow, "alert_triggered": F.col("drift") | slow})


def detect(packets: DataFrame, settings: DT.Settings = DT.Settings(), *, ttl_seconds: float | None = None, delay: str = "10 seconds") -> DataFrame:
    """Alerts of a packet stream, each as soon as event time has passed the flow's end: behaviour and rules, repeats suppressed."""
    decided = DT.decide(with_state(flows(packets, settings, delay), settings, ttl_seconds), None, settings)
    hits = decided.where(F.col("threat_class") != S.BENIGN)
    keep = hits.columns
    schema = ST._schema(hits, keep, suppressed=T.BooleanType())
    processor = Suppression([*keep, "suppressed"], ST._micros(settings.dedup_seconds), ST._micros(settings.gap_seconds))
    first = _stage(hits.withColumn("slot", _slot("src_ip", "threat_class")), ["slot"], processor, schema).where("NOT suppressed")
    return A.flow_alerts(first)


def replay(packets: DataFrame, settings: DT.Settings = DT.Settings(), *, parts: int = 2, **how) -> DataFrame:
    """Alerts of a finite packet table, sent through the stream in pieces of time order and read back from its sink.

    Each piece is written to the shared folder and the query is started again from its checkpoint, as after a stop; the last
    piece is a heartbeat that takes the watermark past every flow. Source, state and sink are those of a live query.
    """
    spark = packets.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    last = packets.agg(F.max("timestamp")).first()[0]
    if last is None:
        return spark.createDataFrame([], S.ALERTS)
    at = F.unix_micros("timestamp")
    cuts = packets.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 100)).first()[0] if parts > 1 else []
    piece = F.lit(0)
    for c in cuts:
        piece = piece + (at > c).cast("int")
    beat = packets.limit(1).withColumns({"timestamp": F.lit(last).cast("timestamp") + F.expr("INTERVAL 3650 DAYS"), "packet_size": F.lit(None).cast(packets.schema["packet_size"].dataType)})
    key = "spark.sql.streaming.stateStore.providerClass"
    provider = spark.conf.get(key, None)
    spark.conf.set(key, ST.ROCKSDB)
    try:
        for rows in [*(packets.where(piece == i) for i in range(parts)), beat]:
            rows.write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(packets.schema).parquet(f"{place}/in")
            query = (
                detect(stream, settings, **how).writeStream.format("parquet").outputMode("append")
                .option("path", f"{place}/alerts").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
            )
            query.awaitTermination()
    finally:
        spark.conf.set(key, provider) if provider else spark.conf.unset(key)
    return spark.read.schema(S.ALERTS).parquet(f"{place}/alerts")
