"""A call of a streamed operator serves many keys at once, with the results of each key alone."""

import json
from types import SimpleNamespace

import pandas as pd

from threatspark.operators import detection as DT
from threatspark.streaming import chain
from threatspark.streaming.windows import TrailingDistinct
from tests.test_detection import Handle as Keyed, Map


class List:
    kept = ()

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept)

    def put(self, values):
        self.kept = tuple(values)

    def appendList(self, values):
        self.kept = (*self.kept, *values)

    def clear(self):
        self.kept = ()


class Handle(Keyed):
    def __init__(self):
        super().__init__()
        self.timers = set()
        self.listTimers = lambda: iter(sorted(self.timers))
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getListState(self, name, *_):
        return self.states.setdefault(name, List())


def opened(processor):
    processor.init(handle := Handle())
    return processor, handle


def at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def test_flows_of_many_5_tuples_in_one_call():
    fives = [json.dumps({"src_ip": f"h{i}", "dst_port": i}) for i in range(2000)]
    rows = [(five, t * 1000, 10, t == 0) for i, five in enumerate(fives) for t in (0, 3000, 9000 + i)]
    packets = pd.DataFrame(rows, columns=["five", chain.ST.TIME, "packet_size", "syn_flag"])
    flows, handle = opened(chain.OrderedFlows(5_000_000))
    assert list(flows.handleInputRows((0,), iter([packets]), at(0))) == [] and len(handle.timers) == 1
    handle.timers.clear()
    first = pd.concat(flows.handleExpiredTimer((0,), at(10_000), None))
    assert sorted(first["five"]) == sorted(fives) and set(first["packet_count"]) == {2} and set(first["syn_count"]) == {1}
    assert len(handle.states["open"].kept) == 1 and len(handle.states["waiting"].kept) == 1  # 1 001 flows and 999 packets as text
    handle.timers.clear()
    rest = pd.concat(flows.handleExpiredTimer((0,), at(30_000), None))
    assert len(rest) == 2000 and set(rest["packet_count"]) == {1} and not handle.timers and not handle.states["open"].kept


def test_sources_of_a_slot_keep_apart():
    names = ["src_ip", "last_us", "flow_id", "dst_ip", "dst_port", "byte_count", *chain.SourceState.ADDED]
    rows = [(f"h{i % 3}", i * 1000, f"f{i:03}", f"d{i % 4}", i % 5, 100 + i * i % 17) for i in range(90)]
    flows = pd.DataFrame(rows, columns=names[:6])

    def run(parts):
        state, _ = opened(chain.SourceState(names, DT.Settings(), None))
        return pd.concat([out for part in parts for out in state.handleInputRows((0,), iter([part]), at(0))]).sort_values("flow_id", ignore_index=True)

    together = run([flows[:40], flows[40:]])
    alone = pd.concat([run([mine[:7], mine[7:]]) for _, mine in flows.groupby("src_ip")]).sort_values("flow_id", ignore_index=True)
    pd.testing.assert_frame_equal(together, alone)
    assert together["unique_destinations"].max() == 4 and together["unique_dest_ports"].max() == 5


def test_repeats_of_a_slot():
    rows = [("h1", "A", 0, "f0"), ("h2", "A", 1, "f1"), ("h1", "A", 9_999_999, "f2"), ("h1", "B", 9_999_999, "f3"), ("h2", "A", 10_000_001, "f4")]
    hits = pd.DataFrame(rows, columns=["src_ip", "threat_class", "last_us", "flow_id"])
    repeats, handle = opened(chain.Suppression([*hits.columns, "suppressed"], 10_000_000, 5_000_000))
    got = pd.concat(repeats.handleInputRows((0,), iter([hits[::-1]]), at(0)))
    assert dict(zip(got["flow_id"], got["suppressed"])) == {"f0": False, "f1": False, "f2": True, "f3": False, "f4": False}
    list(repeats.handleExpiredTimer((0,), at(25_000), None))
    assert json.loads(handle.states["hits"].kept[0][0]) == [["h2", "A", 10_000_001]]
    list(repeats.handleExpiredTimer((0,), at(26_000), None))
    assert not handle.states["hits"].kept


def test_a_value_is_written_once_a_batch():
    seen = TrailingDistinct(Handle(), "w", None)
    Map.writes = 0
    seen.begin()
    assert [seen.add(t, "ab"[t % 2]) for t in range(100)][-1] == 2
    seen.finish()
    assert Map.writes == 2
