"""The alert store: upserts touch their partitions only, and the newest form of an id is read."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from threatspark import schemas as S
from threatspark.sources import sinks


def flow(i, day, size=1, hour=0):
    t = datetime.datetime(2026, 3, 1 + day, hour)
    return (f"f{i}", t, "a", "b", 1, 2, "TCP", 0.0, 1, size)


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(os.path.relpath(folder, path), n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return found


@pytest.fixture
def store(spark, tmp_path):
    made = sinks.AlertStore(spark, str(tmp_path / "store"), buckets=4)
    made.upsert("flows", spark.createDataFrame([flow(i, i % 5) for i in range(60)], S.FLOWS))
    return made


def test_one_row_rewrites_one_partition(spark, store):
    before = files(f"{store.path}/flows")
    assert len({os.path.dirname(f) for f in before}) > 10
    store.upsert("flows", spark.createDataFrame([flow(7, 2, size=99)], S.FLOWS))
    after = files(f"{store.path}/flows")
    gone, new = set(before) - set(after), set(after) - set(before)
    assert len({os.path.dirname(f) for f in gone | new}) == 1 and new
    assert all(after[f] == before[f] for f in set(before) & set(after))
    rows = {r.flow_id: r.byte_count for r in store.read("flows").collect()}
    assert len(rows) == 60 and rows["f7"] == 99 and sum(rows.values()) == 59 + 99


def test_a_row_that_changes_its_day(spark, store):
    store.upsert("flows", spark.createDataFrame([flow(7, 9, size=5)], S.FLOWS))
    assert store._rows("flows").count() == 61
    assert store.read("flows").count() == 60
    assert store.read("flows").where("flow_id = 'f7'").first().byte_count == 5
    store.compact("flows")
    assert store._rows("flows").count() == store.read("flows").count() == 60


def test_ties_replays_and_nulls(spark, store):
    twice = [flow(1, 1, size=3, hour=2), flow(1, 1, size=4, hour=2), flow(1, 1, size=9, hour=1)]
    batch = spark.createDataFrame([*twice, (None, None, *flow(0, 0)[2:])], S.FLOWS)
    store.upsert("flows", batch, stored_at=2**52)
    once = sorted(map(str, store.read("flows").collect()))
    store.upsert("flows", batch, stored_at=2**52)
    assert sorted(map(str, store.read("flows").collect())) == once and len(once) == 61
    assert store.read("flows").where("flow_id = 'f1'").first().byte_count in (3, 4)
    older = spark.createDataFrame([flow(1, 1, size=1000, hour=3)], S.FLOWS)
    store.upsert("flows", older, stored_at=1)  # a late replay of an older batch does not win
    assert store.read("flows").where("flow_id = 'f1'").first().byte_count in (3, 4)


def test_pruned_reads(spark, store):
    day = store.find("flows", "2026-03-03")
    assert {r.flow_id for r in day.collect()} == {f"f{i}" for i in range(60) if i % 5 == 2}
    one = store.find("flows", "2026-03-03", ["f7", "f8"])
    assert [r.flow_id for r in one.collect()] == ["f7"]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "stored_day" in plan


def test_empty(spark, tmp_path):
    store = sinks.AlertStore(spark, str(tmp_path / "none"))
    assert store.read("alerts").count() == 0
    store.upsert("alerts", spark.createDataFrame([], S.ALERTS))
    store.reset()
    assert store.read("alerts").count() == 0 and store.read("flows").select(F.count("*")).first()[0] == 0
