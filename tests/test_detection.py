"""The detection pipeline as a whole, stored models, and the chained stream."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatspark import schemas as S
from threatspark.operators import calibration, detection as DT, flows as FL, inference as I, isolation as IF
from threatspark.plans import adapters as D
from threatspark.plans.detection_queries import SETTINGS
from threatspark.streaming import chain, stateful as ST
from threatspark.streaming.windows import TrailingCounts, TrailingDistinct

COLUMNS = ["alert_id", "timestamp", "flow_id", "threat_class", "severity", "confidence", "anomaly_score", "model_version"]


# --- windows in buckets ---------------------------------------------------------------------------------------------
class Handle:
    """State in dictionaries; counts what is written."""

    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())


class Map(dict):
    writes = 0
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    removeKey = dict.__delitem__

    def updateValue(self, key, value):
        Map.writes += 1
        self[key] = value


class Value:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def clear(self):
        self.kept = None


@pytest.mark.parametrize("seed", range(6))
def test_trailing_counts(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.choice([1, 50, 1000]))
    gaps = rng.choice([0, 1, 3, 40, 5000], 400)
    times, kinds = np.cumsum(gaps).tolist(), rng.choice(list("abc"), 400).tolist()
    handle, got = Handle(), []
    for lo in range(0, 400, 37):
        window = TrailingCounts(handle, "w", width)
        window.begin()
        got += [window.add(t, k) for t, k in zip(times[lo : lo + 37], kinds[lo : lo + 37])]
        window.finish()
    for i, (t, counts) in enumerate(zip(times, got)):
        inside = [k for s, k in zip(times[: i + 1], kinds) if s >= t - width]
        assert counts == {k: inside.count(k) for k in set(inside)}
    assert len(handle.states["w_buckets"]) <= 35


@pytest.mark.parametrize("seed", range(6))
def test_trailing_distinct(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.choice([1, 50, 1000]))
    times, values = np.cumsum(rng.choice([0, 1, 3, 40, 5000], 400)).tolist(), rng.integers(0, 12, 400).astype(str).tolist()
    handle, got = Handle(), []
    for lo in range(0, 400, 23):
        window = TrailingDistinct(handle, "w", width)
        window.begin()
        got += [window.add(t, v) for t, v in zip(times[lo : lo + 23], values[lo : lo + 23])]
        window.finish()
    want = [len({v for s, v in zip(times[: i + 1], values) if s >= t - width}) for i, t in enumerate(times)]
    assert got == want
    window = TrailingDistinct(handle, "w", width)
    window.begin()
    assert window.expire(times[-1] + width + 1) == 0
    window.finish()
    assert not handle.states["w_met"] and not handle.states["w_buckets"]


def test_a_row_rewrites_few_buckets():
    """A full window does not make a row dearer: a batch of one row writes its bucket, and those that end."""
    handle = Handle()
    window = TrailingCounts(handle, "w", 1_000_000)
    window.begin()
    for t in range(0, 1_000_000, 100):
        window.add(t, "a")
    window.finish()
    Map.writes = 0
    window.begin()
    assert window.add(1_000_000, "b") == {"a": 10_000, "b": 1}
    window.finish()
    assert Map.writes <= 2


def test_overtaken_rows():
    handle = Handle()
    window = TrailingCounts(handle, "w", 100)
    window.begin()
    for t in (0, 50, 200):
        window.add(t, "a")
    assert window.add(120, "b") == {"b": 1}  # what newer rows have taken back is gone
    assert window.add(210, "a") == {"a": 2, "b": 1}
    assert window.add(5, "c") == {"c": 1}  # older than all that is kept
    assert window.add(211, "a") == {"a": 3, "b": 1}
    window.finish()


# --- expiring cardinalities -----------------------------------------------------------------------------------------
def stream_of(spark, rows, schema, tmp_path, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ST.ROCKSDB)
    yield
    spark.conf.unset(key)


def ended(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(600)
    return spark.table(name).toPandas()


def test_idle_entries_go_and_the_count_falls(spark, rocks, tmp_path):
    at = lambda s: (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    seconds = [0, 10, 20, 55, 100, 400]
    targets = ["a", "b", "a", "c", "a", "d"]
    rows = [(f"f{i}", at(s), "src", t, 80 + i) for i, (s, t) in enumerate(zip(seconds, targets))]
    schema = "flow_id string, timestamp timestamp, src_ip string, dst_ip string, dst_port long"
    stream = stream_of(spark, rows, schema, tmp_path, [[0, 1, 2], [3, 4], [5]])
    got = ended(spark, ST.running_cardinalities(stream, ttl_seconds=60.0), "ttl_out", tmp_path).sort_values("flow_id")
    want = [len({t for r, t in zip(seconds[: i + 1], targets) if r >= s - 60}) for i, s in enumerate(seconds)]
    assert got["unique_destinations"].tolist() == want == [1, 2, 2, 3, 2, 1]
    assert got["unique_dest_ports"].tolist() == [1, 2, 3, 4, 2, 1]


# --- chain ----------------------------------------------------------------------------------------------------------
def test_packets_out_of_order(spark, sf):
    """Packets that overtake each other within the delay, in any file order, give the flows of the batch."""
    from threatspark.plans.registry import QUERIES

    packets = D.packets(spark, sf).drop("seq").repartition(3)
    got = chain.replay(packets, SETTINGS, parts=1).toPandas()
    want = DT.detect(packets, settings=SETTINGS).toPandas()
    assert len(want)
    order = lambda d: d[COLUMNS].sort_values("alert_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    assert "detection_stream" in QUERIES


def test_no_packets(spark, sf):
    none = D.packets(spark, sf).drop("seq").where("false")
    assert DT.detect(none, settings=SETTINGS).count() == 0
    assert chain.replay(none, SETTINGS).count() == 0


# --- the whole pipeline ---------------------------------------------------------------------------------------------
def test_chunks_change_nothing(spark, sf):
    packets = D.packets(spark, sf)
    plain = DT.detect(packets, settings=SETTINGS).toPandas()
    cut = DT.detect(packets, settings=SETTINGS, chunk_rows=40).toPandas()
    order = lambda d: d[COLUMNS].sort_values("alert_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(plain), order(cut), rtol=1e-9)


def made_flows(spark, n=600):
    """Three well separated kinds of flows under the model's feature names."""
    rng = np.random.default_rng(3)
    names = list(S.MODEL_FEATURES)
    kinds = [S.NORMAL_LABEL, S.DDOS_LABEL, S.BOTS_LABEL]
    rows = []
    for i in range(n):
        kind = kinds[i % 3 if i % 5 else 0]
        base = {S.NORMAL_LABEL: 10.0, S.DDOS_LABEL: 400.0, S.BOTS_LABEL: 4000.0}[kind]
        rows.append((i, kind, "val" if i % 4 == 0 else "train", *[float(base * (1 + j) + rng.normal(0, base / 20)) for j in range(len(names))]))
    columns = ", ".join(f"`{c}` double" for c in names)
    return spark.createDataFrame(rows, f"row long, `{S.TARGET}` string, split string, {columns}"), names


@pytest.fixture(scope="module")
def trained(spark):
    rows, names = made_flows(spark)
    how = dict(forest=dict(trees=10, depth=4, min_leaf=1), isolation=dict(trees=40, sample=128), thresholds=calibration.grid(-0.30, -0.90, -0.005))
    return rows, names, I.train(rows, "row", names, **how)


def test_training_works_its_rows_out_once(spark):
    rows, names = made_flows(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    costly = rows.mapInArrow(counted, rows.schema)
    I.train(costly, "row", names, forest=dict(trees=2, depth=2, min_leaf=1), isolation=dict(trees=4, sample=64), thresholds=calibration.grid(-0.30, -0.90, -0.005))
    assert seen.value == rows.count()


def test_models_come_back_as_they_went(spark, trained, tmp_path):
    rows, names, models = trained
    models.save(str(tmp_path / "m"))
    back = I.load(spark, str(tmp_path / "m"))
    assert (back.features, back.logged, back.top, back.threshold) == (models.features, models.logged, models.top, models.threshold)
    order = lambda m: I.classify(rows, m).select("row", "threat_class", "confidence", "anomaly_score").orderBy("row").toPandas()
    pd.testing.assert_frame_equal(order(models), order(back))


def test_log_scaling_is_for_the_isolation_side_only(spark, trained):
    rows, names, models = trained
    scored = I.score(rows, models).orderBy("row").toPandas()
    scaled = rows.toPandas().sort_values("row")
    x = scaled[names].to_numpy(dtype="float64").copy()
    for i, c in enumerate(names):
        if c in S.LOG_FEATURES:
            x[:, i] = np.log1p(np.clip(x[:, i], 0, None))
    packed = IF._pack(models.isolation.nodes.orderBy("tree", "node").toPandas())
    np.testing.assert_allclose(scored["raw_anomaly"], IF._score(packed, x), rtol=1e-12)
    from threatspark.operators import forest as RF

    raw = RF.predict(models.forest, rows).orderBy("row").toPandas()
    assert (raw["rf_label"] == scored["rf_label"]).all() and (scored["rf_label"] == scaled[S.TARGET].to_numpy()).mean() > 0.95


def test_threshold_is_calibrated_on_the_validation_rows(trained):
    rows, _, models = trained
    held = I.score(rows.where("split = 'val'"), models).toPandas()
    bots, normal = (held[held[S.TARGET] == k]["raw_anomaly"] for k in (S.BOTS_LABEL, S.NORMAL_LABEL))
    assert (bots <= models.threshold).mean() >= 0.9
    assert (normal <= models.threshold).mean() < 0.2


def test_models_decide_after_the_rules(spark, sf, trained):
    _, _, models = trained
    flows = DT.with_state(FL.flow_features(D.packets(spark, sf)), SETTINGS)
    plain = DT.decide(flows, None, SETTINGS).select("flow_id", F.col("threat_class").alias("rule"), F.col("model_version").alias("version"))
    both = DT.decide(flows, models, SETTINGS).join(plain, "flow_id")
    assert both.count() == flows.count()
    assert both.where(f"rule <> '{S.BENIGN}' AND (rule <> threat_class OR version <> model_version)").count() == 0
    broken = flows.withColumn("iat_std", F.lit(float("nan")))
    kept = DT.decide(broken, models, SETTINGS).join(plain, "flow_id")
    assert kept.where("rule <> threat_class").count() == 0
