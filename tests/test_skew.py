"""Hot keys: the chunked plans must give what the plain windows give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatspark import skew
from threatspark.operators import alerts as A, behavior as B, dns as N, flows as FL, fusion as FU, splitting as SP
from threatspark.operators.fusion import last_choices


@pytest.fixture(scope="module")
def events(spark):
    """One key with most rows, ties in time, some small keys and a null key."""
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.7, "hot", np.array(["a", "b", "c"])[rng.integers(0, 3, n)]),
            "t": np.sort(rng.integers(0, 400, n)) * 500_000,
            "id": np.arange(n),
            "x": rng.integers(1, 1000, n).astype(float),
        }
    )
    pdf.loc[pdf["id"] % 97 == 0, "k"] = None
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "NaN", F.col("k")))
    return df.repartition(5).cache()


def same(a, b, on, atol=1e-9):
    cols = a.columns
    pa = a.toPandas().sort_values(on).reset_index(drop=True)[cols]
    pb = b.select(*cols).toPandas().sort_values(on).reset_index(drop=True)
    pd.testing.assert_frame_equal(pa, pb, check_dtype=False, rtol=1e-9, atol=atol)


def test_only_hot_keys_are_cut(events):
    ch = skew.chunked(events, ["k"], ["t", "id"], chunk_rows=700)
    assert ch.hot
    chunks = {r["k"]: r["n"] for r in ch.df.groupBy("k").agg(F.count_distinct(skew.CHUNK).alias("n")).collect()}
    assert chunks["hot"] > 3
    assert all(n == 1 for k, n in chunks.items() if k != "hot")
    sizes = [r["count"] for r in ch.hot_rows().groupBy("k", skew.CHUNK).count().collect()]
    assert max(sizes) <= 1400


def test_no_hot_key_leaves_the_table_alone(events):
    assert not skew.chunked(events, ["k"], ["t", "id"], chunk_rows=10_000).hot


def test_previous_and_running(events):
    plain = skew.chunked(events, ["k"], ["t", "id"], chunk_rows=10**9)
    cut = skew.chunked(events, ["k"], ["t", "id"], chunk_rows=300)
    assert cut.hot and not plain.hot
    same(skew.with_previous(plain, ["t", "id"]).done(), skew.with_previous(cut, ["t", "id"]).done(), "id")
    sums, maxima = {"s": F.lit(1)}, {"m": F.when(F.col("id") % 50 == 0, F.col("t"))}
    same(skew.with_running(plain, sums, maxima).done(), skew.with_running(cut, sums, maxima).done(), "id")


def test_global_running_sum(events):
    plain = skew.with_running(skew.chunked(events, [], ["t", "id"], chunk_rows=10**9), {"s": F.col("x")}).done()
    cut = skew.with_running(skew.chunked(events, [], ["t", "id"], chunk_rows=250), {"s": F.col("x")}).done()
    same(plain, cut, "id")


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("peers", [True, False])
def test_trailing_sums(events, closed, peers):
    kw = dict(left_closed=closed, peers=peers)
    args = (events, ["k"], "t", ["id"], 5_000_000, {"n": F.lit(1).cast("long"), "odd": (F.col("id") % 2).cast("long")})
    same(skew.trailing_sums(*args, chunk_rows=10**9, **kw), skew.trailing_sums(*args, chunk_rows=300, **kw), "id")


def test_trailing_sums_brute_force(events):
    out = skew.trailing_sums(
        events, ["k"], "t", ["id"], 5_000_000, {"n": F.lit(1).cast("long")}, chunk_rows=300
    ).toPandas()
    pdf = out.sort_values(["t", "id"])
    for k, g in pdf.groupby("k"):
        t, i = g["t"].to_numpy(), g["id"].to_numpy()
        want = [int(((t >= t[r] - 5_000_000) & ((t < t[r]) | ((t == t[r]) & (i <= i[r])))).sum()) for r in range(len(g))]
        assert g["n"].tolist() == want


def test_last_n_mean(events):
    same(
        FL.last_n_mean(events, ["k"], ["t", "id"], "x", 20, chunk_rows=10**9),
        FL.last_n_mean(events, ["k"], ["t", "id"], "x", 20, chunk_rows=300),
        "id",
    )


@pytest.mark.parametrize("rows", [40, 300])
def test_drift(events, rows):
    args = (events, ["k"], ["t", "id"], "x")
    same(B.score_drift(*args, chunk_rows=10**9), B.score_drift(*args, chunk_rows=rows), "id")


def test_drift_first_value_seeds_whatever_the_chunking(spark):
    rows = spark.createDataFrame([("h", i, float(10_000 if i else 5_000_000)) for i in range(200)], "k string, id int, x double")
    a = B.score_drift(rows, ["k"], ["id"], "x", chunk_rows=10**9)
    b = B.score_drift(rows, ["k"], ["id"], "x", chunk_rows=20)
    same(a, b, "id", atol=1e-6)


def test_drift_of_a_flat_key_stays_exactly_flat(spark):
    rows = spark.range(300).select(F.lit("h").alias("k"), "id", F.when(F.col("id") == 299, 10500.0).otherwise(10000.1).alias("x"))
    out = B.score_drift(rows, ["k"], ["id"], "x", chunk_rows=20).toPandas().sort_values("id")
    assert (out["z_score"][:-1] == 0).all() and out["z_score"].iloc[-1] == 999.0
    assert out["drift"].tolist() == [False] * 299 + [True]


@pytest.mark.parametrize("cooldown", [3.0, 7.5, 60.0])
def test_escalations(events, cooldown):
    rows = events.select(
        F.col("k").alias("source_ip"), F.timestamp_micros("t").alias("ts"), F.col("id").alias("seq")
    ).where("source_ip is not null")
    a = FU.mark_escalations(rows, cooldown, chunk_rows=10**9)
    b = FU.mark_escalations(rows, cooldown, chunk_rows=150)
    same(a, b, "seq")
    pdf = a.toPandas().sort_values(["source_ip", "ts", "seq"])
    for _, g in pdf.groupby("source_ip"):
        last, want = None, []
        for t in g["ts"]:
            hit = last is None or (t - last).total_seconds() >= cooldown
            want.append(hit)
            last = t if hit else last
        assert g["escalated"].tolist() == want


def test_last_choices_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        times = np.unique(rng.integers(0, 300, rng.integers(1, 60)))
        wait = int(rng.integers(1, 80))
        upto, ends = last_choices(times, wait)
        for last in range(int(times[0]) - wait, int(times[0])):
            want, current = last, last
            for t in times:
                if t - current >= wait:
                    current = want = int(t)
            i = int(np.searchsorted(upto, last + wait))
            got = int(ends[i]) if i < len(ends) else last
            assert got == want, (times, wait, last)


def test_fusion(events):
    kind = F.element_at(F.array(*[F.lit(t) for t in FU.S.SIGNAL_TYPES]), (F.col("id") % 4 + 1).cast("int"))
    signals = events.where("k is not null").select(
        F.col("k").alias("source_ip"),
        F.timestamp_micros(F.col("t") * 10).alias("ts"),
        F.col("id").alias("seq"),
        kind.alias("signal_type"),
        F.col("id").cast("string").alias("flow_id"),
        F.lit("d").alias("detail"),
        F.lit("{}").alias("evidence"),
    )
    same(
        FU.fuse(signals, 3.0, keep_suppressed=True, chunk_rows=10**9),
        FU.fuse(signals, 3.0, keep_suppressed=True, chunk_rows=200),
        "seq",
    )


def test_repeats(events):
    rows = events.withColumn("ts", F.timestamp_micros("t"))
    same(
        A.suppress_repeats(rows, ["k"], "ts", ["id"], 0.4, keep_suppressed=True, chunk_rows=10**9),
        A.suppress_repeats(rows, ["k"], "ts", ["id"], 0.4, keep_suppressed=True, chunk_rows=300),
        "id",
    )


def packets(events):
    return events.select(
        F.timestamp_micros(F.col("t") * 3).alias("timestamp"),
        F.coalesce("k", F.lit("n")).alias("src_ip"),
        F.when(F.col("k") == "hot", "d").otherwise((F.col("id") % 3).cast("string")).alias("dst_ip"),
        F.lit(1).cast("long").alias("src_port"),
        F.when(F.col("k") == "hot", 1).otherwise(F.col("id") % 5).cast("long").alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        F.col("x").cast("long").alias("packet_size"),
        (F.col("id") % 3 == 0).alias("syn_flag"),
    )


@pytest.mark.parametrize("gap", [0.5, 1.4, 4.0])
def test_flows(events, gap):
    a = FL.flow_features(packets(events), gap, chunk_rows=10**9)
    b = FL.flow_features(packets(events), gap, chunk_rows=200)
    same(a, b, "flow_id")


def test_running_cardinalities(events):
    base = FL.flow_features(packets(events.withColumn("k", F.when(F.col("k") == "hot", F.concat("k", (F.col("id") % 2).cast("string"))).otherwise(F.col("k")))), 0.4)
    base = base.withColumns({"src_ip": F.lit("one"), "dst_ip": F.concat("dst_ip", "src_ip")}).cache()
    assert base.count() > 400
    same(
        FL.with_running_cardinalities(base, chunk_rows=10**9),
        FL.with_running_cardinalities(base, chunk_rows=100),
        "flow_id",
    )


def test_dns_rates_and_thresholds(events):
    queries = events.where("k is not null").select(
        F.col("k").alias("src_ip"), F.timestamp_micros("t").alias("timestamp"), F.col("id").alias("seq"), F.lit("a.b").alias("domain")
    )
    same(N.query_rates(queries, seq="seq", chunk_rows=10**9), N.query_rates(queries, seq="seq", chunk_rows=300), "seq")
    scores = events.select(F.col("x").alias("score"), (F.col("x") + F.col("id") % 400 > 700).alias("malicious"))
    for higher in (True, False):
        a = N.calibrate_threshold(scores, higher_is_malicious=higher, benign_weight=1.5, chunk_rows=10**9)
        b = N.calibrate_threshold(scores, higher_is_malicious=higher, benign_weight=1.5, chunk_rows=50)
        assert a.collect() == b.collect()


def test_exact_split(events):
    rows = events.withColumn("label", F.when(F.col("k") == "hot", "big").otherwise("small"))
    a = SP.split_exact(rows, "id", "label", chunk_rows=10**9)
    same(a, SP.split_exact(rows, "id", "label", chunk_rows=200), "id")
    n = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    for label in ("big", "small"):
        total = sum(v for (lab, _), v in n.items() if lab == label)
        assert abs(n[(label, "train")] - 0.7 * total) <= 1
        assert abs(n[(label, "val")] - 0.15 * total) <= 1


def test_quantiles(events, spark):
    long = events.select(F.coalesce("k", F.lit("n")).alias("g"), F.col("x").alias("value")).unionByName(
        events.select(F.lit("flat").alias("g"), F.lit(3.0).alias("value"))
    )
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    a = skew.exact_quantiles(long, ["g"], "value", probs, group_rows=10**9).toPandas()
    b = skew.exact_quantiles(long, ["g"], "value", probs, group_rows=50).toPandas()
    key = ["g", "prob"]
    a, b = (p.sort_values(key).reset_index(drop=True) for p in (a, b))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)
    pdf = long.toPandas()
    for g, part in pdf.groupby("g"):
        want = np.quantile(part["value"], probs)
        got = b[b["g"] == g].sort_values("prob")["q"].to_numpy()
        np.testing.assert_allclose(got, want)


def test_quantiles_of_many_distinct_values(spark):
    n = 40_000
    long = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 7919 % n).cast("double").alias("value"))
    got = skew.exact_quantiles(long, ["g"], "value", [0.1, 0.5, 0.9], group_rows=500).toPandas().sort_values("prob")
    np.testing.assert_allclose(got["q"], np.quantile(np.arange(n), [0.1, 0.5, 0.9]))
