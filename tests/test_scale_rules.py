"""Rules for scale: nothing is cut short by default, and ties, gaps and null classes have defined results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.operators import cleaning as C, flows, isolation, profiling as P, splitting as SP
from threatspark.sources import feeds


def test_ranked_list_is_whole_by_default(spark):
    rows = spark.range(150_000).select(F.col("id").alias("line_no"), F.concat(F.lit("name"), "id", F.lit(".com")).alias("domain"))
    ranked = feeds.rank_domains(rows)
    assert ranked.agg(F.count("*"), F.max("position")).first()[:] == (150_000, 150_000)
    assert feeds.rank_domains(rows, 10).count() == 10


def test_hot_flow_with_tied_times_equals_the_plain_plan(spark):
    rng = random.Random(0)
    rows = [("a", "b", 1, 2, "TCP", rng.randint(0, 5) * 4, rng.randint(40, 90), rng.random() < 0.5) for _ in range(3000)]
    packets = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, s int, packet_size int, syn_flag boolean")
    packets = packets.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    plain, hot = (flows.flow_features(packets, chunk_rows=n).collect() for n in (10**9, 100))
    rounded = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded(plain) == rounded(hot)
    assert flows.sessionize(packets, chunk_rows=100).count() == len({r[5] for r in rows})


def test_correlation_is_pairwise(spark):
    import pandas as pd

    rows = [(1.0, 2.0, 3.0, 7.0), (2.0, None, 1.0, 7.0), (3.0, 5.0, float("nan"), 7.0), (4.0, 4.0, 8.0, 7.0), (None, 9.0, 2.0, 7.0), (6.0, 8.0, 4.0, 7.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, k double")
    want = pd.DataFrame(rows, columns=list("abck")).astype(float).corr()
    got = {(r.feature_a, r.feature_b): r.r for r in P.correlations(frame).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "k"), ("b", "c"), ("b", "k"), ("c", "k")}
    for (x, y), r in got.items():
        assert r is None if "k" in (x, y) else np.isclose(r, want.loc[x, y])
    assert {r.r for r in P.correlations(frame.where("false")).collect()} == {None}


def test_null_class_is_split_too(spark):
    frame = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(400)], "id long, `Attack Type` string")
    counts = SP.split_exact(frame, "id").groupBy("Attack Type", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in counts} == {(None, "train"): 70, (None, "val"): 15, (None, "test"): 15, ("x", "train"): 210, ("x", "val"): 45, ("x", "test"): 45}


def test_a_bad_row_that_a_step_drops_does_not_raise(spark):
    frame = spark.createDataFrame([(float("inf"), "DDoS"), (1.0, "DDoS")], "`Flow Duration` double, `Attack Type` string")
    assert C.assert_clean(C.drop_infinite(frame)).count() == 1


@pytest.mark.parametrize("n", [300, 5000])
def test_trees_take_their_sample_at_any_size(spark, n):
    rows = spark.range(n).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    nodes = isolation.fit(rows, ["x", "y"], "id", trees=20, sample=64).nodes
    sizes = [r[0] for r in nodes.groupBy("tree").agg(F.max("sample")).select("max(sample)").collect()]
    assert len(sizes) == 20 and min(sizes) >= 50 and max(sizes) == 64
