"""Quantiles of many columns at once, and correlations of columns with gaps, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from threatspark import skew
from threatspark.operators import profiling as P

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, n=4000, seed=2):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", None], n, p=[0.9, 0.09, 0.01]),
            "smooth": rng.normal(size=n),
            "ties": rng.integers(0, 4, n).astype(float),
            "mostly zero": np.where(rng.random(n) < 0.97, 0.0, rng.exponential(size=n)),
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n) ** 5),
            "one": 7.5,
            "none": np.nan,
        }
    )
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) and i % 2 else x for x in r) for i, r in enumerate(data.itertuples(index=False))]
    return data, spark.createDataFrame(rows, "g string, smooth double, ties double, `mostly zero` double, gaps double, one double, none double").repartition(3)


@pytest.mark.parametrize("band_rows", [None, 20_000, 30, 1])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_wide_quantiles(spark, band_rows, by):
    data, df = frame(spark)
    columns = list(data.columns[1:])
    how = {} if band_rows is None else dict(group_rows=0, band_rows=band_rows, accuracy=200 if band_rows < 100 else 10_000)
    got = skew.wide_quantiles(df, columns, PROBS, by, **how).collect()
    groups = data.groupby("g", dropna=False) if by else [(None, data)]
    want = {}
    for key, part in groups:
        key = None if by and pd.isna(key) else key
        for c in columns:
            x = part[c].dropna().to_numpy()
            for p in PROBS:
                want[(key, c, p) if by else (c, p)] = np.quantile(x, p) if len(x) else None
    assert len(got) == len(want)
    for r in got:
        q = want[tuple(r)[:-1]]
        assert (r.q is None) == (q is None) and (q is None or abs(r.q - q) <= 1e-12 * max(1, abs(q))), r


def test_many_groups_and_no_rows(spark):
    data, df = frame(spark, 300)
    got = skew.wide_quantiles(df, ["smooth", "ties"], [0.5], ["g"], most_groups=1).collect()
    assert len(got) == 2 * data["g"].nunique(dropna=False)
    assert skew.wide_quantiles(df.where("false"), ["ties"], [0.5], ["g"]).count() == 0
    for rows in (0, 10):
        assert [r.q for r in skew.wide_quantiles(df.where("false"), ["ties"], [0.5, 1.0], group_rows=rows).collect()] == [None, None]


def test_a_rank_by_halving(spark):
    data, df = frame(spark, 500)
    wide = df.selectExpr("smooth AS _x0")
    x = np.sort(data["smooth"])
    assert [skew._ranked(wide, [], (), 0, x[0], x[-1], k) for k in (0, 17, 499)] == [x[0], x[17], x[499]]


def test_correlations_with_gaps(spark):
    data, df = frame(spark)
    data["near"] = data["smooth"] * 2 + data["gaps"].fillna(0) * 0.01
    rows = spark.createDataFrame(data[["smooth", "ties", "gaps", "one", "none", "near"]])
    got = {(r.feature_a, r.feature_b): r.r for r in P._correlated(rows, rows.columns).collect()}
    want = data[["smooth", "ties", "gaps", "near"]].corr()
    for (a, b), r in got.items():
        if {a, b} & {"one", "none"}:
            assert r is None
        else:
            assert abs(r - want.loc[a, b]) < 1e-9, (a, b)
    assert all(r.r is None for r in P._correlated(rows.where("false"), ["smooth", "ties"]).collect())


def test_large_groups_stay_where_they_are(spark, monkeypatch):
    """Rows of a large group meet their band without a shuffle by the group, which would put the group into one task."""
    plans, join = [], skew._keyed_join

    def seen(left, right, names, how="left"):
        out = join(left, right, names, how)
        if how == "inner":
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(skew, "_keyed_join", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6000).selectExpr("if(id % 10 = 0, 'b', 'a') AS g", "cast((id * 7919) % 6007 AS double) AS value")
        got = {r.g: r.q for r in skew.exact_quantiles(rows, ["g"], "value", [0.5], group_rows=50).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = pd.DataFrame(rows.collect(), columns=["g", "value"]).groupby("g")["value"].quantile(0.5)
    assert got == want.to_dict()
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
