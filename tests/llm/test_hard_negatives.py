"""Strassen products against plain ones, and mined rows against a full comparison."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatspark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (33, 65, 47), (200, 3, 100), (70, 130, 90)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**27), 2**27, (m, k)), rng.integers(-(2**27), 2**27, (k, n))
    for leaf in (1, 4, 32):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    assert (hard_negatives.strassen(a, b.T.copy().T, 2) == a @ b).all()


def brute(rows, every=100, positives=5, negatives=10):
    used = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    used = [(i, [math.floor(256 * x) for x in map(np.float32, v)], label) for i, v, label in used]
    ahead = lambda x: (-x[0], x[1] is None, x[1] or 0)
    anchors = {(i, tuple(v), label): at for at, (i, v, label) in enumerate(used) if i is not None and i % every == 0}
    out = []
    for (i, v, label), at in anchors.items():
        scored = [(int(sum(int(x) * int(y) for x, y in zip(v, w))), j, other) for to, (j, w, other) in enumerate(used) if to != at]
        first = sorted([(s, j) for s, j, other in scored if other == label], key=ahead)[:positives]
        for place, (score, positive) in enumerate(first, 1):
            near = [(s, j) for s, j, other in scored if other != label and 30 * score <= 100 * s <= 90 * score]
            out += [(i, positive, rank, j, score, s, place) for rank, (s, j) in enumerate(sorted(near, key=ahead)[:negatives], 1)]
    return Counter(out)


def check(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS key", "3 AS rank", "4 AS id", "5 AS low")
    got = Counter(map(tuple, hard_negatives.mine(frame, **how).collect()))
    assert got == brute(rows, **how)
    return got


def test_against_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", 120)
    monkeypatch.setattr(hard_negatives, "BLOCK", 600)
    monkeypatch.setattr(hard_negatives, "LEAF", 2)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    assert len(check(spark, rows, every=10)) > 500


def test_copies_and_ties(spark):
    """A common vector in a third of all rows, under several labels; ids decide."""
    rows = [(i, [0.5, 0.25] if i % 3 else [0.1 * (i % 7), 0.3], i % 4 if i % 3 else 0) for i in range(300)]
    rows += [(1000 + i, [0.3, 0.15], 9) for i in range(40)]
    assert check(spark, rows, every=20)


def test_odd_rows(spark):
    good = [0.5, 0.5]
    rows = [
        (100, good, 1), (100, good, 1), (100, [0.4, 0.5], 1), (0, good, 1), (None, good, 1), (None, [0.3, 0.3], 2), (7, [0.3, 0.3], 2), (7, [0.3, 0.3], 2),
        (8, None, 1), (9, [0.5, None], 2), (10, [float("nan"), 0.1], 2), (11, [float("inf"), 0.1], 2), (12, good, None), (13, [], 2), (14, [0.5], 2),
        (15, [0.2, 0.2, 5.0], 2), (-200, [-0.5, -0.5], 3), (300, good, 7), (400, [], 1),
    ]
    got = check(spark, rows)
    assert all(r[0] % 100 == 0 for r in got)
    assert not check(spark, [])
    assert not check(spark, [(1, good, 1), (2, good, 2)])
    assert not check(spark, [(100, good, 1)])


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(100, [1e9, 1e9], 1), (101, [1e9, 1e9], 1), (102, [1e9, 1e9], 2)]
    with pytest.raises(Exception, match="64 bits|whole numbers"):
        hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()


def test_other_names(spark):
    rows = [(i, [0.1 * i, 0.2], i % 2) for i in range(1, 9)] + [(100, [0.5, 0.5], 0)]
    frame = spark.createDataFrame(rows, "`my id` long, `v.1` array<double>, l int")
    found = hard_negatives.mine(frame, id_column="my id", vector="v.1", label="l")
    assert found.select(F.countDistinct("anchor_id")).first()[0] == 1
