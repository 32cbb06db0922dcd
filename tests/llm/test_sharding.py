import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest

from threatspark.llm import queries, sharding


def plain_capacity(sizes, shards):
    def needed(capacity):
        n, held = 1, 0
        for s in sizes:
            n, held = (n, held + s) if held + s <= capacity else (n + 1, s)
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return high


@pytest.mark.parametrize("kind,buckets", [("flat", 4), ("flat", 1 << 15), ("wild", 7), ("hot", 16), ("few", 3)])
def test_capacity_is_the_smallest(spark, kind, buckets):
    rng = random.Random(kind)
    sizes = {"flat": [rng.randint(8, 50) for _ in range(700)], "wild": [int(rng.paretovariate(0.8)) + 8 for _ in range(500)], "few": [9, 30, 8], "hot": [10] * 300 + [5000] + [10] * 300}[kind]
    ends = list(accumulate(sizes))
    frame = spark.createDataFrame([(e,) for e in ends], "end long").cache()
    cuts = sharding.minimax_cuts(sharding.Ends(frame, ends[-1], buckets), max(sizes), 24)
    assert set(cuts) <= set(ends) and cuts[-1] == ends[-1] and len(cuts) <= 24
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= plain_capacity(sizes, 24)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_sharding"](spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    slots, homes, held = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[docs[r.doc_id]].add(r.shard)
        held[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    by_text = defaultdict(int)
    for r in rows:
        by_text[docs[r.doc_id]] += r.size
    assert max(held.values()) <= sum(held.values()) / 24 + max(by_text.values())


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    assert {r.shard for r in rows if r.size == 8} == {next(r.shard for r in rows if r.doc_id == 1)}
    assert sharding.shard(no_docs, 3).collect() == []
