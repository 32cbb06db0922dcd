import random
from collections import defaultdict

import pytest
import xxhash

from threatspark.llm import queries, simhash
from threatspark.llm.graph import connected_components


def plain_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    runs = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    out = 0
    for bit in range(64):
        if sum(xxhash.xxh64_intdigest(r, 42) >> bit & 1 for r in runs) * 2 > len(runs):
            out |= 1 << bit
    return out


def plain_components(prints, radius):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_prints = sorted(set(prints))
    for i, a in enumerate(all_prints):
        for b in all_prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in docs.items()}
    group = plain_components(prints.values(), 2)
    first = {}
    for i in sorted(prints, reverse=True):
        first[group[prints[i]]] = i
    want = {(i, f"{p:016x}", first[group[p]]) for i, p in prints.items()}
    got = [tuple(r) for r in queries.QUERIES["op1_simhash"](spark, sf).collect()]
    assert len(got) == len(docs) and set(got) == want


@pytest.mark.parametrize("radius,limit", [(1, 10**6), (2, 10**6), (3, 10**6), (4, 10**6), (2, 2), (3, 2), (1, 2)])
def test_links_join_what_all_pairs_join(spark, radius, limit):
    rng = random.Random(radius)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                x ^= 1 << b
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), radius, pair_limit=limit)
    label = {r.node: r.label for r in connected_components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    root = plain_components(prints, radius)
    for p in prints:
        got[label.get(signed[p], signed[p])].add(p)
        want[root[p]].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_shares_a_key():
    rng = random.Random(5)
    for radius in (1, 2, 3, 4):
        keys = simhash.ring_keys(radius)
        for _ in range(400):
            d = 0
            for b in rng.sample(range(64), radius):
                d |= 1 << b
            assert any(d & mask == 0 and all((d & m).bit_count() <= n for m, n in chain) for mask, chain in keys)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.components(no_docs).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
