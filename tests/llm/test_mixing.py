from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tests import oracle
from threatspark.llm import mixing as M, queries


def test_query_equals_sql(spark, sf):
    got = queries.QUERIES["op4_mixing"](spark, sf).toPandas()
    assert oracle.compare(got, oracle.connect(sf).execute(queries.ORACLES["op4_mixing"]).df()) is None
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= got.groupby("source_size")["size"].max() / 2 + 0.5).all() and (got.taken <= 2 * got["size"]).all()


def test_targets_share_what_full_sources_leave():
    assert M.source_targets({"a": 10, "b": 100, None: 1000}) == {"a": 20, "b": 200, None: 1445}
    got = M.source_targets({"a": 10, "b": 1000, None: 1000})
    assert got["a"] == 20 and sum(got.values()) == Fraction(3, 2) * 2010 and got["b"] * 2 == got[None]
    assert M.source_targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}


@pytest.mark.parametrize("urn", [400_000_000, 50])
def test_tree_deals_exact_quotas(monkeypatch, urn):
    monkeypatch.setattr(M, "_URN", urn)
    quotas = [700, 1, 0, 55, 3000]
    dealt = M.split_quotas(quotas, 7, seed=2)
    assert dealt.sum(axis=0).tolist() == quotas and (dealt >= 0).all()
    assert max(dealt.sum(axis=1)) - min(dealt.sum(axis=1)) <= 1
    assert (dealt == M.split_quotas(quotas, 7, seed=2)).all()


def test_draws_are_disjoint_and_shards_exact(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 20)
    rows = [(i, " ".join(["w"] * (i % 7)), "ab"[i % 2] if i % 5 else None, 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(4)
    planned = M.plan(docs, shards=6).collect()
    assert len(planned) == 300
    count, words = Counter(), Counter()
    for r in planned:
        assert len({d["round"] for d in r.mix.draws}) == len(r.mix.draws)
        assert sum(d.words for d in r.mix.draws) <= 2 * r.mix.size
        count.update(d.shard for d in r.mix.draws)
        words[r.source] += sum(d.words for d in r.mix.draws)
    assert set(count) == set(range(6)) and max(count.values()) - min(count.values()) <= 1
    target = {r.source: r.mix.target for r in planned}
    assert all(abs(words[s] - target[s]) <= 1.5 for s in target)
    mixed = M.mix(docs, shards=6)
    assert mixed.columns == ["doc_id", "text", "source", "shard"]
    rows = mixed.collect()
    assert Counter(r.shard for r in rows) == count
    assert sum(len(r.text.split()) for r in rows) == sum(words.values())
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(docs.repartition(2), shards=6).collect()))


def test_documents_are_whole_and_come_nearest(spark):
    """The last draw is the document that brings a source nearest to its target, and nothing is cut."""
    sizes = [40, 7, 90, 3, 55, 21, 300, 1]
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)] + [(100, "v " * 5000, "b"), (101, "v " * 200, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {r[1] for r in rows}
    mixed = M.mix(docs, shards=3, share=Fraction(1, 3), weights=(1, 9)).collect()
    assert {r.text for r in mixed} <= texts
    planned = M.plan(docs, shards=3, share=Fraction(1, 3), weights=(1, 9)).collect()
    for source in "ab":
        mine = [r for r in planned if r.source == source]
        taken, target = sum(d.words for r in mine for d in r.mix.draws), mine[0].mix.target
        others = [r.mix.size for r in mine if not r.mix.draws]
        assert all(abs(taken - target) <= abs(taken + n - target) + 0.5 for n in others)


def test_clashing_names(spark):
    names = ["target", "rest", "rounds", "rank0", "word0", "source_n", "source_size", "deals", "n", "words", "size", "ends", "shard", "mix", "k", "at", "start"]
    rows = [(i, "w " * (i % 5), "ab"[i % 2], *range(len(names))) for i in range(40)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names)
    docs = spark.createDataFrame(rows, schema)
    planned = M.plan(docs, shards=2)
    assert planned.columns == [c for c in docs.columns if c != "mix"] + ["mix"] and planned.count() == 40
    mixed = M.mix(docs, shards=2)
    assert set(mixed.columns) == set(docs.columns) - {"mix"} and mixed.count() > 0
    assert all(r["rest"] == 1 and r["target"] == 0 for r in mixed.collect())


def test_shards_hold_what_the_tree_dealt(spark, monkeypatch):
    """Draws of each source in each shard equal the tree's numbers, whatever the cells."""
    dealt = []
    tree = M.split_quotas
    monkeypatch.setattr(M, "split_quotas", lambda *a: dealt.append(tree(*a)) or dealt[-1])
    rows = [(i % 50 if i % 3 else None, f"t{i} " * (i % 9), "abc"[i % 3]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cell_rows in (5, 1000):
        monkeypatch.setattr(M, "CELL_ROWS", cell_rows)
        counts = Counter((d.shard, r.source) for r in M.plan(docs, shards=7).collect() for d in r.mix.draws)
        per_shard = sorted(tuple(counts[k, s] for s in "abc") for k in range(7))
        table = dealt[-1]
        assert sorted(table.sum(axis=0).tolist()) == sorted(sum(counts[k, s] for k in range(7)) for s in "abc")
        assert [sorted(row) for row in table.tolist()] == [sorted(counts[k, s] for s in "abc") for k in range(7)] and per_shard


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.plan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r.mix.size for r in rows if r.doc_id in (1, 2, 3)) == 0
    assert M.plan(no_docs).collect() == [] and M.mix(no_docs).collect() == []
    assert np.all(M.split_quotas([0, 0], 3) == 0)
