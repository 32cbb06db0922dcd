import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from threatspark.llm import queries
from threatspark.llm.common import settle, vocabulary


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage, and what comes out last."""
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in P.STAGES:
        docs.append(settle(stage(spark, docs[-1], sf)))
    return docs


def test_stages_keep_the_columns_and_take_effect(stages):
    assert len(P.STAGES) == 5
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    counts = [d.count() for d in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert counts[4] == counts[5]
    rows = {tuple(r) for r in stages[0].collect()}
    for d in stages[1:4]:
        assert {tuple(r) for r in d.collect()} <= rows


def test_quality_keeps_what_the_query_keeps(spark, sf, stages):
    kept = {r.doc_id for r in queries.QUERIES["op9_quality_rules"](spark, sf).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == kept


def test_near_copies_leave_one_document(stages):
    runs = {}
    for r in stages[1].collect():
        w = r.text.lower().split()
        runs[r.doc_id] = frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))
    kept = {r.doc_id for r in stages[2].collect()}
    by_run, like = {}, lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, s in runs.items():
        for x in s:
            by_run.setdefault(x, set()).add(i)
    for i, s in runs.items():
        near = {j for x in s for j in by_run[x] if j != i and like(s, runs[j]) >= 0.7}
        if i not in kept:
            assert near, i  # only texts like another one go
        assert not [j for j in near if i in kept and j in kept and like(s, runs[j]) >= 0.88], i
    copies = {}
    for i, s in runs.items():
        copies.setdefault(s, []).append(i)
    assert all(sum(i in kept for i in same) <= 1 for same in copies.values())


def test_no_passage_of_the_benchmark_is_left(spark, sf, stages):
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = lambda d: {r.doc_id for r in d.collect() if any(i in norm(r.text) for i in items)}
    assert leaky(stages[2]) and not leaky(stages[3])
    assert {r.doc_id for r in stages[2].collect()} - leaky(stages[2]) == {r.doc_id for r in stages[3].collect()}


def test_mix_comes_near_the_targets(stages):
    from threatspark.llm.mixing import source_targets

    words = lambda d: {s: sum(len(r.text.split()) for r in d.collect() if r.source == s) for s in {r.source for r in d.collect()}}
    given, taken = words(stages[3]), words(stages[4])
    assert all(abs(taken[s] - t) <= 0.01 * t + 5 for s, t in source_targets(given).items())
    texts = {r.text for r in stages[3].collect()}
    assert {r.text for r in stages[4].collect()} <= texts  # no document is cut
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_tokens_are_those_of_the_mix(stages):
    tool = Tokenizer.from_file(vocabulary())
    want, start = [], 0
    for i, text in sorted((r.doc_id, r.text) for r in stages[4].collect()):
        ids = np.array([*tool.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)


def test_query_runs_all_stages(spark, sf, stages):
    assert sorted(map(tuple, queries.QUERIES["pipeline"](spark, sf).collect())) == sorted(map(tuple, stages[5].collect()))
