import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from threatspark.llm import queries, suffix_array as S


def plain(texts, length):
    """Removed bytes of each text, by counting all its strings."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_covers_have_every_difference():
    for r in range(4):
        cover, period = S.difference_cover(r)
        assert {int(a - b) % period for a in cover for b in cover} == set(range(period))
    assert S.cover_for(400)[1] == 181


@pytest.mark.parametrize("length,lot", [(400, 1 << 20), (40, 300), (5, 64)])
def test_repeats_equal_brute_force(spark, length, lot):
    rng = random.Random(length)
    shared = [bytes(rng.choices(b"abc d", k=length + rng.randint(0, 40))).decode() for _ in range(4)]
    texts = [None, "", "é" * length, "x" * (length - 1), "x" * length, "y" * (length + 3)]
    for _ in range(40):
        texts.append("".join(rng.choice([rng.choice(shared), "".join(rng.choices("abcdefgh é", k=rng.randint(0, length)))]) for _ in range(rng.randint(0, 4))))
    texts += texts[6:9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in S.repeats(docs.repartition(3), length, lot_bytes=lot, bucket_bytes=500).collect()}
    data = [(t or "").encode() for t in texts]
    for i, gone in enumerate(plain(data, length)):
        mask = np.zeros(len(data[i]), bool)
        for s in got[i].spans:
            mask[s.start : s.until] = True
        assert mask.tolist() == gone, i
        assert bytes(got[i].kept) == bytes(b for b, g in zip(data[i], gone) if not g)
        assert all(a.until < b.start for a, b in zip(got[i].spans, got[i].spans[1:]))


def test_query(spark, sf):
    docs = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    data = {i: t.encode() for i, t in docs.items()}
    want = {}
    for i, gone in zip(data, plain(list(data.values()), 400)):
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(gone), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data[i], gone) if not g)).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op5_suffix_array"](spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_odd_rows(odd_docs, no_docs):
    assert len(S.repeats(odd_docs).collect()) == odd_docs.count()
    assert S.repeats(no_docs).collect() == []
