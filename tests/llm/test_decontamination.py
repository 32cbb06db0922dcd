import random
from collections import Counter

import numpy as np
import pytest

from threatspark.llm import decontamination as D, queries


def bag(words):
    n = min(D.WORDS, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def plain(docs, items, least=0.8):
    """Similarity of the best window by item, over all windows of the item's size."""
    out = {}
    for d, text in docs:
        words = (text or "").encode().lower().split()
        for i, item in items:
            own = (item or "").encode().lower().split()
            best = max((D.similarity(bag(words[s : s + len(own)]), bag(own)) for s in range(len(words) - len(own) + 1)), default=0) if own else 0
            if best >= least:
                out[d, i] = round(best, 9)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(25, 60)))) for i in range(12)] + [(12, "one two"), (13, ""), (14, None), (15, "Alpha beta gamma delta epsilon")]
    docs = []
    for d in range(80):
        words = text(rng.randint(0, 120))
        if d % 3 == 0:
            passage = items[d % 12][1].split()
            for _ in range(rng.randint(0, 2)):
                k = rng.choice([0, 1, len(passage) - 1, rng.randrange(len(passage))])
                passage[k] = word()
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((d, rng.choice([" ", "\n", "  "]).join(words).upper() if d % 2 else " ".join(words)))
    docs += [(80, None), (81, ""), (82, "x one TWO y"), (83, "alpha beta gamma delta epsilon"), (83, "alpha beta gamma delta epsilon"), (84, items[3][1] + " " + items[4][1])]
    return docs, items


@pytest.mark.parametrize("item_words", [10**6, 60])
def test_leaks_equal_brute_force(spark, planted, item_words):
    docs, items = planted
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    found = D.leaks(frame, spark.createDataFrame(items, "item_id long, text string"), item_words=item_words).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == plain(docs, items)
    assert sum(r.doc_id == 83 for r in found) == 2
    assert all(r.distance <= D.RADIUS for r in found)


def test_block_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = D.Index([(i, b" ".join(b"%d" % x for x in rng.integers(0, 99, 30))) for i in range(200)], radius=12)
    size = index.sizes[30]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(400)], np.uint64)
    prints = size.prints[rng.integers(0, 200, 400)] ^ flips
    want = {(w, i) for w in range(400) for i in range(200) if int(prints[w] ^ size.prints[i]).bit_count() <= 12}
    assert set(zip(*(x.tolist() for x in index.near(size, prints)))) == want


def test_query_and_clean(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: b" ".join(t.encode().lower().split())
    given, passages = docs.collect(), items.collect()
    verbatim = {(d.doc_id, i.item_id) for d in given for i in passages if norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op2_decontamination"](spark, sf).collect()}
    assert verbatim and verbatim <= got
    assert got == set(plain([(d.doc_id, d.text) for d in given if d.doc_id in {x for x, _ in got}], [tuple(i) for i in passages]))
    assert {r.doc_id for r in D.clean(docs, items).collect()} == {d.doc_id for d in given} - {d for d, _ in got}


def test_odd_rows(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in D.leaks(odd_docs, items).collect()} == {4, 5}
    assert D.leaks(no_docs, items).collect() == D.leaks(odd_docs, items.where("false")).collect() == []
    assert D.clean(odd_docs, items).count() == odd_docs.count() - 2
