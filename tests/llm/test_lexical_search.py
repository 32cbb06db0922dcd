"""Ranked search against scores computed for every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from threatspark.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counted:
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 50 + 50 * sum(c.values()) * n_docs // n_terms
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return Counter(out)


def test_terms():
    for text in ["It's ÀB_c-d\x7fe f Ünï 3.5", "", "a\x00b", "ＡＢ A"]:
        assert [t.decode() for t in lexical_search.terms(text.encode())] == terms(text)


@pytest.mark.parametrize("seed", range(8))
def test_best_position(seed):
    """Any lists, many ties; the reading stops early where the lists allow it."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, k = int(rng.integers(1, 80)), int(rng.integers(1, 8))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 6)):
            docs = rng.permutation(n)[: rng.integers(1, n + 1)]
            impact = np.sort(rng.integers(1, rng.integers(2, 60), len(docs)))[::-1]
            total[docs] += impact
            lists.append((docs, impact))
        want = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:k]
        top, scores, _ = lexical_search.best_position(lists, n, k, first_read=1)
        assert top.tolist() == want and scores.tolist() == total[want].tolist()


def test_reading_stops():
    docs = np.arange(100_000)
    impact = np.concatenate([np.full(100, 1000), np.ones(99_900, np.int64)])
    top, _, read = lexical_search.best_position([(docs, impact), (docs, impact)], len(docs), 50)
    assert top.tolist() == list(range(50)) and read < 2000


def check(spark, docs, items, k=5):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS terms", "2 AS row", "3 AS score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS w", "2 AS item")
    got = Counter(map(tuple, lexical_search.search(frame, asked, k).collect()))
    assert got == brute(docs, items, k)
    return got


def test_against_every_document(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "POSTINGS", 2000)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 60)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É", "x_y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(40)]  # copies that tie
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(9)]
    check(spark, docs, items)
    monkeypatch.setattr(lexical_search, "FEW_TERMS", 1)  # all terms listed, joined later
    check(spark, docs, items)


def test_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "one TRÈS long"), (1, "one TRÈS long"), (1, "id"), (2, None), (3, " .,"), (None, "here one"), (4, "absent")]
    got = check(spark, docs, items)
    assert {r[0] for r in got} == {1, None}
    for some, others in ((docs, []), ([], items), ([(1, None)], items), (docs, [(1, None)])):
        assert not check(spark, some, others)
