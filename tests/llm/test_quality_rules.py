import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threatspark.llm import quality_rules as Q, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    runs = list(zip(words, words[1:], words[2:]))
    counts = Counter(runs)
    covered = {k + d for k, r in enumerate(runs) if counts[r] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        want = plain(docs[r.doc_id])
        assert tuple(r[n] for n in NAMES) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            total += 1
            right += r.kept == bool(labels[r.doc_id])
    assert right / total > 0.95


def test_statistics_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "x y z x y z", "l\nl\n \nl", "é\u00a0ö\x0bü", "#" * 9, "a b c " * 20_000, *(" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(60))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, text string, stats int")
    for r in Q.with_statistics(frame).collect():
        assert tuple(r.stats[n] for n in NAMES) == plain(texts[r.i]), texts[r.i]


def test_list_learns_a_planted_rule_and_keeps_others(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(80)]
        bad = i % 3 == 0
        if bad:
            words = [w + "#$" if i % 2 else w.upper() for w in words]
        rows.append((i, " ".join(words), int(not bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = Q.learn(frame.where("doc_id < 600"), frame)
    assert len(rules) == 2 and all(len(r) == 1 for r in rules)
    held = Q.judged(frame.where("doc_id >= 600"), rules)
    assert held.where(F.col("kept") != (F.col("quality") == 1)).count() == 0
    assert Q.keep_good(frame, frame).columns == frame.columns


@pytest.mark.parametrize("only", [0, 1, None])
def test_labels_of_one_kind_give_no_rules(spark, odd_docs, no_docs, only):
    labels = spark.createDataFrame([(1, only), (7, only), (None, 0)], "doc_id long, quality int")
    assert Q.learn(odd_docs, labels) == [] and Q.learn(no_docs, labels) == []
    assert len(Q.judged(odd_docs, []).collect()) == odd_docs.count()
