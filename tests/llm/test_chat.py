import random

import pytest

from pyspark.sql import functions as F

from tests import oracle
from threatspark.llm import chat, queries

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<\\s>", "[\\\\/INST]", "<", "[", "\n", " "]


def test_query_equals_sql(spark, sf):
    got = queries.QUERIES["op8_chat"](spark, sf).toPandas()
    assert oracle.compare(got, oracle.connect(sf).execute(queries.ORACLES["op8_chat"]).df()) is None


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    pool = [(rng.choice(["user", "assistant", "system", "tool\n\\x", None]), rng.choice([None, "", *("".join(rng.choices(CONTROL + ["a", "é"], k=6)) for _ in range(8))])) for _ in range(12)]
    talks = {c: [pool[rng.randint(0, 2)] for _ in range(rng.randint(1, 3))] + [rng.choice(pool) for _ in range(rng.randint(0, 4))] for c in range(60)}
    talks[60] = [pool[k % 12] for k in range(400)]
    talks[61] = talks[60][:300]
    rows = [(c, k, r, t, 1) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    tree = chat.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(5))
    return talks, tree


def test_round_trip(talks):
    talks, tree = talks
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(tree).collect()}
    assert back == {c: [(r or "", t or "") for r, t in turns] for c, turns in talks.items()}


def test_shared_turns_once_and_attention_is_the_history(talks):
    talks, tree = talks
    nodes = {r.node: r for r in tree.nodes.collect()}
    want = {tuple((r or "", t or "") for r, t in turns[: k + 1]) for turns in talks.values() for k in range(len(turns))}
    assert len(nodes) == len(want)
    stream = "".join(n.content for n in sorted(nodes.values(), key=lambda n: n.stream_from))
    at = 0
    for n in sorted(nodes.values(), key=lambda n: n.stream_from):
        assert n.stream_from == at
        at += n.units
    for c in tree.conversations.collect():
        history = ""
        for name in c.nodes:
            n = nodes[name]
            assert n.position == len(history)
            assert "".join(stream[a.start : a.until] for a in n.attends) == history
            history += n.content
    parents = {c.nodes[k]: c.nodes[k - 1] for c in tree.conversations.collect() for k in range(1, len(c.nodes))}
    path = []
    for n in sorted(nodes.values(), key=lambda n: n.stream_from):  # depth first: the parent is the last node one level up
        del path[n.depth - 1 :]
        assert n.depth == 1 or path[-1] == parents[n.node]
        path.append(n.node)


def test_no_control_string_is_left(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(CONTROL, k=8)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in CONTROL[:8]) for r in rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "assistant", "y " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.build(frame)).collect()}
    assert back == {None: [("", ""), ("user", "a")], 1: [("user", "x")] * 2, 2: [("assistant", "y " * 50_000)]}
    assert chat.read_back(chat.build(frame.where("false"))).collect() == []
