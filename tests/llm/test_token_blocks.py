import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from threatspark.llm import queries, token_blocks as T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50_000), max_size=300), st.integers(1, 64), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_blocks_round_trip(values, block, share):
    array = np.array(values, np.uint64)
    data = T.pack(array, block, share)
    assert T.unpack(data).tolist() == values
    assert T.unpack(data, 3, 40).tolist() == values[3:43]


def test_outliers_do_not_widen_a_block():
    values = np.arange(1000, 5000, dtype=np.uint64)
    values[7] = 1 << 40
    assert len(T.pack(values)) < 4000 * 13 / 8 + 200


def test_query_equals_whole_text_encoding(spark, sf):
    tool = Tokenizer.from_file(queries.vocabulary())
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for i, text in docs:
        ids = np.array([*tool.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op10_token_blocks"](spark, sf).collect())) == want


def test_memory_of_words_is_bounded_without_loss():
    tool = T.Encoder(queries.vocabulary(), 5)
    for k in range(6):
        text = " ".join(f"w{k * j}x{'y' * (80 * (j % 2))}" for j in range(9))
        assert tool.ids(text.encode()).tolist() == tool.tool.encode(text, add_special_tokens=False).ids
    assert len(tool.kept) < 20


@pytest.mark.parametrize("segment_ids", [1, 1 << 17])
def test_odd_rows(spark, odd_docs, no_docs, segment_ids):
    path = queries.vocabulary()
    rows = T.read_documents(T.write(odd_docs, path, parts=3, segment_ids=segment_ids)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 7, 7]
    assert [r.n_tokens for r in rows][1:4] == [1, 1, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert T.read_documents(T.write(no_docs, path)).collect() == []


def test_words_of_latin_letters_go_to_the_model_alone(monkeypatch):
    tool = T.Encoder(queries.vocabulary())
    words = "straße élève niño. façon, ﬁn ǆungla ŉ don't naïve; Élan ÉLAN, iİ ıx ſo ʼn ̈a a̧b x9y ñ. œuvre µm ºC ª . , abc, ABC".split()
    texts = [" ".join(words), "\n".join(reversed(words)), *words]
    want = [tool.tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tool.ids_of([t.encode() for t in texts])] == want
    alone = T.Encoder(queries.vocabulary())
    called, real = [], alone.tool
    monkeypatch.setattr(alone, "tool", type("Only", (), {"model": real.model, "encode_batch_fast": lambda self, *a, **k: called.append(a)})())
    text = "straße élève niño abc Abc"
    assert alone.ids(text.encode()).tolist() == real.encode(text, add_special_tokens=False).ids and not called
