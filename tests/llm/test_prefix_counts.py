"""Counts at every prefix against the tokenizer library, and questions answered from them."""

import random

import pytest
from pyspark.sql import functions as F

from threatspark.llm import prefix_counts

PIECES = ["a", "b", "c", "▁", "ab", "bc", "abc", "▁a", "▁▁", "ca", "▁ab"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def test_every_prefix(path, library):
    counter = prefix_counts.PrefixCounter.load(path)
    rng = random.Random(5)
    parts = [*"ab  \n\té▁ﬁ中字😀0123<s>/INST[]", "the", "ing", " of", "́", "　", "\x00", "</s>", "<0x0A>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    for text in [*texts, "", " ", "▁", "\n", "\n\n a", "x" * 300, " " * 70]:
        assert counter.counts(text) == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def merged(text, scores):
    parts = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        found = [(-scores[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores]
        if not found:
            return sum(1 if p in scores else len(p.encode()) for p in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_any_scores(seed):
    """Any order of merges, equal scores, and pieces that reach over blanks."""
    rng = random.Random(seed)
    pieces = PIECES + (["b▁", "b▁a"] if seed % 3 == 0 else [])
    scores = {p: float(-rng.randint(0, 6)) for p in pieces}
    counter = prefix_counts.PrefixCounter(scores, units_kept=5)
    for _ in range(40):
        text = "".join(rng.choices("abc  x\né", k=rng.randint(0, 14)))
        assert counter.counts(text) == [merged(text[:i], scores) for i in range(len(text) + 1)], (text, scores)


def test_wide_steps():
    """A long piece that its last character completes takes the count down by more than a byte holds."""
    long = "ab" * 128
    scores = {long[:n] + tail: 0.0 for n, tail in [(0, "a"), (0, "b"), (0, "▁")]}
    scores |= {"ab" * (1 << k): -9.0 + k for k in range(8)}
    counter = prefix_counts.PrefixCounter(scores)
    text = "c" * 3 + "ab" * 128
    want = [merged(text[:i], scores) for i in range(len(text) + 1)]
    assert counter.counts(text) == want
    fake = prefix_counts.PrefixCounter(scores)
    fake.learn = lambda units: dict.fromkeys(units)
    assert fake.steps(text).dtype == "int32" and fake.counts(text) == want


def test_questions(spark, path, library, odd_docs):
    texts = [(i, r.text) for i, r in enumerate(odd_docs.select("text").collect())]
    docs = spark.createDataFrame([*texts, (50, "the theory of the  thing\nand é 😀")], "doc_id long, text string")
    indexed = prefix_counts.index(docs, path, keep=["doc_id", "text"])
    asked = prefix_counts.longest_within(prefix_counts.tokens_before(indexed, F.col("doc_id") % 9), 4)
    rows = asked.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = r.text or ""
        assert r.n_before == len(library.encode(text[: r.doc_id % 9]))
        fits = [i for i in range(min(len(text), 400) + 1) if len(library.encode(text[:i])) <= 4]
        assert r.n_fit == fits[-1]
    nothing = prefix_counts.longest_within(indexed, F.lit(None).cast("long")).first()
    assert nothing.n_fit is None


def test_odd_rows(path, library, odd_docs, no_docs):
    clashing = odd_docs.withColumn("tokens", F.lit(3)).withColumn("steps", F.lit(1))
    rows = prefix_counts.index(clashing, path, keep=clashing.columns).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        text = r.text or ""
        assert (r.tokens.n_bytes, r.tokens.n_chars, r.tokens.n_tokens) == (len(text.encode()), len(text), len(library.encode(text)))
    assert prefix_counts.index(no_docs, path).count() == 0


def test_whole_table(spark, sf, library):
    import __spark_entry__ as entry

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = entry.queries()["op11_prefix_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_other_models_are_refused(monkeypatch, path):
    """A model whose normaliser changes texts has other counts, so the counter does not take it."""
    import sentencepiece

    class Lower(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return super().normalize(text).lower()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Lower)
    with pytest.raises(ValueError, match="leaves texts as they are"):
        prefix_counts.PrefixCounter.load.__func__.__wrapped__(prefix_counts.PrefixCounter, path)
