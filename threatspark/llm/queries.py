"""Registered queries of the training-data operators and, where SQL can say it, the same query as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from threatspark.llm import chat, decontamination, hard_negatives, html_extraction, lexical_search, mixing, prefix_counts, quality_rules, sharding, simhash, suffix_array, token_blocks, url_rules
from threatspark.llm.common import settle, table, vocabulary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    """Fingerprint and component of every document: runs of three words, links at two bits or fewer."""
    found = simhash.components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_token_blocks(spark, sf_dir):
    """Token ids of every document, written in blocks and read back."""
    return token_blocks.read_documents(token_blocks.write(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op4_mixing(spark, sf_dir):
    """Words that the mix takes of every document, summed over its draws."""
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    taken = F.aggregate("mix.draws", F.lit(0).cast("long"), lambda total, draw: total + draw["words"])
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


# Saturated sources are the first ones by words for each unit of weight; fractions stay whole numbers until one division.
ORACLES["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source
), r AS (
  SELECT *, sum(words) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
    coalesce(sum(words) OVER o, 0)::BIGINT AS words_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before
  FROM s WINDOW o AS (ORDER BY words::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, w * (3 * total - 4 * words_before) > 4 * (all_w - w_before) * words AS is_full FROM r
), c AS (
  SELECT *, coalesce(sum(words) FILTER (is_full) OVER (), 0)::BIGINT AS full_words, coalesce(sum(w) FILTER (is_full) OVER (), 0)::BIGINT AS full_w FROM f
), t AS (
  SELECT source, words, CASE WHEN is_full THEN 2 * words ELSE w * (3 * total - 4 * full_words) END AS num, CASE WHEN is_full THEN 1 ELSE 2 * (all_w - full_w) END AS den FROM c
), q AS (
  SELECT source, words, num::DOUBLE / den::DOUBLE AS target, (2 * num + den) // (2 * den) AS quota FROM t
), p AS (
  SELECT doc_id, size, words, target, CASE WHEN words = 0 THEN 0 ELSE quota // words END AS rounds, quota, d.source,
    row_number() OVER o AS pos, (sum(size) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  WINDOW o AS (PARTITION BY d.source ORDER BY md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), size)
), g AS (
  SELECT *, quota - rounds * words AS rest FROM p
), h AS (
  SELECT *, rest > 0 AND upto <= rest AS fits, rest - coalesce(max(upto) FILTER (rest > 0 AND upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM g
), e AS (
  SELECT *, rest > 0 AND NOT fits AND abs(size - gap) < gap
    AND row_number() OVER (PARTITION BY source, rest > 0 AND NOT fits ORDER BY abs(size - gap), pos) = 1 AS extra FROM h
)
SELECT doc_id, size, words AS source_size, target, rounds * size + CASE WHEN fits OR extra THEN size ELSE 0 END AS taken FROM e
"""


@query
def op7_sharding(spark, sf_dir):
    """Every document in one of 24 shards of nearly equal bytes; equal texts share a shard."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


@query
def op9_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document; the decision list is learned from the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    stats = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_rules.judged(docs, rules).select("doc_id", *stats, "base_failed", "kept")


#: Fixed rules of the URL query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def labelled_urls(pages, labels):
    """Pages and documents share ids; a page is bad if its document is labelled of low quality or toxic in any row."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("page_id", "url").join(bad, "page_id").select("url", "bad")


@query
def op6_url_rules(spark, sf_dir):
    """Verdict on the URL of every page, by fixed rules and by rules mined from labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")


@query
def op8_chat(spark, sf_dir):
    """Every conversation, read back from the prefix tree; one more conversation is made of control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    tree = chat.build(given.unionAll(extra))
    back = chat.read_back(tree)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("losses", chat.unescape), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op8_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 17 + length(role) END + length(text)
    + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|</?SYS>>|/?ROLE\])')) AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query
def op2_decontamination(spark, sf_dir):
    """Documents that hold a passage similar to a benchmark item, with the best window for each item."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_html_extraction(spark, sf_dir):
    """Main text of every page, by a model trained on labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = html_extraction.train(html_extraction.labelled_pages(pages))
    return html_extraction.extract(pages, model).select("page_id", "url", "text", "n_chars")


@query
def pipeline(spark, sf_dir):
    """The corpus pipeline over the documents table."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def op5_suffix_array(spark, sf_dir):
    """Bytes of every document that lie in a string of 400 bytes which starts anywhere else as well."""
    found = suffix_array.repeats(table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_prefix_counts(spark, sf_dir):
    """Token count of every document, the last one of its counts at every prefix; the prefixes are written first."""
    import public_tokenizers

    indexed = settle(prefix_counts.index(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
    return indexed.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", (F.col("tokens.n_tokens") > 4096).alias("over_limit"))


@query
def op12_lexical_search(spark, sf_dir):
    """The 50 best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


ORACLES["op12_lexical_search"] = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark
), s AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t
), p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM t) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs
), q AS (
  SELECT item_id, unnest(terms) AS term FROM i
), f AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0
)
SELECT * FROM r WHERE rank <= 50
"""


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh vector has its label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
    list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
  FROM s WHERE label = anchor_label
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.anchor_label AND positive_rank <= 5
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 10
"""
