"""SimHash near-duplicate detection with a pigeonring filter.

A fingerprint is cut into ``m`` segments that stand in a ring. If two fingerprints differ in at most ``t`` bits, then some
segment starts a chain of neighbours whose summed differences stay within ``k * t / m`` for every length ``k``. So the first
``(m - 1) // t`` segments of that chain are equal, and those up to the budget of two hold at most one difference, of which one
half is then equal too: this equal part is the key by which candidates meet. The rest of the chain is checked before the
whole Hamming distance.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threatspark.llm.common import column, settle, small_batches
from threatspark.llm.graph import connected_components

BITS = 64
SEED = 42
SEGMENTS = 8
#: Keys that more distinct fingerprints share are linked by common neighbours instead of by pairs.
PAIR_LIMIT = 128
_STEP = 1 << 16


def shingles(data: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words of a text, ASCII letters in lower case; a shorter text is one run, an empty one none."""
    parts = data.lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    line = b" ".join(parts)
    ends = list(accumulate(map(len, parts)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-words])]
    return [line[a:b] for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(data: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the hashes of the runs; 0 without words."""
    runs = shingles(data, words) if data else []
    if not runs:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(runs), _STEP):
        digests = b"".join(map(xxhash.xxh64_digest, runs[at : at + _STEP], repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(runs)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; null and blank texts have fingerprint zero."""
    small_batches(docs.sparkSession)
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            made = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _mask(first: int, length: int, segments: int) -> int:
    """Bits of ``length`` segments of the ring from segment ``first`` on."""
    width, out = BITS // segments, 0
    for k in range(first, first + length):
        out |= ((1 << width) - 1) << (k % segments * width)
    return out


def ring_keys(radius: int, segments: int = SEGMENTS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Key masks, each with its chain checks ``(mask, budget)``; radius 1 at least, segments a divisor of 64."""
    equal = min(segments, (segments - 1) // radius)
    one = min(segments, (2 * segments - 1) // radius)
    half = (one - equal + 1) // 2
    out = []
    for start in range(segments):
        chain = []
        for budget in range(1, radius + 1):
            length = min(segments, ((budget + 1) * segments - 1) // radius)
            chain.append((_mask(start, length, segments), budget))
        run = _mask(start, equal, segments)
        for at, length in ((equal, half), (equal + half, one - equal - half)):
            out.append((run | _mask(start + at, length, segments), chain))
    return out


def links(prints: DataFrame, radius: int = 2, segments: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``prints(fp)`` just as all pairs within ``radius`` would.

    Keys with up to ``pair_limit`` fingerprints: every pair that passes its chain and the Hamming distance. Fuller keys: each
    of their fingerprints goes to every point within half the radius, and those that meet at a point are linked to its
    smallest member, so a crowd costs rows in proportion to its size and no link is lost.
    """
    keys = ring_keys(radius, segments)
    tags = F.array(*(F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, (mask, _) in enumerate(keys)))
    dealt = prints.select("fp", F.explode(tags).alias("k")).select("fp", "k.tag", "k.key")
    sizes = dealt.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settle(dealt.join(sizes, ["tag", "key"]))
    few = met.where(F.col("n") <= pair_limit)
    diff = F.col("a").bitwiseXOR(F.col("b"))
    passes = F.lit(False)
    for i, (_, chain) in enumerate(keys):
        ok = F.col("tag") == i
        for mask, budget in chain:
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= budget)
        passes = passes | ok
    pairs = few.select("tag", "key", F.col("fp").alias("a")).join(few.select("tag", "key", F.col("fp").alias("b")), ["tag", "key"])
    pairs = pairs.where("a < b").where(passes).where(F.bit_count(diff) <= radius).select("a", "b")
    return pairs.unionAll(_stars(met.where(F.col("n") > pair_limit).select("fp").distinct(), radius)).distinct()


def _stars(crowd: DataFrame, radius: int) -> DataFrame:
    """Fingerprints around each common point: the smallest of those within ``radius // 2`` of it, linked to all within the rest."""
    inner, outer = radius // 2, radius - radius // 2
    ball = crowd.select("fp", F.col("fp").alias("point"), F.lit(0).alias("d"))
    for step in range(outer):
        flips = F.array(F.col("point"), *(F.col("point").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))
        ball = ball.select("fp", F.explode(flips).alias("point")).distinct()
    ball = ball.select("fp", "point", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))).alias("d"))
    heart = ball.where(F.col("d") <= inner).groupBy("point").agg(F.min("fp").alias("a"))
    return ball.join(heart, "point").where("a <> fp").select("a", F.col("fp").alias("b"))


def components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: its fingerprint and the smallest id reachable over links, its own included.

    Rows with equal fingerprints are linked (null, empty and blank texts all have zero). Repeated rows and ids stay as they
    are. A null id takes part, but never names a component unless all its ids are null. Other columns are not looked at.
    """
    rows = settle(fingerprints(docs, words, id_col, text_col))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = connected_components(links(prints.select("fp"), radius))
    named = prints.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(lowest, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
