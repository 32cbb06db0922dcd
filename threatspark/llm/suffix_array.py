"""Removal of long repeated byte strings by difference-cover sampling, names, and a sort that puts equal prefixes side by side.

The full suffix order is not needed, only which prefixes of 400 bytes are equal. So the difference cover has period 181 instead of
3, and names are hashes instead of ranks, which keeps equal prefixes adjacent without a second and third round of ranking:

1. Sampled positions (residues of the cover) get the name of a triple of neighbouring names, 220 bytes in all. Names are
   sorted; those that stand beside an equal one recur. Any two equal strings of 400 bytes have sampled positions at the same
   distance from their starts, and all of 220 bytes from there lies inside them, so strings without a recurring sample are unique.
2. The remaining suffixes are those near recurring samples. Each gets the name of the triple that covers exactly its first 400
   bytes; sorted again, equal neighbours are repeats.

Texts travel once, into lots of about a megabyte. What is shuffled is one row of names for each lot and bucket of names, with
each lot's own repeats already merged, so a string that a third of all texts hold is one name for each lot. What comes back is a
bit for each name. Of texts that are equal as a whole, one gives names, and all are known to be repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threatspark.llm.common import column, settle, small_batches
from threatspark.session import ensure_checkpoint_dir

LENGTH = 400
LOT_BYTES = 1 << 20
#: Text bytes for each bucket of names: a task then sorts about as many names.
BUCKET_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_NAMES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def difference_cover(r: int) -> tuple[np.ndarray, int]:
    """A difference cover and its period ``24 r^2 + 36 r + 13``; every difference modulo the period is one of two members."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return np.cumsum([0, *steps]), 24 * r * r + 36 * r + 13


def cover_for(length: int) -> tuple[np.ndarray, int]:
    """The largest such cover that leaves sampled names a byte or more than half of ``length``; residue 0 alone for short ones."""
    best = (np.array([0]), 1)
    r = 0
    while True:
        cover, period = difference_cover(r)
        if 2 * (length - period + 1) <= length:
            return best
        best, r = (cover, period), r + 1


class Text:
    """The texts of a lot as one byte array, with names of all its substrings."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes | None]) -> None:
        texts = [t or b"" for t in texts]
        self.ends = np.cumsum([0, *map(len, texts)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        if len(Text.powers) <= n:
            with np.errstate(over="ignore"):
                Text.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
                Text.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE, np.uint64)]))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_NAMES[self.data] * Text.powers[:n])])

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings of ``length`` bytes at positions ``at``."""
        with np.errstate(over="ignore"):
            return (self.sums[at + length] - self.sums[at]) * Text.inverses[at]

    def triples(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the strings of ``length`` bytes, from the names of three parts that cover them."""
        part = -(-length // 3)
        with np.errstate(over="ignore"):
            out = np.zeros(len(at), np.uint64)
            for k, first in enumerate((0, (length - part) // 2, length - part)):
                x = self.names(at + first, part) + np.uint64(k + 1)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                out = (out ^ x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
            return out ^ (out >> np.uint64(32))

    def starts(self, length: int) -> np.ndarray:
        """Positions at which a string of ``length`` bytes lies in one text, as a mask."""
        out = np.zeros(len(self.data) + 1, np.int32)
        first, last = self.ends[:-1], self.ends[1:] - length + 1
        fits = last > first
        np.add.at(out, first[fits], 1)
        np.add.at(out, last[fits], -1)
        return np.cumsum(out)[:-1] > 0

    def sampled(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover's residues in each text, and the names there."""
        cover, period = cover_for(length)
        size = length - period + 1
        own = np.arange(len(self.data)) - np.repeat(self.ends[:-1], np.diff(self.ends))
        member = np.zeros(period, bool)
        member[cover] = True
        at = np.flatnonzero(self.starts(size) & member[own % period])
        return at, self.triples(at, size)

    def suspects(self, length: int, at: np.ndarray, names: np.ndarray, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose string has a recurring sample at a distance below the period, and the names of these strings."""
        _, period = cover_for(length)
        hits = at[among(names, recurring)]
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(hits - period + 1, 0), 1)
        np.add.at(near, hits + 1, -1)
        found = np.flatnonzero((np.cumsum(near)[:-1] > 0) & self.starts(length))
        return found, self.triples(found, length)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among ascending ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _coded(values: np.ndarray) -> bytes:
    """Ascending names as differences, byte by byte of equal weight, so that their leading zeros compress."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _decoded(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The different names of a lot by bucket, ascending in each; whether the lot has them twice; and each bucket's part."""
    values, counts = np.unique(names, return_counts=True)
    bucket = (values >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    return values[order], counts[order] > 1, list(zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(values)]))


def _marked(names: np.ndarray, buckets: int, found: list[dict] | None, bits: str) -> np.ndarray:
    """The names of a lot that ``found`` marks, ascending."""
    values, _, parts = _dealt(names, buckets)
    masks = {r["bucket"]: r[bits] for r in found or []}
    marks = np.zeros(len(values), bool)
    for bucket, a, b in parts:
        if bucket in masks:
            marks[a:b] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=b - a)
    return np.sort(values[marks])


class Lot:
    """A lot with what is known of it so far; texts that only repeat an earlier whole text give no names."""

    def __init__(self, row: dict, length: int, buckets: int) -> None:
        self.row, self.length, self.buckets = row, length, buckets
        self.texts = [t or b"" for t in row["texts"]]

    def wholes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(t) for t in self.texts], np.uint64)

    def single(self) -> Text:
        own = self.wholes()
        first = _marked(own, self.buckets, self.row["copies"], "first")
        self.copied = among(own, _marked(own, self.buckets, self.row["copies"], "again"))
        once = np.zeros(len(own), bool)
        once[np.unique(own, return_index=True)[1]] = True
        gives = ~self.copied | (among(own, first) & once)
        return Text([t if g else b"" for t, g in zip(self.texts, gives)])

    def sampled(self) -> np.ndarray:
        return self.single().sampled(self.length)[1]

    def suspects(self) -> tuple[Text, np.ndarray, np.ndarray]:
        text = self.single()
        at, names = text.sampled(self.length)
        return text, *text.suspects(self.length, at, names, _marked(names, self.buckets, self.row["samples"], "again"))

    def spans(self) -> tuple[list[list[dict]], list[bytes]]:
        """Spans to remove from each text, and what is left of it."""
        text, at, names = self.suspects()
        hits = at[among(names, _marked(names, self.buckets, self.row["strings"], "again"))]
        marks = np.zeros(len(text.data) + 1, np.int32)
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + self.length, -1)
        gone = np.cumsum(marks)[:-1] > 0
        spans, kept = [], []
        for t, copied, a, b in zip(self.texts, self.copied, text.ends.tolist(), text.ends[1:].tolist()):
            if copied and len(t) >= self.length:
                spans.append([{"start": 0, "until": len(t)}])
                kept.append(b"")
            elif copied:
                spans.append([])
                kept.append(t)
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist()
                spans.append([{"start": x, "until": y} for x, y in zip(edges[::2], edges[1::2])])
                kept.append(text.data[a:b][~gone[a:b]].tobytes())
        return spans, kept


def pack_lots(docs: DataFrame, id_col: str, text_col: str, lot_bytes: int) -> DataFrame:
    """``(lot, ids, texts)``, written once and bucketed by lot, so that what is found by lot comes to the texts and not the reverse."""
    spark = docs.sparkSession
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("binary").alias("data"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0), batch.column(1).to_pylist()):
                ids.append(doc.as_py())
                texts.append(data)
                held += len(data or b"") + 16
                if held >= lot_bytes:
                    yield _lot(lot, ids, texts, batch.schema.field(0).type)
                    lot, ids, texts, held = lot + 1, [], [], 0
        if ids:
            yield _lot(lot, ids, texts, batch.schema.field(0).type)

    name = f"lots_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = slim.mapInArrow(run, f"lot long, ids array<{kind}>, texts array<binary>")
    made.write.bucketBy(parts, "lot").option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _lot(lot: int, ids: list, texts: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lot]), pa.array([ids], pa.list_(kind)), pa.array([texts], pa.list_(pa.binary()))], ["lot", "ids", "texts"])


def recurring(lots: DataFrame, name: str, names: Callable[[dict], np.ndarray], buckets: int) -> DataFrame:
    """``(lot, name)``: for the lot's names by bucket, bits that tell which occur twice or more in all lots (``again``), and for
    which the lot is the first that has them (``first``)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                values, twice, parts = _dealt(names(row), buckets)
                columns = [[p[0] for p in parts], [row["lot"]] * len(parts), [_coded(values[a:b]) for _, a, b in parts], [np.packbits(twice[a:b]).tobytes() for _, a, b in parts]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "lot", "names", "twice"])

    def settle_bucket(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r["lot"])
        values = [_decoded(r["names"]) for r in rows]
        twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(v)).astype(bool) for r, v in zip(rows, values)]
        line = np.concatenate(values)
        order = np.argsort(line, kind="stable")  # equal names side by side, the first lot in front
        same = np.zeros(len(line), bool)
        same[1:] = line[order][1:] == line[order][:-1]
        first, again = np.zeros(len(line), bool), np.concatenate(twice)
        first[order] = ~same
        again[order[same]] = True
        again[order[:-1][same[1:]]] = True
        known = np.unique(line[again])
        again = among(line, known)
        ends = np.cumsum([0, *map(len, values)]).tolist()
        found = [(r["lot"], r["bucket"], np.packbits(again[a:b]).tobytes(), np.packbits(first[a:b]).tobytes()) for r, a, b in zip(rows, ends, ends[1:]) if again[a:b].any()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], ["lot", "bucket", "again", "first"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield settle_bucket(held)
                    held = []
                held.append(row)
        if held:
            yield settle_bucket(held)

    dealt = lots.mapInArrow(deal, "bucket long, lot long, names binary, twice binary")
    parts = int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "lot long, bucket long, again binary, first binary")
    return settle(met.groupBy("lot").agg(F.collect_list(F.struct("bucket", "again", "first")).alias(name)))


def repeats(docs: DataFrame, length: int = LENGTH, lot_bytes: int = LOT_BYTES, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` per row: the byte spans covered by repeated strings of ``length`` bytes, and what is left.

    A string is repeated if it starts anywhere else, in the same text or another; strings do not cross texts and may overlap.
    Spans are maximal, in order, as ``(start, until)``. Null texts count as empty; texts shorter than ``length`` are kept whole.
    Repeated rows are copies of each other. An empty table gives no rows. Equal strings are told by 64-bit names: among n suspect
    strings about ``n^2 / 2^65`` pairs of different ones are taken for equal.
    """
    small_batches(docs.sparkSession, 64)
    lots = pack_lots(docs, id_col, text_col, lot_bytes)
    total = lots.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0))))).first()[0] or 0
    buckets = max(16, total // bucket_bytes)
    texts = lots.select("lot", "texts")
    copies = recurring(texts, "copies", lambda row: Lot(row, length, buckets).wholes(), buckets)
    known = texts.join(copies, "lot", "left")
    samples = recurring(known, "samples", lambda row: Lot(row, length, buckets).sampled(), buckets)
    known = known.join(samples, "lot", "left")
    strings = recurring(known, "strings", lambda row: Lot(row, length, buckets).suspects()[2], buckets)
    known = lots.join(copies, "lot", "left").join(samples, "lot", "left").join(strings, "lot", "left")
    kind = lots.schema["ids"].dataType.elementType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("until", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                lot = Lot(one.to_pylist()[0], length, buckets)
                spans, kept = lot.spans()
                arrays = [one.column("ids").flatten(), pa.array(map(len, lot.texts), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "spans", "kept"])

    return known.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,until:bigint>>, kept binary")
