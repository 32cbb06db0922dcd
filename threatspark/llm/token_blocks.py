"""Token ids in patched frame-of-reference blocks.

A segment is one binary value of whole documents in order: a header, an index of where each block starts, the blocks, and
the documents' ids and lengths in blocks of the same kind. A block subtracts its minimum, packs every difference at the width
that holds a given share of them, and lists the rest as exceptions. Segments are rows of a table, so that Spark's committed
writes give files in any store, and a lost task leaves nothing half written.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threatspark.llm.common import column, release, settle, small_batches

MAGIC = b"PFOR"
BLOCK = 4096
#: Share of a block's values that its packed width must hold.
SHARE = 0.95
#: A segment is closed by the document that brings it to this many ids.
SEGMENT_IDS = 1 << 17
END_ID = 1
#: A task orders the ids of about so many documents, in a few ranges; ranges are cut at quantiles of the id.
TASK_ROWS = 50_000
RANGES_A_TASK = 4
QUANTILES = 2048
#: Words whose ids a worker remembers before its memory starts anew.
WORDS_KEPT = 1_000_000
#: Longer words are encoded each time and not remembered.
LONGEST_KEPT = 64

_HEAD = struct.Struct("<4sIQI")
_BLOCK = struct.Struct("<QHBBI")


def pack_block(values: np.ndarray, share: float = SHARE) -> bytes:
    """One block of unsigned integers: minimum, count, width, exceptions, packed differences, exceptions' places and high bits."""
    low = int(values.min()) if len(values) else 0
    rest = values.astype(np.uint64) - np.uint64(low)
    if len(rest):
        at = min(len(rest) - 1, int(np.ceil(share * len(rest))) - 1)
        width = int(np.partition(rest, at)[at]).bit_length()
    else:
        width = 0
    places = np.flatnonzero(rest >> np.uint64(width)) if width < 64 else np.empty(0, np.int64)
    high = rest[places] >> np.uint64(width) if width < 64 else rest[:0]
    shifts = np.arange(width, dtype=np.uint64)
    bits = ((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits, bitorder="little").tobytes()
    head = _BLOCK.pack(low, len(values), width, 0, len(places))
    return head + packed + places.astype("<u2").tobytes() + high.astype("<u8").tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    low, n, width, _, odd = _BLOCK.unpack_from(data)
    at = _BLOCK.size
    size = (n * width + 7) // 8
    out = np.zeros(n, np.uint64)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 64), np.uint8)
        whole[:, :width] = bits
        out = np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel().copy()
    at += size
    places = np.frombuffer(data, "<u2", odd, at)
    high = np.frombuffer(data, "<u8", odd, at + 2 * odd)
    out[places] |= high << np.uint64(width)
    return out + np.uint64(low)


def pack(values: np.ndarray, block: int = BLOCK, share: float = SHARE) -> bytes:
    """Header, block starts, blocks. ``block`` is 65 536 at most; ``values`` are unsigned and may be empty."""
    blocks = [pack_block(values[i : i + block], share) for i in range(0, len(values), block)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return _HEAD.pack(MAGIC, block, len(values), len(blocks)) + starts.tobytes() + b"".join(blocks)


def unpack(data: bytes | memoryview, first: int = 0, count: int | None = None) -> np.ndarray:
    """Values ``first`` to ``first + count``; only the blocks that hold them are decoded, found by the index."""
    data = memoryview(data)
    magic, block, total, n = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block stream")
    end = total if count is None else min(total, first + count)
    if first >= end:
        return np.empty(0, np.uint64)
    starts = np.frombuffer(data, "<u8", n + 1, _HEAD.size)
    base = _HEAD.size + 8 * (n + 1)
    wanted = range(first // block, (end - 1) // block + 1)
    got = [unpack_block(data[base + int(starts[i]) : base + int(starts[i + 1])]) for i in wanted]
    return np.concatenate(got)[first - wanted[0] * block : end - wanted[0] * block]


class Encoder:
    """Ids of whole texts, for tokenizers in which no token spans ASCII white space.

    Such a text's ids are its words' ids one after the other, so each different word is encoded once and remembered in a
    memory of bounded size. A tokenizer for which this does not hold on a probe, or that sets case or marks apart, is refused.
    """

    #: A word of one token, told apart from all others by its character.
    MARK = "\U0001f602"
    PROBE = "It's  a Test, test. TEST 3.14\n\tdon't stop É é <|endoftext|> x<|startoftext|>y \u0301a"

    def __init__(self, path: str, words_kept: int = WORDS_KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}
        self.words_kept = words_kept
        mark = self.tool.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.letters = self._letters()
        if self.ids(self.PROBE.encode()).tolist() != self.tool.encode(self.PROBE, add_special_tokens=False).ids:
            raise ValueError("this tokenizer joins words across white space")

    def _letters(self) -> dict[int, str]:
        """Small Latin letters and the text that the library's normaliser and pre-tokeniser make of each, if words of them are one piece.

        Such words go straight to the library's model. Empty if letters join in another way, or a special token is made of letters.
        """
        tool = self.tool
        line = "".join(c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.islower() and c == c.lower())
        norm = (lambda x: tool.normalizer.normalize_str(x)) if tool.normalizer else (lambda x: x)
        if not tool.pre_tokenizer or tool.post_processor:
            return {}
        made = {c: tool.pre_tokenizer.pre_tokenize_str(norm(c)) for c in line}
        table = {ord(c): x[0][0] for c, x in made.items() if norm(c) == c and len(x) == 1}
        line = "".join(c for c in line if ord(c) in table)
        if any(x.content.lower().translate({ord(c): None for c in line}) == "" for x in tool.get_added_tokens_decoder().values()):
            return {}
        probes = [line, line[::-1], line[1::2] + line[::2]]
        if any(table[ord(c)] != c for c in line if c.isascii()):
            return {}
        whole = all([x for x, _ in tool.pre_tokenizer.pre_tokenize_str(norm(p))] == [p.translate(table)] for p in probes)
        return table if whole and norm(line) == line else {}

    def _lettered(self, text: str) -> bool:
        return all(map(self.letters.__contains__, map(ord, text)))

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different words: of small Latin letters by the model alone, of others by one call, where a mark between the words tells
        whose they are.

        Only text with the mark's character can have the mark's id, so words that hold it are given to the call one by one.
        """
        found, others, letters, model = {}, [], self.letters, self.tool.model.tokenize
        for w in words:
            t = w.decode()
            if letters and w.isalpha() and w.islower():
                found[w] = array("I", [x.id for x in model(t)]).tobytes()
            elif letters and self._lettered(t):
                found[w] = array("I", [x.id for x in model(t.translate(letters))]).tobytes()
            else:
                others.append((w, t))
        told = self.mark is not None
        joined = [(w, t) for w, t in others if told and self.MARK not in t]
        single = [(w, t) for w, t in others if not told or self.MARK in t]
        if joined:
            line = np.array(self.tool.encode_batch_fast([f" {self.MARK} ".join(t for _, t in joined)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(line == self.mark).tolist()
            data = line.tobytes()
            found.update((w, data[4 * i + 4 : 4 * j]) for (w, _), i, j in zip(joined, [-1, *stops], [*stops, len(line)]))
        if single:
            made = self.tool.encode_batch_fast([t for _, t in single], add_special_tokens=False)
            found.update((w, np.array(x.ids, "<u4").tobytes()) for (w, _), x in zip(single, made))
        return found

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text; the words that are new in all of them are encoded together."""
        if len(self.kept) > self.words_kept:
            self.kept.clear()
        look = self.kept.get
        lines = [t.split() for t in texts]
        found = [list(map(look, words)) for words in lines]
        gaps = {i: [k for k, x in enumerate(line) if x is None] for i, line in enumerate(found) if None in line}
        fresh = self._learn({lines[i][k] for i, places in gaps.items() for k in places}) if gaps else {}
        for i, places in gaps.items():
            for k in places:
                found[i][k] = fresh[lines[i][k]]
        self.kept.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST_KEPT)
        return [np.frombuffer(b"".join(line), "<u4") for line in found]

    def ids(self, data: bytes) -> np.ndarray:
        return self.ids_of([data])[0]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        kept = self.kept
        # Latin letters with a stop or comma are the small letters' ids and the mark's: their forms are encoded once.
        parts = {}
        for w in words:
            tail = w[-1:] if w[-1:] in (b".", b",") else b""
            stem = w[: len(w) - len(tail)].lower()
            parts[w] = (stem, tail) if stem.isalpha() or tail and self._lettered(stem.decode()) else (w, b"")
        wanted = {x for pair in parts.values() for x in pair if x and x not in kept}
        fresh = self._fresh(list(wanted))
        find = lambda x: fresh[x] if x in fresh else kept[x]
        fresh.update([(w, find(stem) + find(tail) if tail else find(stem)) for w, (stem, tail) in parts.items()])
        return fresh


@lru_cache(maxsize=2)
def _encoder(path: str, words_kept: int) -> Encoder:
    return Encoder(path, words_kept)


def _cuts(slim: DataFrame, parts: int | None) -> np.ndarray:
    """Ids at which a new range of documents begins; ranges are near equal in rows, and as many as the rows need. No text is read."""
    quantiles = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)
    cuts, size = slim.select("doc_id").agg(quantiles(QUANTILES), F.count(F.lit(1))).first()
    if cuts is None:
        return np.empty(0, np.int64)
    least = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = parts or RANGES_A_TASK * max(least, -(-size // TASK_ROWS))
    if wanted > QUANTILES:
        cuts = slim.select("doc_id").agg(quantiles(wanted)).first()[0]
    known = len(cuts) + 1
    return np.unique(np.array(cuts, np.int64)[[i * known // wanted - 1 for i in range(1, wanted)]])


SEGMENT_SCHEMA = "part int, number int, start_in_part long, first_doc long, n_docs int, n_ids long, tokens binary, doc_ids binary, lengths binary"
_NAMES = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]


def encode(docs: DataFrame, tokenizer: str, parts: int | None = None, end_id: int = END_ID, block: int = BLOCK, share: float = SHARE, segment_ids: int = SEGMENT_IDS, words_kept: int = WORDS_KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all documents in ascending order of id: each text's ids and then ``end_id``.

    ``tokenizer`` is a file of the tokenizers library that every executor can open. Null and empty texts have only the end id. Rows
    of equal doc ids stand in the order of their token ids; a null id comes first and is stored as the smallest long. Ids are taken as
    longs; other columns are not looked at. An empty table gives no segment. ``words_kept`` bounds a worker's memory of words
    and changes no result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), column(text_col).cast("binary").alias("data"))

    cuts = _cuts(slim, parts)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _encoder(tokenizer, words_kept)
        kind = "<u2" if tool.tool.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            found = tool.ids_of([x or b"" for x in batch.column(1).to_pylist()])
            lines = [x.astype(kind).tobytes() for x in found]
            at = np.searchsorted(cuts, batch.column(0).to_numpy(), "right").astype(np.int32)
            columns = [pa.array(at), batch.column(0), pa.array([int(kind[2])] * len(lines), pa.int32()), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "width", "ids"])
        release()

    # Texts are read where they lie; only their ids travel, each range of documents to one task.
    made_ids = slim.mapInArrow(to_ids, "part int, doc_id long, width int, ids binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(cuts) // RANGES_A_TASK))
    dealt = made_ids.repartition(tasks, "part").sortWithinPartitions("part", "doc_id", "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, made, held, number, part, before = [], [], [], 0, 0, 0, 0

        def segment() -> pa.RecordBatch:
            docs_in = np.array(ids, np.int64).view(np.uint64)
            values = [part, number, before, ids[0], len(ids), held, pack(np.concatenate(made), block, share), pack(docs_in, block, share), pack(np.array(lengths, np.uint64), block, share)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _NAMES)

        end = np.array([end_id], "<u4")
        for batch in batches:
            for now, doc, width, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != part:
                    if ids:
                        yield segment()
                    ids, lengths, made, held, number, part, before = [], [], [], 0, 0, now, 0
                got = np.frombuffer(data, f"<u{width}").astype("<u4")
                ids.append(doc)
                lengths.append(len(got) + 1)
                made += [got, end]
                held += len(got) + 1
                if held >= segment_ids:
                    yield segment()
                    ids, lengths, made, before, held, number = [], [], [], before + held, 0, number + 1
        if ids:
            yield segment()
        release()

    return dealt.mapInArrow(run, SEGMENT_SCHEMA)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the segments as a table (in ``folder``, or the shared folder) and return that table, read back."""
    made = encode(docs, tokenizer, **options)
    if folder is None:
        return settle(made)
    made.write.mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def read_documents(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from segments: ``start`` counts the ids of all documents before."""
    # One row per part, of which there are as many as the writing stage had tasks.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(bases), "part").withColumn("base", F.col("base") + F.col("start_in_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs = unpack(row["doc_ids"]).view(np.int64)
                lengths = unpack(row["lengths"]).astype(np.int64)
                ids = unpack(row["tokens"]).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())]
                arrays = [pa.array(docs, mask=docs == -(1 << 63)), pa.array(ends - lengths + row["base"]), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("tokens", "doc_ids", "lengths", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
