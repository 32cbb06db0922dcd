"""Benchmark decontamination: item-sized windows, SimHash, a multi-index over Hamming blocks, exact weighted similarity.

A benchmark item and a window of as many words are compared as bags of runs of five words. A window can only be similar to an
item with which it shares a run, so windows without a run of an item of their size are passed over; the others get a SimHash.
Fingerprints of one size are cut into ``radius + 1`` blocks: two within the radius are equal in one block at least, so the
block index finds all of them. Those within the radius are then verified by the weighted similarity of their runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threatspark.llm.common import column, release, small_batches

WORDS = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 fingerprints differ in 9.6 bits on average, with a deviation of 2.9.
RADIUS = 20
BITS = 64
#: Words of benchmark items that go to the executors at once; more items take more passes over the documents.
ITEM_WORDS = 2_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    parts = data.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def run_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """A hash of every run of ``n`` words; fewer words are one run, none give none."""
    n = min(n, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out += (words[k : k + len(out)] ^ _MIX[k % len(_MIX)] + np.uint64(k)) * _MIX[(k + 1) % len(_MIX)]
        out ^= out >> np.uint64(32)
        out *= _MIX[0]
        return out ^ (out >> np.uint64(29))


def simhashes(runs: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the ``length`` runs from each of the ascending ``starts``."""
    first, last = int(starts[0]), int(starts[-1]) + length
    bits = np.unpackbits(runs[first:last].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((last - first + 1, BITS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    at = starts - first
    ones = (sums[at + length] - sums[at]) * 2 > length
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ascending, not empty ``ordered`` ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Size(NamedTuple):
    """The items of one number of words."""

    items: list
    bags: list
    prints: np.ndarray
    runs: np.ndarray
    blocks: list


class Index:
    """Items by size, each with its block index; and the runs of all items."""

    def __init__(self, items: list[tuple], n: int = WORDS, radius: int = RADIUS) -> None:
        self.n, self.radius = n, radius
        cuts = np.linspace(0, BITS, radius + 2).astype(int).tolist()
        self.masks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        by_size: dict[int, list] = {}
        for item, data in items:
            words = word_hashes(data)
            if len(words):
                by_size.setdefault(len(words), []).append((item, run_hashes(words, n)))
        self.sizes = {}
        for size, found in by_size.items():
            prints = np.array([simhashes(r, np.array([0]), len(r))[0] for _, r in found], np.uint64)
            blocks = []
            for shift, mask in self.masks:
                values = (prints >> shift) & mask
                order = np.argsort(values, kind="stable")
                blocks.append((values[order], order))
            self.sizes[size] = Size([i for i, _ in found], [Counter(r.tolist()) for _, r in found], prints, np.unique(np.concatenate([r for _, r in found])), blocks)
        # A bit for each run's leading bits tells most runs apart from all items' at once.
        self.short = {size: s for size, s in self.sizes.items() if size < n}
        long = [s.runs for size, s in self.sizes.items() if size >= n]
        self.all_runs = np.unique(np.concatenate(long)) if long else np.empty(0, np.uint64)
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.all_runs >> self.shift).astype(np.int64)] = True

    def near(self, size: Size, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window and an item within the radius, each once."""
        pairs = []
        for (shift, mask), (values, order) in zip(self.masks, size.blocks):
            wanted = (prints >> shift) & mask
            low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            counts = high - low
            windows = np.repeat(np.arange(len(prints)), counts)
            places = np.arange(len(windows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            items = order[places]
            close = np.bitwise_count(prints[windows] ^ size.prints[items]) <= self.radius
            pairs.append(windows[close] * len(size.items) + items[close])
        both = np.unique(np.concatenate(pairs))
        return both // len(size.items), both % len(size.items)

    def matches(self, data: bytes, least: float = SIMILARITY) -> list[tuple]:
        """The best window for each item that some window is similar to: ``(item, similarity, distance, start, words)``."""
        words = word_hashes(data)
        best: dict[int, tuple] = {}
        runs = run_hashes(words, self.n) if len(words) >= self.n else np.empty(0, np.uint64)
        hits = np.flatnonzero(self.seen[(runs >> self.shift).astype(np.int64)]) if len(runs) else np.empty(0, np.int64)
        hits = hits[_among(runs[hits], self.all_runs)] if len(hits) else hits
        for number, size in (self.sizes if len(hits) else self.short).items():
            if number > len(words):
                continue
            if number < self.n:
                own, length = run_hashes(words, number), 1
                starts = np.flatnonzero(_among(own, size.runs))
            else:
                own, length = runs, number - self.n + 1
                marks = hits[_among(runs[hits], size.runs)]
                starts = np.unique(marks[:, None] - np.arange(length)).ravel()
                starts = starts[(starts >= 0) & (starts <= len(runs) - length)]
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 64) + 1):
                for at in range(0, len(part), 4096):
                    self._verify(size, number, own, part[at : at + 4096], length, least, best)
        return list(best.values())

    def _verify(self, size: Size, number: int, runs: np.ndarray, starts: np.ndarray, length: int, least: float, best: dict) -> None:
        if not len(starts):
            return
        prints = simhashes(runs, starts, length)
        for w, i in zip(*self.near(size, prints)):
            start = int(starts[w])
            value = similarity(Counter(runs[start : start + length].tolist()), size.bags[i])
            key = (number, int(i))
            if value >= least and (key not in best or value > best[key][1]):
                best[key] = (size.items[i], value, int(np.bitwise_count(prints[w] ^ size.prints[i])), start, number)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """The items in lots of at most ``most`` words (a longer item is a lot of its own), read one lot at a time."""
    lot, held = [], 0
    items = benchmark.select(column(id_col).alias("i"), column(text_col).cast("binary").alias("t")).where("t IS NOT NULL").distinct().orderBy("i", "t")
    for row in items.toLocalIterator():
        n = len(row.t.split())
        if lot and held + n > most:
            yield lot
            lot, held = [], 0
        lot.append((row.i, bytes(row.t)))
        held += n
    if lot:
        yield lot


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, distance, start, n_words)``: for each document and item the best similar window, if any.

    ``start`` is the window's first word; of equally similar windows the first one counts. Words are split at ASCII white space,
    A-Z in lower case. Items and texts that are null or without words match nothing; a document shorter than an item
    does not match it; items of fewer words than a run are one run. Rows that repeat give repeated rows, and a repeated item
    one. The benchmark goes to the executors in lots of bounded size, one pass over the documents each.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("binary").alias("data"))
    kinds = slim.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, distance int, start long, n_words int"
    out = None
    for lot in _blocks(benchmark, item_col, item_text_col, item_words):
        found = slim.mapInArrow(_scan(lot, words, radius, least), schema)
        out = found if out is None else out.unionAll(found)
    return slim.sparkSession.createDataFrame([], schema) if out is None else out


def _scan(lot: list[tuple], words: int, radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(lot, words, radius)
        names = ["doc_id", "item_id", "similarity", "distance", "start", "n_words"]
        for batch in batches:
            rows = []
            for doc, data in enumerate(batch.column(1).to_pylist()):
                rows += [(doc, *x) for x in index.matches(data or b"", least)]
            if rows:
                docs, items, values, distances, starts, sizes = zip(*rows)
                made = [batch.column(0).take(pa.array(docs)), pa.array(items), pa.array(values), pa.array(distances, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays(made, names)
        release()

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item was found. Documents with a null id stay."""
    found = leaks(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, column(id_col) == F.col("__leaked"), "left_anti")
