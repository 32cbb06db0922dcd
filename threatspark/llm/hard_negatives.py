"""Hard negatives by Strassen products of integer tiles and heaps that merge.

Rows become tiles of whole numbers. Blocks of anchor tiles meet blocks of candidate tiles; each pair of tiles is multiplied by
Strassen's recursion in 64-bit integers, whose sums wrap and therefore stay exact as long as the scores themselves fit. A task
keeps a bounded heap per anchor over its tiles, and heaps of different tasks merge by rank: first the heap of positives, then,
in a second product, a heap for each positive's window of scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threatspark.llm import grid
from threatspark.llm.common import column, settle

#: Numbers in a tile, and in the tiles of one block of anchors or candidates.
TILE = 1 << 17
BLOCK = 1 << 20
#: A product with a side this short is left to plain multiplication.
LEAF = 32

TILES = "tile long, n long, dim long, keys binary, ids binary, known binary, labels binary, low binary, high binary, cells binary"
NEVER = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by seven half-sized products; odd sides get a row or column of zeros.

    Additions and products wrap at 64 bits, so the result is exact if its entries fit.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole_numbers(flat: np.ndarray, scale: float) -> np.ndarray:
    """Rounded-down multiples; a component that leaves 53 bits has no exact product and is an error."""
    found = np.floor(scale * flat.astype(np.float64))
    if len(found) and np.abs(found).max() > 2.0**53:
        raise OverflowError("a component times the scale leaves the whole numbers that a double holds")
    return found.astype(np.int64)


def tiles(rows: DataFrame, scale: float) -> DataFrame:
    """Rows (key, id, label, vector, low, high) packed into tiles of about ``TILE`` numbers.

    Inside a tile rows are ordered by id, null ids last; shorter vectors are filled up with zeros, which no product sees.
    ``low`` and ``high`` are lists of windows and may be null.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            dim = max(1, int(sizes.max()))
            cells = np.zeros((len(sizes), dim), np.int64)
            cells[np.arange(dim) < sizes[:, None]] = whole_numbers(lists.flatten().to_numpy(zero_copy_only=False), scale)
            known = np.array(batch.column("id").is_valid())
            ids = batch.column("id").fill_null(0).to_numpy()
            keys = batch.column("key").to_numpy()
            labels = batch.column("label").to_numpy()
            windows = [batch.column(c).to_pylist() for c in ("low", "high")]
            most = max((len(w) for w in windows[0] if w), default=0)
            edges = [np.array([[*(w or []), *[empty] * (most - len(w or []))] for w in ws], np.int64).reshape(len(sizes), most) for ws, empty in zip(windows, (0, -1))]
            order = np.lexsort((ids, ~known))
            step = max(1, TILE // dim)
            for at in range(0, len(order), step):
                take = order[at : at + step]
                parts = (keys[take], ids[take], known[take], labels[take], edges[0][take], edges[1][take], cells[take])
                yield pa.RecordBatch.from_pylist([{"tile": int(keys[take[0]]), "n": len(take), "dim": dim} | {name: x.tobytes() for name, x in zip(("keys", "ids", "known", "labels", "low", "high", "cells"), parts)}], _ARROW)

    return rows.mapInArrow(packed, TILES)


_ARROW = pa.schema([("tile", pa.int64()), ("n", pa.int64()), ("dim", pa.int64()), *((c, pa.binary()) for c in ("keys", "ids", "known", "labels", "low", "high", "cells"))])


class Tile:
    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        read = lambda name: np.frombuffer(row[name], np.int64)
        self.keys, self.ids, self.labels = read("keys"), read("ids"), read("labels")
        self.known = np.frombuffer(row["known"], bool)
        self.low, self.high = read("low").reshape(n, -1), read("high").reshape(n, -1)
        self.cells = read("cells").reshape(n, dim)


def scores(anchors: Tile, others: Tile) -> np.ndarray:
    """Inner products of all anchors with all rows of a tile; the shorter vectors count as filled up with zeros."""
    dim = max(anchors.cells.shape[1], others.cells.shape[1])
    a, b = (np.pad(t.cells, ((0, 0), (0, dim - t.cells.shape[1]))) if t.cells.shape[1] < dim else t.cells for t in (anchors, others))
    top = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    if 100 * dim * top[0] * top[1] >= 1 << 63:
        raise OverflowError("scores of these vectors can leave 64 bits")
    return strassen(a, b.T)


class Heaps:
    """The first ``size`` rows of each line by score, smaller ids first and null ids last among equals."""

    def __init__(self, lines: int, size: int) -> None:
        self.size = size
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * lines
        self.floor = np.full(lines, NEVER)  # what a row must reach to enter

    def push(self, line: int, value: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        value, ids, known = (np.concatenate(x) for x in zip(self.kept[line], (value, ids, known)))
        if len(value) > self.size:
            first = np.lexsort((ids, ~known, -value))[: self.size]
            value, ids, known = value[first], ids[first], known[first]
        self.kept[line] = (value, ids, known)
        if len(value) == self.size:
            self.floor[line] = value.min()

    def offer(self, lines: np.ndarray, found: np.ndarray, fits: np.ndarray, tile: Tile) -> None:
        """Rows of a tile for some lines; ``fits`` says which ones count. Of a line's rows at most ``size`` go on, ties by the tile's order."""
        fits = fits & (found >= self.floor[lines][:, None])
        for i in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[i])
            value = found[i, at]
            if len(at) > self.size:
                edge = np.partition(value, len(value) - self.size)[len(value) - self.size]
                above, equal = at[value > edge], at[value == edge]
                at = np.concatenate([above, equal[: self.size - len(above)]])
                value = found[i, at]
            self.push(lines[i], value, tile.ids[at], tile.known[at])

    def rows(self, keys: np.ndarray) -> pa.Table:
        sizes = [len(v) for v, _, _ in self.kept]
        value, ids, known = (np.concatenate(x) if self.kept else np.empty(0) for x in zip(*self.kept))
        return pa.table({"key": np.repeat(keys, sizes), "score": value.astype(np.int64), "id": pa.array(ids.astype(np.int64), mask=~known.astype(bool))})


def _positives(size: int):
    def of_blocks(some: pa.Table, others: pa.Table) -> pa.Table:
        anchors = [Tile(r) for r in some.to_pylist()]
        heaps = [Heaps(len(t.keys), size) for t in anchors]
        for row in others.select(_ARROW.names).to_batches(max_chunksize=1):
            tile = Tile(row.to_pylist()[0])
            for t, heap in zip(anchors, heaps):
                heap.offer(np.arange(len(t.keys)), scores(t, tile), t.labels[:, None] == tile.labels, tile)
        return pa.concat_tables(h.rows(t.keys) for t, h in zip(anchors, heaps))

    return of_blocks


def _window_rows(size: int):
    def of_blocks(some: pa.Table, others: pa.Table) -> pa.Table:
        anchors = [Tile(r) for r in some.to_pylist()]
        heaps = [[Heaps(len(t.keys), size) for _ in range(t.low.shape[1])] for t in anchors]
        for row in others.select(_ARROW.names).to_batches(max_chunksize=1):
            tile = Tile(row.to_pylist()[0])
            for t, lines in zip(anchors, heaps):
                found = scores(t, tile)
                other = t.labels[:, None] != tile.labels
                for p, heap in enumerate(lines):
                    heap.offer(np.arange(len(t.keys)), found, other & (found >= t.low[:, p, None]) & (found <= t.high[:, p, None]), tile)
        made = [h.rows(t.keys).append_column("place", pa.array(np.full(sum(len(v) for v, _, _ in h.kept), p + 1, np.int32))) for t, lines in zip(anchors, heaps) for p, h in enumerate(lines)]
        return pa.concat_tables(made) if made else grid._empty(_WINDOWED)

    return of_blocks


_MERGED = "key long, score long, id long"
_WINDOWED = f"{_MERGED}, place int"


def mine(
    rows: DataFrame,
    id_column: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
) -> DataFrame:
    """The first ``negatives`` rows of other labels in the score window of each anchor and positive.

    Anchors are rows whose id is divisible by ``every``. A positive is one of the first ``positives`` other rows of the anchor's
    label; its window holds the negatives of ``low`` to ``high`` hundredths of its score, so a negative score has an empty one.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score and positive_rank. All rows are compared:
    a task holds a block of anchors and a block of candidates, bounded by ``BLOCK`` numbers each, whatever the labels are.

    Rows with a null label or vector, or a null or non-finite component, take no part. A row without id is a candidate, last
    among equals, and never an anchor. Repeated rows count once each as candidates; anchors that repeat in full are one. An
    empty vector scores 0, shorter vectors are filled up with zeros. Extra columns are not read. An empty table gives none.
    Vectors whose scores cannot be held by 64 bits raise an OverflowError.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    given = rows.select(column(id_column).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).alias("vector"))
    given = given.where("label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", finite))
    no_window = F.lit(None).cast("array<long>")
    numbered = lambda d: d.withColumn("key", F.monotonically_increasing_id())
    ordered = ("key", "id", "label", "vector", "low", "high")
    packed = settle(tiles(numbered(given).withColumns({"low": no_window, "high": no_window}).select(*ordered), scale))
    anchors = settle(numbered(given.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates()))
    counted = packed.agg(F.sum(F.col("n") * F.col("dim"))).first()[0]
    groups = grid.blocks(counted, BLOCK)
    anchor_cells = anchors.agg(F.sum(F.size("vector"))).first()[0]
    anchor_groups = grid.blocks(anchor_cells, BLOCK)

    ahead = (F.desc("score"), F.asc_nulls_last("id"))
    first = tiles(anchors.withColumns({"low": no_window, "high": no_window}).select(*ordered), scale)
    heaps = grid.meet(first, packed, F.col("tile"), F.col("tile"), anchor_groups, groups, _positives(positives + 1), _MERGED)
    merged = heaps.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*ahead))).where(F.col("at") <= positives + 1)
    lists = merged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "score", "id"))).alias("best"))
    joined = anchors.join(lists, "key")
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    joined = joined.withColumn("own", F.aggregate(whole, F.lit(0).cast("long"), lambda t, x: t + x * x))
    itself = joined.select("*", F.array_position(F.transform("best", lambda b: (b["id"] == F.col("id")) & (b["score"] == F.col("own"))), F.lit(True)).alias("itself"))
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("itself")), 1, positives)
    chosen = settle(itself.select("key", F.col("id"), "label", "vector", others.alias("others")).where(F.size("others") > 0))

    lower = F.transform("others", lambda b: _ceil_hundredths(b["score"] * F.lit(low)))
    upper = F.transform("others", lambda b: _floor_hundredths(b["score"] * F.lit(high)))
    second = tiles(chosen.withColumns({"low": lower, "high": upper}).select(*ordered), scale)
    found = grid.meet(second, packed, F.col("tile"), F.col("tile"), anchor_groups, groups, _window_rows(negatives), _WINDOWED)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "place").orderBy(*ahead))).where(F.col("rank") <= negatives)
    named = chosen.select("key", F.col("id").alias("anchor_id"), F.posexplode("others").alias("p", "other"))
    named = named.select("key", "anchor_id", (F.col("p") + 1).alias("place"), "other")
    return ranked.join(named, ["key", "place"]).select(
        "anchor_id",
        F.col("other.id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("other.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
        F.col("place").alias("positive_rank"),
    )


def _floor_hundredths(x):
    """Whole hundredths, rounded down, in integers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))


def _ceil_hundredths(x):
    return -_floor_hundredths(-x)
