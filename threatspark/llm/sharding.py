"""Minimax contiguous sharding: the smallest capacity that fits ordered atomic groups into a number of shards.

Rows with equal texts are one group. Groups stand in the order of their text's hash. A capacity is tried greedily: every shard
takes groups up to the capacity. The binary search runs on a sketch of the groups' ends that has a bounded number of buckets and
gives lower and upper bounds for each greedy step. Capacities that the bounds leave open are settled by finer buckets just where
their cuts can lie, so a few aggregations give the exact capacity whatever the number of groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from threatspark.llm.common import column, settle

CELL_ROWS = 4096
#: Buckets that the driver receives at once.
BUCKETS = 1 << 15


def _bits(n: int) -> int:
    return min(24, max(0, (n // CELL_ROWS).bit_length()))


def _leading(key, bits: int):
    """The leading bits of a signed hash, in its order."""
    return (F.shiftright(key, 64 - bits) if bits else F.lit(0)).cast("int")


def group_ends(groups: DataFrame, n_groups: int) -> DataFrame:
    """``groups(g, bytes)`` with ``end``: the running sum of bytes in the order of ``g``, without a single-task sort.

    Groups fall into cells by the leading bits of their hash; sums run inside cells, and over one row per cell.
    """
    celled = groups.withColumn("cell", _leading(F.col("g"), _bits(n_groups)))
    cells = celled.groupBy("cell").agg(F.sum("bytes").alias("b"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("cell").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    ended = celled.join(cells, "cell").select("g", (F.col("base") + F.sum("bytes").over(inside)).alias("end"))
    return settle(ended.repartitionByRange("end").sortWithinPartitions("end"))


class Ends:
    """What is known of the groups' ends: buckets in ascending order with their smallest and largest end and their count.

    There are no ends between buckets. Inside one, only its smallest and largest end are known.
    """

    def __init__(self, ends: DataFrame, total: int, buckets: int = BUCKETS) -> None:
        self.ends, self.total, self.buckets = ends, total, buckets
        self.low, self.high, self.n = self._sketch([(0, total)])

    def _sketch(self, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the ends in ``runs``, each from above its first to its second number."""
        width = max(1, -(-sum(b - a for a, b in runs) // self.buckets))
        number, where, base = F.lit(None).cast("long"), F.lit(False), 0
        for a, b in runs:
            here = (F.col("end") > a) & (F.col("end") <= b)
            number = F.when(here, base + F.floor((F.col("end") - (a + 1)) / width)).otherwise(number)
            where, base = where | here, base + (b - a) // width + 1
        found = self.ends.where(where).groupBy(number.alias("b")).agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n"))
        rows = sorted((r["low"], r["high"], r["n"]) for r in found.collect())
        return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))

    def refine(self, picked: list[int]) -> None:
        """Finer buckets in place of those numbered ``picked``."""
        runs: list[tuple[int, int]] = []
        for i in picked:
            a, b = int(self.low[i]) - 1, int(self.high[i])
            if runs and picked and i - 1 in picked:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
        self.buckets = max(self.buckets, 4 * len(picked))  # so that the widest of them are split
        finer = self._sketch(runs)
        rest = np.ones(len(self.low), bool)
        rest[picked] = False
        both = [np.concatenate([x[rest], y]) for x, y in zip((self.low, self.high, self.n), finer)]
        order = np.argsort(both[0])
        self.low, self.high, self.n = (x[order] for x in both)

    def last(self, limit: int) -> tuple[int, int]:
        """Bounds of the largest end up to ``limit``; the lower one is an end, or 0."""
        i = int(np.searchsorted(self.low, limit, "right")) - 1
        if i < 0:
            return 0, 0
        if self.high[i] <= limit:
            return (int(self.high[i]),) * 2
        low = int(self.low[i])
        return low, low if self.n[i] <= 2 else min(limit, int(self.high[i]) - 1)

    def path(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """The cuts of greedy filling, bounded from below or above."""
        at, out = 0, []
        while len(out) < shards and at < self.total:
            at = max(at, self.last(at + capacity)[upper])
            out.append(at)
        return out


def minimax_cuts(ends: Ends, largest: int, shards: int) -> list[int]:
    """Ends of the shards under the smallest capacity at which greedy filling needs no more than ``shards`` of them.

    Within that capacity the cuts stay near the mean of what is left where the known ends allow it.
    """
    total = ends.total
    mean = -(-total // shards)
    good = lambda c, upper: ends.path(c, shards, upper)[-1] >= total
    while True:
        # Below ``fails`` no capacity can do, from ``works`` on each one does.
        fails = _first(max(largest, mean), largest + mean, lambda c: good(c, True))
        works = _first(fails, largest + mean, lambda c: good(c, False))
        if fails == works:
            break
        open_: set[int] = set()
        for low, high in zip([0, *ends.path(fails, shards, False)], [0, *ends.path(works, shards, True)]):
            i, j = np.searchsorted(ends.low, [low + fails, high + works], "right") - 1
            open_.update(k for k in range(max(0, int(i)), int(j) + 1) if ends.n[k] > 2)
        ends.refine(sorted(open_))
    at, even = 0, []
    for left in range(shards, 0, -1):
        if at < total:
            i = int(np.searchsorted(ends.high, at - (-(total - at) // left)))
            near = int(ends.high[min(i, len(ends.high) - 1)])
            at = near if near <= at + works else max(at, ends.last(at + works)[0])
            even.append(at)
    return even if even[-1] >= total else ends.path(works, shards, False)


def _first(low: int, high: int, good) -> int:
    """The smallest number from ``low`` to ``high`` that is good; ``high`` is, and so is all above a good one."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if good(middle) else (middle + 1, high)
    return high


def shard(docs: DataFrame, shards: int, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row, by the law ``bytes``.

    Size: UTF-8 bytes of the text and ``overhead``. A null text counts as an empty one. Equal texts share a shard, so a text
    whose copies outweigh a shard sets the capacity, and the other shards stay near the mean of the rest. Slots number a
    shard's rows from 0 without gaps; a crowd of copies is numbered in many tasks, since numbering goes by the hash of the id.
    Fewer groups than shards leave shards empty; an empty table gives no rows. Rows that repeat in full keep a slot each.
    """
    text = F.coalesce(column(text_col), F.lit(""))
    rows = settle(docs.select(column(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g")))
    groups = settle(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    n_groups, total, largest = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.max("bytes")).first()
    cut_keys: list[int] = []
    if n_groups:
        ends = group_ends(groups, n_groups)
        cuts = minimax_cuts(Ends(ends, total), largest, shards)
        # One row per shard: the last group of each.
        cut_keys = sorted(r["g"] for r in ends.where(F.col("end").isin(cuts)).select("g").collect())
    number = F.lit(0)
    for key in cut_keys[:-1]:
        number = number + (F.col("g") > F.lit(key)).cast("int")
    placed = rows.withColumn("shard", number).withColumn("cell", _leading(F.xxhash64("doc_id", "g"), _bits(rows.count() // shards)))
    cells = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell").orderBy("g", "doc_id")
    numbered = placed.join(cells, ["shard", "cell"]).withColumn("slot", F.col("base") + F.row_number().over(inside) - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
