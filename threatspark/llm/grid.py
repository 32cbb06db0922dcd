"""A stated set of questions against all rows, in blocks: every block of one table meets every block of another in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def blocks(total: int, most: int) -> int:
    """So many blocks that each holds about ``most`` of ``total``."""
    return max(1, -(-int(total or 0) // most))


def meet(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_blocks: int, right_blocks: int, fn: Callable, schema: str) -> DataFrame:
    """``fn(left_rows, right_rows)`` over Arrow tables for each pair of blocks, as one table of ``schema``.

    Keys are dealt to blocks by hash and must be unique in their table, so that a block's size is bounded by what the caller
    counted. A row travels once for each block of the other side; no row meets the other table as a whole. Where one side of
    a pair is empty, nothing is called.
    """
    a = left.withColumn("__l", F.pmod(F.xxhash64(left_key), F.lit(left_blocks)).cast("int")).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))))
    b = right.withColumn("__r", F.pmod(F.xxhash64(right_key), F.lit(right_blocks)).cast("int")).withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
    tasks = min(4 * left_blocks * right_blocks, 20_000)

    def of_pair(some, others):
        if some.num_rows and others.num_rows:
            return fn(some, others)
        return empty

    empty = _empty(schema)
    keys = ("__l", "__r")
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(of_pair, schema)


def _empty(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()
