"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threatspark.llm.common import settle


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs on another itself."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionAll(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return bool(nodes.agg(F.max((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first()[0])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: each node that has an edge, with the smallest node it can reach.

    Large star: every neighbour above a node is hung on the smallest of the neighbourhood. Small star: the same for the
    neighbours below it. Both are a partially aggregated minimum and a join; rounds are few (the logarithm of the longest
    path), end as soon as all nodes hang on their smallest, and each round's edges are written to the shared folder. Self links and
    repeated links are harmless; a null end drops the link; no link gives an empty table.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = settle(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while _unfinished(now):
        both = now.select("hi", "lo").unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))  # one row for each edge at most
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        now = settle(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(roots)
