"""Chat formatting as a prefix tree: shared opening turns are written once, depth first.

A node is a turn after one particular history. Offsets in the common stream are running sums over the nodes depth first. A node
carries the position of its first unit in its own conversation
and the intervals of the stream that it attends to, which are its ancestors' places. Units are code points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatspark.llm.common import column, settle

#: Opening and closing of each role's turns; any other role is written into its turn.
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", "\n", " [/ROLE]")
LOSS_ROLE = "assistant"
_AHEAD = r"(?=/?s>|/?INST\]|</?SYS>>|/?ROLE\])"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE\] .*?\n.*? \[/ROLE\]"


class Tree(NamedTuple):
    """``nodes`` (node, depth, stream_from, units, position, content, loss_from, loss_units, attends) and ``conversations``
    (conv_id, n_turns, nodes): the stream is the nodes' contents in the order of ``stream_from``."""

    nodes: DataFrame
    conversations: DataFrame


def escape(text: Column) -> Column:
    """A backslash after the first character of every control string, behind those that stand there already."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _AHEAD, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _AHEAD, "$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def _turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), _role_out(role), F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for name, (left, right) in FRAMES.items():
        out = F.when(role == name, F.concat(F.lit(left), escape(text), F.lit(right))).otherwise(out)
    return out


def build(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    """The prefix tree of ``conversations``, one row per turn, written to the shared folder.

    Null texts and roles count as empty ones. Rows of a conversation stand in the order of turn (null first), role and text, so
    ties and repeated rows are separate turns in a fixed order. Rows with a null conversation id are one conversation. No rows
    give an empty tree; other columns are not looked at. Work and output grow with the number of turns, in long conversations
    as well; a conversation is ordered in one task, by running sums.

    A history is known by the exclusive or of its turns' 128-bit digests, each taken with its place. Conversations sorted by
    their lists of nodes have shared beginnings side by side: each node belongs to the first one that has it, and this order is
    the tree depth first.
    """
    empty = F.lit("")
    rows = conversations.select(column(id_col).alias("conv_id"), column(turn_col).alias("turn"), F.coalesce(column(role_col), empty).alias("role"), F.coalesce(column(text_col), empty).alias("text"))
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    until = in_turn.rowsBetween(Window.unboundedPreceding, 0)
    turns = rows.withColumn("depth", F.row_number().over(in_turn)).withColumn("content", _turn(F.col("role"), F.col("text")))
    turns = turns.withColumns({"units": F.length("content").cast("long"), "d1": F.xxhash64("depth", "role", "text"), "d2": F.xxhash64("text", F.lit(1), "role", "depth")})
    running = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    node = F.concat(F.lpad(F.hex(F.bit_xor("d1").over(running)), 16, "0"), F.lpad(F.hex(F.bit_xor("d2").over(running)), 16, "0"))
    scored = F.col("role") == LOSS_ROLE
    left, right = map(len, FRAMES[LOSS_ROLE])
    turns = turns.select(
        "conv_id", "depth", "units", "content",
        node.alias("node"),
        (F.sum("units").over(running) - F.col("units")).alias("position"),
        F.when(scored, left).alias("loss_from"),
        F.when(scored, F.col("units") - left - right).alias("loss_units"),
    )
    turns = settle(turns)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    listed = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("nodes"))
    listed = listed.repartitionByRange(parts, "nodes").sortWithinPartitions("nodes")
    # Ascending in the order of the rows: the partition's number, then the row's.
    ranked = settle(listed.withColumn("rank", F.monotonically_increasing_id()))
    steps = ranked.select("rank", F.posexplode("nodes").alias("at", "node"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("rank"))
    ranks = ranked.select("conv_id", "rank")
    placed_turns = turns.join(ranks, turns["conv_id"].eqNullSafe(ranks["conv_id"])).drop(ranks["conv_id"])
    owned = placed_turns.join(owners, ["node", "rank"])

    dealt = settle(owned.drop("conv_id").repartitionByRange(parts, "rank").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("units").alias("n"))
    bases = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(bases), "part").withColumn("stream_from", F.col("base") + F.sum("units").over(inside) - F.col("units"))
    placed = settle(placed.drop("part", "base"))

    # Along each conversation ancestors that follow each other in the stream are one interval; a node keeps those before it.
    along = steps.join(placed.select("node", F.col("rank").alias("owner"), "stream_from", "units"), "node")
    way = Window.partitionBy("rank").orderBy("at")
    before = way.rowsBetween(Window.unboundedPreceding, -1)
    along = along.withColumn("last", F.lag(F.col("stream_from") + F.col("units")).over(way))
    along = along.withColumn("jump", F.when(F.col("last").isNull() | (F.col("last") != F.col("stream_from")), F.struct("stream_from", "last")))
    along = along.withColumn("jumps", F.collect_list("jump").over(before)).where("rank = owner")
    attends = F.transform("jumps", lambda x, k: F.struct(x["stream_from"].alias("start"), F.coalesce(F.get("jumps", k + 1)["last"], F.col("last")).alias("until")))
    parent = along.select("node", attends.alias("attends"))
    nodes = settle(placed.drop("rank").join(parent, "node"))
    return Tree(nodes, ranked.select("conv_id", F.size("nodes").cast("long").alias("n_turns"), "nodes"))


def read_back(tree: Tree) -> DataFrame:
    """Every conversation from the tree: ``(conv_id, formatted, losses, turns)``.

    ``formatted`` is its nodes' content from the root down, ``losses`` the pieces of it under the loss mask as written, and
    ``turns`` the roles and texts parsed from ``formatted``.
    """
    steps = tree.conversations.select("conv_id", F.posexplode("nodes").alias("at", "node"))
    piece = F.when(F.col("loss_from").isNotNull(), F.substring(F.col("content"), F.col("loss_from") + 1, F.col("loss_units").cast("int")))
    shown = tree.nodes.select("node", "content", piece.alias("piece"))
    told = steps.join(shown, "node").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "content", "piece"))).alias("steps"))
    told = told.select("conv_id", F.array_join("steps.content", "").alias("formatted"), F.filter("steps.piece", lambda x: x.isNotNull()).alias("losses"))
    return told.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)), parse))


def parse(turn: Column) -> Column:
    """Role and text of one formatted turn."""
    body = F.substring(turn, F.lit(len(OTHER[0]) + 1), F.length(turn) - len(OTHER[0]) - len(OTHER[2]))
    role = F.substring_index(body, OTHER[1], 1)
    out = F.struct(_role_in(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))
    for name, (left, right) in FRAMES.items():
        text = unescape(F.substring(turn, F.lit(len(left) + 1), F.length(turn) - len(left) - len(right)))
        out = F.when(F.startswith(turn, F.lit(left)), F.struct(F.lit(name).alias("role"), text.alias("text"))).otherwise(out)
    return out
