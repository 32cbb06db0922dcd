"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A block is a whole document; none is ever cut. Each source's documents stand in a random order; its quota is a number of draws from
that order: whole rounds, then the first documents of one more as far as they fit, and last the one document among the rest
whose size is nearest to the words still missing, if it brings the source nearer to its target. The tree halves the
output shards again and again and deals each half its part of every source's quota by a multivariate-hypergeometric draw, so
every shard gets an exact number of draws of each source. A shard's draws are the next ones of each source's order, disjoint
from all others, and are shuffled inside the shard.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatspark.llm.common import column, count_words, settle

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
SEED = 0
#: Rows that share the leading bits of the order key, on average.
CELL_ROWS = 4096
SHARD_DRAWS = 50_000
_URN = 400_000_000


def source_targets(sizes: dict, weights=WEIGHTS, share=SHARE, most: int = MOST) -> dict:
    """Words for each source: ``share`` of all words dealt by weight, no source above ``most`` times its own.

    ``sizes`` maps sources to words. Weights repeat over the sources by code point, null last. What a full source cannot take
    is dealt again to the others by weight until none is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        left = Fraction(share) * sum(sizes.values()) - most * sum(sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else Fraction(0)
        above = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in full else weight[s] * level for s in names}
        full |= above


def _draw(rng: np.random.Generator, urn: np.ndarray, n: int) -> np.ndarray:
    """A multivariate-hypergeometric draw; urns beyond the generator's range are drawn in equal units and a remainder."""
    total = int(urn.sum())
    if total < _URN:
        return rng.multivariate_hypergeometric(urn, n, method="marginals")
    unit = total // (_URN // 2) + 1
    whole, rest = urn // unit, urn % unit
    units = min(int(whole.sum()), n // unit)
    units = max(units - int(rest.sum()) // (2 * unit), -(-(n - int(rest.sum())) // unit), 0)
    return _draw(rng, whole, units) * unit + _draw(rng, rest, n - units * unit)


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws by shard and source; each source's column sums to its quota, and shards' sums differ by one at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def part(first: int, last: int, urn: np.ndarray) -> None:
        if last - first == 1:
            out[first] = urn
            return
        middle, total = (first + last) // 2, int(urn.sum())
        ends = [total * (k - first) // (last - first) for k in (first, middle)]
        taken = _draw(rng, urn, ends[1] - ends[0])
        part(first, middle, taken)
        part(middle, last, urn - taken)

    part(0, shards, np.array(quotas, np.int64))
    return out


def _order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A hash of id and text: rows of one id, or without one, spread by their texts."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(text), F.lit(""))))


def plan(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share=SHARE, most: int = MOST, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with a struct ``mix(size, source_size, target, draws)``; a draw is ``(round, shard, words)``.

    ``size`` is the words of the text unless given (null: 0). A null source is a source of its own. Rows of equal id stand in the order
    of a hash of their texts; rows that repeat in full are separate documents. Without words all targets are zero and nothing
    is drawn. A column named ``mix`` is replaced; columns that begin with two underscores are not allowed. The driver holds one
    row per source and one number per source and shard.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix")
    size = count_words(column(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    text = column(text_col) if text_col in docs.columns else F.lit(None).cast("string")
    bits = min(24, max(0, (docs.count() // CELL_ROWS).bit_length()))
    key = _order_key(column(id_col), text, seed)
    cell = F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), 32 - bits).cast("int")
    rows = docs.withColumns({"__key": key, "__size": size, "__source": column(source_col)}).withColumn("__cell", cell)
    slim = settle(rows.select("__source", "__cell", "__key", "__size"))

    cells = settle(slim.groupBy("__source", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words")))
    totals = cells.groupBy("__source").agg(F.sum("__n").alias("n"), F.sum("__words").alias("words")).collect()
    names = [r["__source"] for r in totals]
    n = {r["__source"]: r["n"] for r in totals}
    words = {r["__source"]: r["words"] for r in totals}
    target = source_targets(words, weights, share, most)
    quota = {s: int(target[s] + Fraction(1, 2)) for s in names}
    rounds = {s: quota[s] // words[s] if words[s] else 0 for s in names}
    rest = {s: quota[s] - rounds[s] * words[s] for s in names}

    before = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = settle(cells.withColumns({"__rank0": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__word0": F.coalesce(F.sum("__words").over(before), F.lit(0))}))
    inside = Window.partitionBy("__source", "__cell").orderBy("__key", "__size")
    kind = docs.schema[source_col].dataType.simpleString()
    known = spark.createDataFrame([(s, rest[s], rounds[s]) for s in names], f"__s {kind}, __rest long, __rounds long")
    same = lambda a: a["__source"].eqNullSafe(F.col("__s"))

    # The last, partial round takes documents from the front as long as they fit: whole cells, and rows of the one cell where it ends.
    facts = cells.join(F.broadcast(known), same(cells)).drop("__s")
    whole = facts.where("__word0 + __words <= __rest AND __rest > 0").groupBy("__source").agg(F.sum("__n").alias("k"), F.max(F.col("__word0") + F.col("__words")).alias("w"))
    later = facts.where("__word0 + __words > __rest AND __rest > 0").select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), "__word0", "__rank0", "__rest")
    open_rows = slim.join(later, same(slim) & (F.col("__cell") == F.col("__c")))
    ends_at = F.col("__word0") + F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    open_rows = settle(open_rows.select("__source", "__size", "__rest", (F.col("__rank0") + F.row_number().over(inside) - 1).alias("__rank"), ends_at.alias("__end")))
    fit = open_rows.where("__end <= __rest").groupBy("__source").agg(F.count(F.lit(1)).alias("k"), F.max("__end").alias("w"))
    count, filled = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in whole.unionAll(fit).collect():
        count[r["__source"]] += r["k"]
        filled[r["__source"]] = max(filled[r["__source"]], r["w"])
    # What is then missing is met by the document whose size comes nearest to it, if that is nearer than none.
    gaps = spark.createDataFrame([(s, rest[s] - filled[s]) for s in names], f"__s {kind}, __gap long")
    choice = open_rows.where("__end > __rest").join(F.broadcast(gaps), same(open_rows))
    nearest = choice.groupBy("__source").agg(F.min(F.struct(F.abs(F.col("__size") - F.col("__gap")).alias("off"), "__rank", "__gap")).alias("best"))
    extra = {r["__source"]: r["best"]["__rank"] for r in nearest.collect() if r["best"]["off"] < r["best"]["__gap"]}

    quotas = [rounds[s] * n[s] + count[s] + (s in extra) for s in names]
    shards = shards or max(1, -(-sum(quotas) // SHARD_DRAWS))
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0)
    last = {s: int(np.searchsorted(ends[:-1, i], quotas[i] - 1, "right")) for i, s in enumerate(names)}
    dealt = spark.createDataFrame(
        [(s, words[s], float(target[s]), n[s], count[s], rounds[s], extra.get(s), last[s]) for s in names],
        f"__s {kind}, __source_size long, __target double, __source_n long, __count long, __rounds long, __extra long, __last int",
    )
    # A shard end lies in one cell of one round: ends and cells meet by the cell in which the end's place falls.
    marks = spark.createDataFrame([(s, k, int(e)) for i, s in enumerate(names) for k, e in enumerate(ends[:-1, i])], f"__s {kind}, __shard int, __end long")
    placed = _deals(cells.join(F.broadcast(dealt), same(cells)).drop("__s"), marks)
    placed = placed.select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), "__rank0", "__source_size", "__target", "__source_n", "__count", "__rounds", "__extra", "__last", "__deals")
    kept = [column(c) for c in docs.columns]
    wide = rows.join(placed, same(rows) & (F.col("__cell") == F.col("__c")))
    wide = wide.withColumn("__rank", F.col("__rank0") + F.row_number().over(inside) - 1)
    chosen = F.coalesce(F.col("__rank") == F.col("__extra"), F.lit(False))
    shard = lambda d: d["shard"] + F.size(F.filter(d["ends"], lambda x: x <= d["round"] * F.col("__source_n") + F.col("__rank")))
    draw = lambda d: F.struct(d["round"].cast("int").alias("round"), F.when((d["round"] == F.col("__rounds")) & chosen, F.col("__last")).otherwise(shard(d)).alias("shard"), F.col("__size").alias("words"))
    taken = F.filter("__deals", lambda d: (d["round"] < F.col("__rounds")) | (F.col("__rank") < F.col("__count")) | chosen)
    mix = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.transform(taken, draw).alias("draws"))
    return wide.select(*kept, mix.alias("mix"))


def _deals(cells: DataFrame, marks: DataFrame) -> DataFrame:
    """Cells with ``__deals``: for each round the shard in which the cell begins, and the places in it at which further shards begin.

    Cells and shard ends are put in one order of places and numbered by running counts, so neither looks at all of the other.
    """
    spread = cells.select("__source", "__cell", "__n", "__rank0", "__source_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rounds"))).alias("__round"))
    start = F.col("__round") * F.col("__source_n") + F.col("__rank0")
    one = spread.select("__source", start.alias("__at"), F.lit(1).alias("__kind"), "__cell", "__round")
    two = marks.select(F.col("__s").alias("__source"), F.col("__end").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("int").alias("__cell"), F.lit(None).cast("long").alias("__round"))
    line = Window.partitionBy("__source").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumns({"__before": F.sum(1 - F.col("__kind")).over(line), "__where": F.last(F.when(F.col("__kind") == 1, F.struct("__cell", "__round")), ignorenulls=True).over(line)})
    begins = both.where("__kind = 1").select("__source", "__cell", "__round", F.col("__before").cast("int").alias("__first"))
    within = both.where("__kind = 0 AND __where IS NOT NULL").groupBy("__source", F.col("__where.__cell").alias("__cell"), F.col("__where.__round").alias("__round")).agg(F.array_sort(F.collect_list("__at")).alias("__ends"))
    named = within.select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), F.col("__round").alias("__r"), "__ends")
    met = begins.join(named, begins["__source"].eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c")) & (F.col("__round") == F.col("__r")), "left")
    deal = F.struct(F.col("__round").alias("round"), F.col("__first").alias("shard"), F.coalesce("__ends", F.array().cast("array<bigint>")).alias("ends"))
    deals = met.groupBy("__source", "__cell").agg(F.array_sort(F.collect_list(deal)).alias("__deals"))
    deals = deals.select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), "__deals")
    return cells.join(deals, cells["__source"].eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c"))).drop("__s", "__c")


def mix(docs: DataFrame, text_col: str = "text", seed: int = SEED, **options) -> DataFrame:
    """The mixed corpus: one row per draw with all columns of ``docs``, and its ``shard``; files are shards in shuffled order.

    Documents are whole. A column named ``shard`` is replaced.
    """
    planned = plan(docs.drop("shard"), text_col=text_col, seed=seed, **options)
    drawn = planned.withColumn("__draw", F.explode("mix.draws"))
    shown = [column(c) for c in planned.columns if c != "mix"]
    local = F.xxhash64(F.lit(seed), F.col("__draw.round"), column(options.get("id_col", "doc_id")), column(text_col))
    out = drawn.select(*shown, F.col("__draw.shard").alias("shard"), local.alias("__local"))
    return out.repartition("shard").sortWithinPartitions("shard", "__local").drop("__local")
