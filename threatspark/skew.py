"""Ordered and grouped computations that survive a key holding a third of the table.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. The helpers here
first ask whether any key is *hot* (more rows than ``rows_per_chunk``). If none is, they build the
plain window and nothing else. If some are, only those keys are cut into contiguous chunks of the
sort order, the window runs per (key, chunk), and what must flow from one chunk to the next (a running
sum, the previous row) is carried by a small table with one row per chunk.

Everything that is collected or broadcast here has one row per chunk or per chunk boundary, and
the number of chunks is bounded by ``MAX_CHUNKS`` whatever the data looks like.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_CHUNK = 4_000_000
MAX_CHUNKS = 20_000
CHUNK = "_chunk"
_SAMPLES_PER_CHUNK = 16
_HASH_SPACE = 1 << 40


def rows_per_chunk(df: DataFrame, override: int | None = None) -> int:
    """Chunk size: the argument, else ``spark.threatspark.rowsPerChunk``, else the default."""
    if override is not None:
        return override
    return int(df.sparkSession.conf.get("spark.threatspark.rowsPerChunk", str(ROWS_PER_CHUNK)))


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of a result that is read twice."""
    return _cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder of a result that many passes read, a few columns each."""
    from threatspark.session import ensure_checkpoint_dir

    place = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@dataclass(frozen=True)
class Chunked:
    """A table whose hot keys are cut into chunks; ``_chunk`` is -1 on all other keys."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    hot: bool

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.hot else list(self.keys)

    def window(self, *extra_keys: str):
        spec = Window.partitionBy(*self.group, *extra_keys) if (self.group or extra_keys) else Window.partitionBy()
        return spec.orderBy(*self.order)

    def hot_rows(self) -> DataFrame:
        return self.df.where(F.col(CHUNK) >= 0)

    def replace(self, df: DataFrame) -> "Chunked":
        return Chunked(df, self.keys, self.order, self.hot)

    def done(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.hot else self.df


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def attach(df: DataFrame, small: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join a chunk-bounded table on null-safe keys and drop its key copies."""
    right = small.select(
        *[F.col(n).alias(f"_r_{n}") for n in names],
        *[c for c in small.columns if c not in names],
    )
    cond = None
    for n in names:
        part = df[n].eqNullSafe(right[f"_r_{n}"])
        cond = part if cond is None else cond & part
    return df.join(F.broadcast(right), cond, "left").drop(*[f"_r_{n}" for n in names])


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    chunk_rows: int | None = None,
    settle: bool = False,
) -> Chunked:
    """Cut the hot keys of ``df`` along ``order`` (which should be unique within a key).

    With ``keys`` empty the whole table is one group. Hot keys are found by counting rows, which reads the key
    columns once more; ``settle`` says that ``df`` is the result of costly steps, so it is checkpointed first and
    those steps run only once. If ties leave no split point, the result is hot all the same, in one chunk.
    """
    keys, order = tuple(keys), tuple(order)
    plain = Chunked(df, keys, order, False)
    limit = rows_per_chunk(df, chunk_rows)
    if settle:
        df = _cut_lineage(df)
        plain = Chunked(df, keys, order, False)

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or largest <= limit:
        return plain
    limit = max(limit, -(-total // MAX_CHUNKS))
    if largest <= limit:
        return plain

    # Sampled split points. They decide only the balance of the chunks, never the result.
    share = max(1, min(_HASH_SPACE, _HASH_SPACE * _SAMPLES_PER_CHUNK // limit))
    hot_keys = counts.where(F.col("_n") > limit).drop("_n")
    rows = df.select(*keys, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"))
    if keys:
        rows = rows.join(
            F.broadcast(hot_keys.select(*[F.col(k).alias(f"_r_{k}") for k in keys])),
            _eq(rows, keys),
            "left_semi",
        )
    sampled = rows.where(F.pmod(F.xxhash64("_o"), F.lit(_HASH_SPACE)) < share)
    step = _SAMPLES_PER_CHUNK // 2
    bounds = (
        sampled.groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_o")).alias("_s"))
        .select(
            *keys,
            F.filter("_s", lambda _, i: (i % step) == step - 1).alias("_bounds"),
        )
        .where(F.size("_bounds") > 0)
    )
    schema = bounds.schema
    local = bounds.collect()  # at most 2 * MAX_CHUNKS split points in all
    if not local:
        return Chunked(df.withColumn(CHUNK, F.lit(-1)), keys, order, True)
    table = df.sparkSession.createDataFrame(local, schema)
    longest = max(len(r["_bounds"]) for r in local)
    if keys:
        out = attach(df, table, keys)
    else:
        out = df.withColumn("_bounds", table.scalar())
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    out = out.withColumn(CHUNK, _position(F.col("_bounds"), here, longest)).drop("_bounds")
    return Chunked(out, keys, order, True)


def _eq(rows: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = part if cond is None else cond & part
    return cond


def _position(bounds: Column, here: Column, longest: int) -> Column:
    """Number of split points at or before this row, by binary descent; -1 without split points."""
    steps = [1 << b for b in reversed(range(max(1, longest.bit_length())))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(bounds, pos + step - 1) <= here, pos + step).otherwise(pos),
    )
    return F.when(bounds.isNull(), F.lit(-1)).otherwise(found)


def with_previous(ch: Chunked, columns: Sequence[str], prefix: str = "prev_") -> Chunked:
    """Add the previous row's ``columns`` within the key (null on the first row)."""
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    df = ch.df.withColumn("_prev", F.lag(row).over(ch.window()))
    if ch.hot:
        position = F.struct(*[F.col(c) for c in ch.order])
        last = ch.hot_rows().groupBy(*ch.group).agg(F.max_by(row, position).alias("_last"))
        by_chunk = Window.partitionBy(*ch.keys).orderBy(CHUNK)
        carry = last.withColumn("_carry", F.lag("_last").over(by_chunk)).drop("_last")
        df = attach(df, carry, ch.group).withColumn("_prev", F.coalesce("_prev", "_carry")).drop("_carry")
    out = df.select(
        *[c for c in ch.df.columns],
        *[F.col("_prev")[c].alias(f"{prefix}{c}") for c in columns],
    )
    return ch.replace(out)


def with_running(
    ch: Chunked,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> Chunked:
    """Add running sums and maxima over the key's order, the current row included.

    The sums are exact for integers whatever the chunking.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    spec = ch.window().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    base = ch.df
    out = base.select(
        "*",
        *[F.sum(e).over(spec).alias(n) for n, e in sums.items()],
        *[F.max(e).over(spec).alias(n) for n, e in maxima.items()],
    )
    if ch.hot:
        parts = (
            ch.hot_rows()
            .groupBy(*ch.group)
            .agg(
                *[F.sum(e).alias(f"_c_{n}") for n, e in sums.items()],
                *[F.max(e).alias(f"_c_{n}") for n, e in maxima.items()],
            )
        )
        before = Window.partitionBy(*ch.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = parts.select(
            *ch.group,
            *[F.sum(f"_c_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_c_{n}").over(before).alias(f"_c_{n}") for n in maxima],
        )
        out = attach(out, carry, ch.group)
        zero = F.lit(0)
        fixed = {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_c_{n}"), zero) for n in sums}
        fixed |= {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxima}
        out = out.withColumns(fixed).drop(*[f"_c_{n}" for n in fixed])
    elif sums and not inclusive:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})
    return ch.replace(out)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", *, chunk_rows: int | None = None
) -> DataFrame:
    """``row_number`` over (keys, order), also when one key is hot."""
    ch = chunked(df, keys, order, chunk_rows=chunk_rows)
    if not ch.hot:
        return df.withColumn(name, F.row_number().over(ch.window()).cast("long"))
    return with_running(ch, sums={name: F.lit(1).cast("long")}).done()


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    seq: Sequence[str],
    width_us: int,
    values: Mapping[str, Column],
    *,
    left_closed: bool = True,
    peers: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Sums over the trailing time window ``[t - width, t]`` (or ``(t - width, t]``) of each row.

    ``peers=False`` counts rows in arrival order ``(time, seq)``; ``peers=True`` also counts later rows
    of the same instant. For hot keys every row also leaves an expiry event, so that a window
    sum becomes a running sum and can be carried across chunks.
    """
    keys = list(keys)
    names = list(values)
    probe = chunked(df, keys, [time_us, *seq], chunk_rows=chunk_rows)
    if not probe.hot:
        low = -width_us if left_closed else -width_us + 1
        frame = Window.partitionBy(*keys).orderBy(time_us).rangeBetween(low, 0)
        out, minus = df, {}
        if not peers:
            # Computed first: its sort order also serves the range frame.
            later = Window.partitionBy(*keys, time_us).orderBy(*seq).rowsBetween(1, Window.unboundedFollowing)
            minus = {n: f"_l_{n}" for n in names}
            out = df.select("*", *[F.sum(values[n]).over(later).alias(m) for n, m in minus.items()])
        out = out.select("*", *[F.sum(e).over(frame).alias(n) for n, e in values.items()])
        fixed = {n: F.col(n) - F.coalesce(F.col(m), F.lit(0)) for n, m in minus.items()}
        return out.withColumns(fixed).drop(*minus.values()) if fixed else out

    data = df.withColumns({f"_v_{n}": e for n, e in values.items()}).withColumn("_kind", F.lit(1))
    leave = data.groupBy(*keys, time_us).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
    leave = leave.withColumn(time_us, F.col(time_us) + F.lit(width_us)).withColumns(
        {f"_v_{n}": -F.col(f"_v_{n}") for n in names} | {"_kind": F.lit(2 if left_closed else 0)}
    )
    events = data.unionByName(leave, allowMissingColumns=True)
    ch = chunked(events, keys, [time_us, "_kind", *seq], chunk_rows=chunk_rows)
    out = with_running(ch, sums={n: F.col(f"_v_{n}") for n in names}).done()
    out = out.where(F.col("_kind") == 1)
    if peers:
        rank = [f"_m_{n}" for n in names]
        last = out.groupBy(*keys, time_us).agg(
            F.max_by(F.struct(*names), F.struct(*seq)).alias("_peer")
        )
        last = last.select(*keys, time_us, *[F.col("_peer")[n].alias(r) for n, r in zip(names, rank)])
        out = out.join(last, [*keys, time_us], "left")
        out = out.withColumns({n: F.coalesce(F.col(r), F.col(n)) for n, r in zip(names, rank)}).drop(*rank)
    return out.select(*df.columns, *names)


def wide_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    *,
    band_rows: int = 20_000,
    accuracy: int = 10_000,
    most_groups: int = 1_000,
    group_rows: int = 1_000_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles of many columns at once: ``by``, ``column``, ``prob``, ``q``.

    Nothing is unpivoted: every pass is one aggregation over the rows as they are. The first counts. Groups of at most
    ``group_rows`` rows then take the built-in exact ``percentile`` of all columns in one pass. For larger ones a sketch per column
    encloses all wanted ranks, the rows below each band are counted, and what lies strictly inside a band is gathered once it
    is at most ``band_rows`` rows, else the band is narrowed again. A value that holds more rows than that becomes an edge of
    its band and is only counted. Nulls and NaN do not count; a column without numbers has null quantiles. ``df`` is read
    several times, so give a settled table. Beyond ``most_groups`` groups the columns are unpivoted and treated one by one.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    value = {c: F.nanvl(F.col(f"`{c.replace('`', '``')}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    wide = df.select(*[F.col(f"`{k}`") for k in by], *[value[c].alias(f"_x{i}") for i, c in enumerate(columns)])
    xs = range(len(columns))
    counted = wide.groupBy(*by).agg(*[f(f"_x{i}").alias(f"{name}{i}") for i in xs for name, f in (("_n", F.count), ("_lo", F.min), ("_hi", F.max))])
    groups = counted.limit(most_groups + 1).collect()
    if len(groups) > most_groups:
        items = [F.struct(F.lit(c).alias("column"), F.col(f"_x{i}").alias("value")) for i, c in enumerate(columns)]
        return exact_quantiles(wide.select(*by, F.inline(F.array(*items))), [*by, "column"], "value", probs)

    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    schema = ", ".join([*kinds, "column string, prob double, q double"])
    if all(r[f"_n{i}"] <= group_rows for r in groups for i in xs):
        asked = F.array(*[F.lit(p) for p in probs])
        exact = wide.groupBy(*by).agg(*[F.percentile(f"_x{i}", asked).alias(f"_p{i}") for i in xs]).collect()
        rows = [(*(r[k] for k in by), c, p, r[f"_p{i}"][j] if r[f"_p{i}"] else None) for r in exact for i, c in enumerate(columns) for j, p in enumerate(probs)]
        return df.sparkSession.createDataFrame(rows, schema)

    # One band for each group, column and pair of neighbouring ranks; the driver holds these few numbers.
    keys, bands = [tuple(r[k] for k in by) for r in groups], {}
    for g, r in zip(keys, groups):
        for i in xs:
            if r[f"_n{i}"]:
                for p in probs:
                    at = p * (r[f"_n{i}"] - 1)
                    for k in {math.floor(at), math.ceil(at)}:
                        bands[g, i, k] = dict(lo=r[f"_lo{i}"], hi=r[f"_hi{i}"], below=0, rows=r[f"_n{i}"])
    found: dict = {}
    while bands:
        found |= {b: x["lo"] for b, x in bands.items() if x["lo"] == x["hi"]}
        bands = {b: x for b, x in bands.items() if b not in found}
        if bands:
            _narrow(wide, by, keys, bands, found, band_rows, accuracy)
    rows = []
    for g, r in zip(keys, groups):
        for i, c in enumerate(columns):
            n = r[f"_n{i}"]
            for p in probs:
                at = p * (n - 1)
                lower, upper = (found[g, i, f(at)] for f in (math.floor, math.ceil)) if n else (None, None)
                f = at - math.floor(at)
                q = None if not n else lower if f == 0 else (1 - f) * lower + f * upper
                rows.append((*g, c, p, q))
    return df.sparkSession.createDataFrame(rows, schema)


def _narrow(wide: DataFrame, by: list[str], keys: list[tuple], bands: dict, found: dict, band_rows: int, accuracy: int) -> None:
    """One round for all bands: sketch, then count and gather. Moves what is settled from ``bands`` to ``found``."""
    # Ranks of a group and column share a band, so each pair of edges is looked at once.
    spans: dict = {}
    for (g, i, k), x in bands.items():
        spans.setdefault((g, i), {}).setdefault((x["lo"], x["hi"]), []).append(k)
    slots = {gi: sorted(s) for gi, s in spans.items()}
    most = {i: max((len(s) for (_, j), s in slots.items() if j == i), default=0) for i in {i for _, i in slots}}
    edges = ", ".join(["_g int", *(f"_e{i} array<struct<lo:double,hi:double>>" for i in most)])
    spark = wide.sparkSession

    def attach(table: dict, kind: str) -> DataFrame:
        if not by:
            pair = lambda lo, hi: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            return wide.withColumns({"_g": F.lit(0)} | {f"_e{i}": F.array(*[pair(*e) for e in table[(), i]]) for i in most})
        numbered = spark.createDataFrame([(at, *(table.get((g, i), []) for i in most)) for at, g in enumerate(keys)], kind)
        named = spark.createDataFrame([(at, *g) for at, g in enumerate(keys)], ", ".join(["_g int", *(f"`_by{n}` {wide.schema[k].dataType.simpleString()}" for n, k in enumerate(by))]))
        facts = named.join(numbered, "_g")
        same = [wide[k].eqNullSafe(facts[f"_by{n}"]) for n, k in enumerate(by)]
        return wide.join(F.broadcast(facts), same)  # one row for each group, of which there are most_groups at most

    sketched = attach(slots, edges)
    sketches = []
    for i, n in most.items():
        for j in range(n):
            e = F.get(f"_e{i}", j)
            x = F.when((F.col(f"_x{i}") >= e["lo"]) & (F.col(f"_x{i}") <= e["hi"]), F.col(f"_x{i}"))
            sketches.append(F.percentile_approx(x, F.array(*[F.lit(q / 1000) for q in range(1001)]), F.lit(accuracy)).alias(f"s{i}_{j}"))
    grid = {r["_g"]: r for r in sketched.groupBy("_g").agg(*sketches).collect()}
    tight: dict = {}
    for at, g in enumerate(keys):
        for i in most:
            for j, (lo, hi) in enumerate(slots.get((g, i), ())):
                points = grid[at][f"s{i}_{j}"]
                for k in spans[g, i][lo, hi]:
                    x = bands[g, i, k]
                    a = math.floor(((k - x["below"]) / x["rows"] - 3 / accuracy) * 1000)
                    b = math.ceil(((k + 1 - x["below"]) / x["rows"] + 3 / accuracy) * 1000)
                    tight[g, i, k] = (lo if a <= 0 else points[a], hi if b >= 1000 else points[b])
    pairs = {(g, i): sorted({t for (h, j, _), t in tight.items() if (h, j) == (g, i)}) for g, i in slots}
    most = {i: max((len(s) for (_, j), s in pairs.items() if j == i), default=0) for i in most}
    small = max((x["rows"] for x in bands.values()), default=0) / 1000 * 4 <= band_rows
    measured = attach(pairs, edges)
    # Counting stays in generated code; values are gathered from the few rows that lie strictly inside some band.
    counters, gathered, any_inside = [], [], F.lit(False)
    for i, n in most.items():
        x = F.col(f"_x{i}")
        for j in range(n):
            e = F.get(f"_e{i}", j)
            inside = (x > e["lo"]) & (x < e["hi"])
            counters += [F.count_if(x < e["lo"]).alias(f"l{i}_{j}"), F.count_if(x == e["lo"]).alias(f"a{i}_{j}"), F.count_if(inside).alias(f"m{i}_{j}"), F.count_if((x == e["hi"]) & (e["hi"] > e["lo"])).alias(f"b{i}_{j}")]
            gathered.append(F.array_sort(F.collect_list(F.when(inside, x))).alias(f"v{i}_{j}"))
            any_inside = any_inside | F.coalesce(inside, F.lit(False))
    counts = {r["_g"]: r for r in measured.groupBy("_g").agg(*counters).collect()}
    values = {r["_g"]: r for r in measured.where(any_inside).groupBy("_g").agg(*gathered).collect()} if small else {}
    place = {g: at for at, g in enumerate(keys)}
    for (g, i, k), (lo, hi) in tight.items():
        r, j, old = counts[place[g]], pairs[g, i].index((lo, hi)), bands[g, i, k]
        less, first, inner, last = (r[f"{c}{i}_{j}"] for c in "lamb")
        if less <= k < less + first:
            found[g, i, k] = lo
        elif less + first + inner <= k < less + first + inner + last:
            found[g, i, k] = hi
        elif less + first <= k < less + first + inner and small:
            found[g, i, k] = values[place[g]][f"v{i}_{j}"][k - less - first]
        elif less <= k < less + first + inner + last and first + inner + last < old["rows"]:
            bands[g, i, k] = dict(lo=lo, hi=hi, below=less, rows=first + inner + last)
            continue
        else:  # the sketch missed the rank, or cannot tighten the band: count values
            found[g, i, k] = _ranked(wide, by, g, i, old["lo"], old["hi"], k - old["below"])
        del bands[g, i, k]


def _ranked(wide: DataFrame, by: list[str], group: tuple, i: int, lo: float, hi: float, rank: int) -> float:
    """The value of a rank inside a band, by halving the band; for the rare case that a sketch is of no use."""
    rows = wide
    for k, v in zip(by, group):
        rows = rows.where(F.col(f"`{k}`").eqNullSafe(F.lit(v)))
    x = F.col(f"_x{i}")
    inside = rows.where(x.between(lo, hi))
    while lo < hi:
        middle = lo + (hi - lo) / 2
        upto, top, bottom = inside.agg(F.count_if(x.between(lo, middle)), F.max(F.when(x.between(lo, middle), x)), F.min(F.when((x > middle) & (x <= hi), x))).first()
        if rank < upto:
            hi = top
        else:
            lo, rank = bottom, rank - upto
    return lo


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    group_rows: int | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Linear-interpolated quantiles per key: columns ``keys``, ``prob``, ``q``.

    Groups of at most ``group_rows`` rows use the built-in exact ``percentile``. Larger groups are first
    narrowed: two sketch quantiles enclose each wanted rank, the rows below are only counted, and the
    band between is narrowed again until it is small or holds a single value. ``keys`` must name at
    least one column (for several measures, unpivot and use the measure name).
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    limit = group_rows if group_rows is not None else 1_000_000
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None or largest <= limit:
        return _small_quantiles(df, keys, probs)

    base = list(keys)
    wanted = counts.select(*base, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "_n")
    wanted = wanted.withColumn("_pos", F.col("prob") * (F.col("_n") - 1))
    # _k: zero-based rank of the lower neighbour; both neighbours must stay inside the band.
    wanted = wanted.withColumn("_k", F.floor("_pos")).withColumn("_k1", F.ceil("_pos"))
    span = df.groupBy(*base).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    bands = _keyed_join(wanted, span, base).withColumn("_below", F.lit(0).cast("long"))
    bands = bands.withColumn("_in", F.col("_n"))
    bands = _cut_lineage(bands)
    while True:
        todo = bands.where((F.col("_in") > limit) & (F.col("_lo") < F.col("_hi")))
        if todo.isEmpty():
            break
        inside = _keyed_join(df, counted_broadcast(todo), base, how="inner").where(
            F.col("_x").between(F.col("_lo"), F.col("_hi"))
        )
        grain = [*base, "prob"]
        slack = 3.0 / accuracy
        sketch = inside.groupBy(*grain).agg(
            F.max("_in").alias("_in"),
            F.max("_below").alias("_below"),
            F.max("_k").alias("_k"),
            F.max("_k1").alias("_k1"),
            F.max("_lo").alias("_lo"),
            F.max("_hi").alias("_hi"),
            F.percentile_approx(
                "_x", F.array(*[F.lit(i / 1000) for i in range(1001)]), F.lit(accuracy)
            ).alias("_grid"),
        )
        low = F.floor(((F.col("_k") - F.col("_below")) / F.col("_in") - slack) * 1000)
        high = F.ceil(((F.col("_k1") + 1 - F.col("_below")) / F.col("_in") + slack) * 1000)
        sketch = sketch.select(
            *grain,
            F.when(low <= 0, F.col("_lo")).otherwise(F.get("_grid", low.cast("int"))).alias("_lo2"),
            F.when(high >= 1000, F.col("_hi")).otherwise(F.get("_grid", high.cast("int"))).alias("_hi2"),
        )
        # One row for each large group and rank, settled so that it can be counted: the rows stay where they are.
        narrowed = _keyed_join(inside, counted_broadcast(_cut_lineage(sketch)), grain, how="inner")
        measured = narrowed.groupBy(*grain).agg(
            F.sum((F.col("_x") < F.col("_lo2")).cast("long")).alias("_less"),
            F.sum(F.col("_x").between(F.col("_lo2"), F.col("_hi2")).cast("long")).alias("_in2"),
            F.max("_lo2").alias("_lo2"),
            F.max("_hi2").alias("_hi2"),
        )
        merged = _keyed_join(bands, measured, grain)
        sound = (
            F.col("_in2").isNotNull()
            & (F.col("_below") + F.col("_less") <= F.col("_k"))
            & (F.col("_k1") < F.col("_below") + F.col("_less") + F.col("_in2"))
            & (F.col("_in2") < F.col("_in"))
        )
        updated = _cut_lineage(
            merged.select(
                *grain,
                "_n",
                "_pos",
                "_k",
                "_k1",
                F.when(sound, F.col("_lo2")).otherwise(F.col("_lo")).alias("_lo"),
                F.when(sound, F.col("_hi2")).otherwise(F.col("_hi")).alias("_hi"),
                F.when(sound, F.col("_below") + F.col("_less")).otherwise(F.col("_below")).alias("_below"),
                F.when(sound, F.col("_in2")).otherwise(F.col("_in")).alias("_in"),
                sound.alias("_moved"),
            )
        )
        moved = updated.agg(F.max("_moved")).first()[0]
        bands = updated.drop("_moved")
        if not moved:  # every band is as tight as the sketch can make it
            break

    # A band now holds few rows or few distinct values: count values, then walk the counts.
    inside = _keyed_join(df, counted_broadcast(bands), base, how="inner").where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
    grain = [*base, "prob"]
    freq = inside.groupBy(*grain, "_x").agg(
        F.count(F.lit(1)).alias("_c"), *[F.max(c).alias(c) for c in ("_below", "_k", "_k1", "_pos")]
    )
    run = Window.partitionBy(*grain).orderBy("_x")
    upto = freq.withColumn("_upto", F.col("_below") + F.sum("_c").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    picked = upto.groupBy(*grain).agg(
        F.min(F.when(F.col("_upto") > F.col("_k"), F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.col("_k1"), F.col("_x"))).alias("_b"),
        F.max(F.col("_pos") - F.col("_k")).alias("_f"),
    )
    q = F.when(F.col("_f") == 0, F.col("_a")).otherwise(
        (1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b")
    )
    return picked.select(*grain, q.alias("q"))


def _small_quantiles(df: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return (
        df.groupBy(*keys)
        .agg(F.percentile("_x", arr).alias("_q"))
        .where(F.col("_q").isNotNull())
        .select(*keys, F.explode(F.arrays_zip(arr.alias("prob"), F.col("_q").alias("q"))).alias("_z"))
        .select(*keys, F.col("_z.prob").alias("prob"), F.col("_z.q").alias("q"))
    )


def _keyed_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join on null-safe keys, keeping the right side's version of shared columns."""
    extra = [c for c in right.columns if c not in names]
    right = right.withColumnsRenamed({n: f"_j_{n}" for n in names})
    left = left.select(*[c for c in left.columns if c in names or c not in extra])
    cond = None
    for n in names:
        part = left[n].eqNullSafe(right[f"_j_{n}"])
        cond = part if cond is None else cond & part
    return left.join(right, cond, how).drop(*[f"_j_{n}" for n in names])


def counted_broadcast(small: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast a checkpointed helper table only after counting it; else leave the join to AQE."""
    return F.broadcast(small) if small.count() <= most else small


def _cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by the session."""
    from threatspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
