"""Empirical p-values, resampling errors and significance profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stats import normal_isf, normal_sf
from ..sources.tables import written
from .rows import numbered


def upper_tail(signals: DataFrame, pool: DataFrame, group: str, key: str, nan_as_zero: bool = False) -> DataFrame:
    """Adds ``p``: the fraction of the group's pool values at or above each signal.

    Equal values of signals and pool are counted first; the distinct ones are dealt by ranges of group
    and value, and running counts continue over the ranges, so neither a group nor a frequent value is
    one task.  A null signal has a null p (or 0, if asked).
    """
    n = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = signals.where("signal is not null").select(group, F.col("signal").alias("_v"), F.lit(0).alias("_c"))
    values = pool.where("value is not null").select(group, F.col("value").alias("_v"), F.lit(1).alias("_c"))
    counts = marks.unionByName(values).groupBy(group, "_v").agg(F.sum("_c").alias("_c"))
    dealt = written(counts.repartitionByRange(n, F.col(group), F.col("_v").desc()).withColumn("_part", F.spark_partition_id()), "values")
    parts = dealt.groupBy(group, "_part").agg(F.sum("_c").alias("_s"))
    # One row for each range and group that meet.
    own = Window.partitionBy(group)
    before = parts.select(group, "_part", (F.sum("_s").over(own.orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(own).alias("_all"))
    within = F.sum("_c").over(Window.partitionBy(group, "_part").orderBy(F.col("_v").desc()))
    ranked = dealt.withColumn("_n", within).join(before, [group, "_part"])
    p = ranked.select(group, F.col("_v").alias("signal"), F.try_divide((F.col("_before") + F.col("_n")).cast("double"), F.col("_all")).alias("p"))
    out = signals.join(p, [group, "signal"], "left").select(*signals.columns, "p")
    return out.withColumn("p", F.when(F.col("signal").isNull(), 0.0).otherwise(F.col("p"))) if nan_as_zero else out


def drawn(rep: Column, draw: Column, n: Column, seed: int | None, salt: int = 0, rule: tuple[int, int, int] = (7919, 104729, 17)) -> Column:
    """A row number below n: by a hash of seed, repetition and draw (the same in every attempt of a task)
    or, without a seed, by a linear rule that SQL can follow (its cycles are short; not for error estimates)."""
    if seed is not None:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), rep, draw), n).cast("long")
    a, b, c = rule
    return F.pmod(draw * a + rep * b + draw * rep + c, n).cast("long")


#: Seed of resampling where none is given.
SEED = 42


def draws(n_reps: int, n_draws: int, n_rows: int, spark, seed: int | None = SEED) -> DataFrame:
    """``rep, draw, row``: rows drawn with replacement, as a table (``resampled`` needs none)."""
    base = spark.range(n_reps).withColumnRenamed("id", "rep").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    return base.select("rep", "draw", drawn(F.col("rep"), F.col("draw"), F.lit(n_rows), seed).alias("row"))


def resample_error(means: DataFrame, group: list[str]) -> DataFrame:
    """Mean and population deviation over resample means ``(group.., rep, mean)``."""
    return means.groupBy(*group).agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("error"))


#: Rows whose draws are made together, and repetitions whose sums are one array.
DRAWN_ROWS, CHUNK_REPS = 1024, 1024


def _generator(*key: int) -> np.random.Generator:
    """The same numbers in every attempt of a task."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([k & 0xFFFFFFFFFFFFFFFF for k in key])))


def draw_counts(reps: np.ndarray, n_rows: int, n_draws: int, block: int, seed: int | None, salt: int) -> np.ndarray:
    """How often each row of a block is drawn in each repetition, when n_draws of n_rows are drawn with replacement.

    With a seed the draws of a repetition are first split over all blocks, then over the block's rows:
    multinomial counts, and each block makes its own without the others'.  Without one they follow the
    linear rule of ``drawn``; over a full cycle each row it meets comes up equally often.
    """
    low = block * DRAWN_ROWS
    own = min(DRAWN_ROWS, n_rows - low)
    if seed is not None:
        share = np.full(-(-n_rows // DRAWN_ROWS), DRAWN_ROWS / n_rows)
        share[-1] = 1 - share[:-1].sum()
        split = _generator(seed, salt, int(reps[0]), 0).multinomial(n_draws, share, len(reps))[:, block]
        picks = _generator(seed, salt, int(reps[0]), 1, block).integers(0, own, int(split.sum()))
        return np.bincount(np.repeat(np.arange(len(reps)), split) * own + picks, minlength=len(reps) * own).reshape(len(reps), own)
    rows = np.arange(low, low + own)
    if n_draws == n_rows:
        cycle = np.gcd((7919 + reps) % n_rows, n_rows)[:, None]
        first = ((reps * 104729 + 17) % n_rows)[:, None]
        return np.where((rows[None, :] - first) % cycle == 0, cycle, 0)
    out = np.zeros((len(reps), own), np.int64)
    for i, r in enumerate(reps.tolist()):
        draw = np.arange(n_draws)
        row = (draw * 7919 + r * 104729 + draw * r + 17) % n_rows - low
        out[i] = np.bincount(row[(row >= 0) & (row < own)], minlength=own)
    return out


def _array_rows(schema: pa.Schema, group: list, r_idx: np.ndarray, chunk: int, columns: list[np.ndarray]) -> pa.Table:
    """One row for each radius, with the radius' row of each matrix as an array."""
    lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in columns]
    return pa.table([pa.array(group * len(r_idx), schema.field(0).type), pa.array(r_idx, pa.int32()), pa.array(np.full(len(r_idx), chunk), pa.int32()), *lists], schema=schema)


_LISTS = [("r_idx", pa.int32()), ("chunk", pa.int32()), ("s", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))]


def _group_type(df: DataFrame, group: str) -> tuple[str, pa.DataType]:
    kind = df.schema[group].dataType
    return kind.simpleString(), to_arrow_type(kind)


def resampled(profiles: DataFrame, group: str, n_reps: int, n_draws: int | None = None, seed: int | None = SEED) -> DataFrame:
    """``group, r_idx, means``: means over rows drawn with replacement, one for each repetition, as an array.

    ``profiles(group, number, size, r_idx, signal)`` with the rows of a group numbered from 0 and their
    number; as many are drawn unless ``n_draws`` says otherwise.  No draw is ever a row of a table: how
    often a row comes up is made next to it, and a block of rows gives its weighted sums for all
    repetitions as one product of matrices.  Null signals are left out of sums and weights.
    """
    kind, arrow = _group_type(profiles, group)
    schema = pa.schema([(group, arrow), *_LISTS])

    def run(table: pa.Table) -> pa.Table:
        size, block, salt = (table.column(c)[0].as_py() for c in ("size", "_block", "_salt"))
        r_idx, at = np.unique(table.column("r_idx").to_numpy(), return_inverse=True)
        own = min(DRAWN_ROWS, size - block * DRAWN_ROWS)
        signal, there = np.zeros((own, len(r_idx))), np.zeros((own, len(r_idx)))
        row = table.column("number").to_numpy() - block * DRAWN_ROWS
        signal[row, at], there[row, at] = table.column("signal").to_numpy(), 1.0
        parts = []
        for first in range(0, n_reps, CHUNK_REPS):
            reps = np.arange(first, min(n_reps, first + CHUNK_REPS))
            times = draw_counts(reps, size, size if n_draws is None else n_draws, block, seed, salt).astype(float)
            parts.append(_array_rows(schema, [table.column(group)[0].as_py()], r_idx, first // CHUNK_REPS, [(times @ signal).T.copy(), (times @ there).T.copy()]))
        return pa.concat_tables(parts)

    rows = profiles.where("signal is not null").select(group, "number", F.col("size").cast("long").alias("size"), F.col("r_idx").cast("int").alias("r_idx"), F.col("signal").cast("double").alias("signal"))
    blocks = rows.withColumns({"_block": F.floor(F.col("number") / DRAWN_ROWS), "_salt": F.xxhash64(group)})
    part = blocks.groupBy(group, "_block").applyInArrow(run, f"{group} {kind}, r_idx int, chunk int, s array<double>, w array<double>")
    return merged_means(part, group)


def merged_means(part: DataFrame, group: str) -> DataFrame:
    """``group, r_idx, means`` of partial sums and weights ``(group, r_idx, chunk, s, w)`` of blocks of rows."""
    kind, arrow = _group_type(part, group)
    schema = pa.schema([(group, arrow), ("r_idx", pa.int32()), ("chunk", pa.int32()), ("m", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        s, w = (sum(x.values.to_numpy() for x in table.column(c)) for c in ("s", "w"))
        mean = np.divide(s, w, out=np.full(len(s), np.nan), where=w > 0)
        row = [table.column(c).slice(0, 1) for c in (group, "r_idx", "chunk")]
        return pa.table([*row, pa.array([pa.array(mean, from_pandas=True)], pa.list_(pa.float64()))], schema=schema)

    whole = part.groupBy(group, "r_idx", "chunk").applyInArrow(run, f"{group} {kind}, r_idx int, chunk int, m array<double>")
    chunks = F.array_sort(F.collect_list(F.struct("chunk", "m")))
    return whole.groupBy(group, "r_idx").agg(F.flatten(F.transform(chunks, lambda x: x["m"])).alias("means"))


def array_mean(means: Column) -> Column:
    good = F.filter(means, lambda m: m.isNotNull())
    return F.try_divide(F.aggregate(good, F.lit(0.0), lambda t, m: t + m), F.size(good))


def array_deviation(means: Column) -> Column:
    """Population deviation of an array's values, nulls left out."""
    good = F.filter(means, lambda m: m.isNotNull())
    # The mean is an element of a struct, so it is taken once and not for each value.
    state = F.aggregate(good, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), _welford)
    return F.sqrt(F.try_divide(state["m2"], state["n"]))


def _welford(state: Column, x: Column) -> Column:
    n = state["n"] + 1
    mean = state["mean"] + (x - state["mean"]) / n
    return F.struct(n.alias("n"), mean.alias("mean"), (state["m2"] + (x - state["mean"]) * (x - mean)).alias("m2"))


def bootstrap(profiles: DataFrame, n_rows: int, n_boot: int, seed: int | None = SEED) -> DataFrame:
    """``r_idx, mean, error`` of ``profiles(row, r_idx, signal)``: plain mean, deviation of resample means."""
    rows = profiles.select(F.lit(0).alias("_all"), F.col("row").alias("number"), F.lit(n_rows).alias("size"), "r_idx", "signal")
    error = resampled(rows, "_all", n_boot, None, seed).select("r_idx", array_deviation(F.col("means")).alias("error"))
    return profiles.groupBy("r_idx").agg(F.avg("signal").alias("mean")).join(error, "r_idx", "left")


def random_stacks(pool: DataFrame, n_rows: int, n_stack: int, n_sources: int, seed: int | None = SEED) -> DataFrame:
    """``rep, r_idx, mean`` of stacks of pool rows ``(row, r_idx, signal)`` drawn with replacement."""
    rows = pool.select(F.lit(0).alias("_all"), F.col("row").alias("number"), F.lit(n_rows).alias("size"), "r_idx", "signal")
    return listed(resampled(rows, "_all", n_stack, n_sources, seed), "r_idx")


def listed(stacks: DataFrame, *by: str) -> DataFrame:
    """``rep, by.., mean``: arrays of means as rows, without the nulls."""
    return stacks.select(*by, F.posexplode("means").alias("rep", "mean")).where("mean is not null").select(F.col("rep").cast("long").alias("rep"), *by, "mean")


#: Radii of a pool at most: they stand in expressions.
MAX_RADII = 20_000


def pool_radii(pool: DataFrame) -> list[float]:
    """The rising radii that the pool's profiles share."""
    found = sorted(r["radius"] for r in pool.select("radius").distinct().limit(MAX_RADII + 1).collect())
    if len(found) > MAX_RADII or len(found) < 2:
        raise ValueError(f"a pool has from 2 to {MAX_RADII} radii")
    return found


def segment_of(target: Column, radii: list[float]) -> Column:
    """Number of the segment of the radii that holds a target (the end ones hold what lies outside).

    Two short lists are searched in place of a long one: heads of blocks, then a block.
    """
    inner = [float(r) for r in radii[1:-1]]
    size = max(1, math.isqrt(len(inner)))
    blocks = [inner[i : i + size] for i in range(0, len(inner), size)]
    upto = lambda column: F.size(F.filter(column, lambda r: r <= target))
    if len(blocks) <= 2:
        return upto(F.array(*[F.lit(r) for r in inner]))
    table = F.array(*[F.array(*[F.lit(r) for r in block]) for block in blocks])
    block = F.greatest(upto(F.array(*[F.lit(b[0]) for b in blocks])), F.lit(1))
    return (block - 1) * size + upto(F.element_at(table, block))


def segments(pool: DataFrame, radii: list[float]) -> DataFrame:
    """``row, seg, x0, y0, x1, y1``: the pieces between neighbouring radii of each profile."""
    own = Window.partitionBy("row").orderBy("radius")
    pieces = pool.select("row", F.col("radius").alias("x0"), F.col("signal").alias("y0"), F.lead("radius").over(own).alias("x1"), F.lead("signal").over(own).alias("y1"), (F.row_number().over(own) - 1).alias("seg"))
    return pieces.where("x1 is not null")


def on_segment(target: Column) -> Column:
    return F.col("y0") + (target - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))


#: Pool rows of a group, and sources between whose radii lines are compared at the ends only.
POOL_ROWS, STRIP_SOURCES = 100_000, 512


def count_above(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, theta: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many lines are at or above each point ``(theta, value)``.

    Points are taken in strips of rising theta.  A line's least and largest value in a strip are those
    at its ends; lines are sorted by the least one, in classes of similar rise.  A binary search gives
    the lines that are above for sure, and only those whose values enclose the point's are evaluated.
    """
    line = lambda t, k: y0[k] + (t - x0[k]) * (y1[k] - y0[k]) / (x1[k] - x0[k])
    every = np.arange(len(y0))
    out = np.zeros(len(theta), np.int64)
    order = np.argsort(theta, kind="stable")
    for start in range(0, len(order), STRIP_SOURCES):
        own = order[start : start + STRIP_SOURCES]
        ends = line(theta[own[0]], every), line(theta[own[-1]], every)
        least, most = np.minimum(*ends), np.maximum(*ends)
        slack = 1e-9 * (np.abs(least) + np.abs(most))  # rounding
        least, most = least - slack, most + slack
        rise = np.frexp(most - least)[1] // 2
        for c in np.unique(rise):
            mine = np.flatnonzero(rise == c)
            mine = mine[np.argsort(least[mine], kind="stable")]
            low, wide = least[mine], float((most[mine] - least[mine]).max())
            to = np.searchsorted(low, value[own], "right")
            out[own] += len(mine) - to
            first = np.searchsorted(low, value[own] - wide, "left")
            size = to - first
            for at in range(0, len(own), max(1, int(2_000_000 // max(1, size.max())))):
                some = slice(at, at + max(1, int(2_000_000 // max(1, size.max()))))
                n = size[some]
                point = np.repeat(own[some], n)
                k = mine[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                out += np.bincount(point[line(theta[point], k) >= value[point]], minlength=len(out))
    return out


def signal_pvalue(signals: DataFrame, pool: DataFrame, key: str, nan_as_zero: bool = False) -> DataFrame:
    """Adds ``p`` to ``signals(key, theta, signal)``: the fraction of pool profiles at or above the signal.

    Every profile of ``pool(row, radius, signal)`` is interpolated at the source's own radius, the end
    segments extended.  Sources are dealt by ranges of segment and radius, so that many in one segment
    are many groups; a group has the sources of one range and segment and a bounded block of the
    pool's lines there, and ``count_above`` ranks them.  No source meets all lines.  Null as in ``upper_tail``.
    """
    spark = signals.sparkSession
    radii = pool_radii(pool)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = signals.where("signal is not null and theta is not null").select(F.col(key).alias("_key"), F.col("theta").cast("double").alias("_t"), F.col("signal").cast("double").alias("_v"), segment_of(F.col("theta"), radii).alias("seg"))
    dealt = written(asked.repartitionByRange(n, "seg", "_t", "_v").withColumn("_part", F.spark_partition_id()), "p-sources")
    blocks = max(1, -(-pool.where(F.col("radius") == radii[0]).count() // POOL_ROWS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    lines = segments(pool, radii).where("y0 is not null and y1 is not null").select(F.col("seg").alias("_seg"), block.alias("_of"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    lines = dealt.select(F.col("_part").alias("_range"), F.col("seg").alias("_seg")).distinct().join(lines, "_seg")
    sources = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    kind, arrow = _group_type(dealt, "_key")
    schema = pa.schema([("_key", arrow), ("_above", pa.int64()), ("_all", pa.int64())])

    def run(some: pa.Table, own: pa.Table) -> pa.Table:
        if not some.num_rows or not own.num_rows:
            return schema.empty_table()
        above = count_above(*(own.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")), some.column("_t").to_numpy(), some.column("_v").to_numpy())
        return pa.table([some.column("_key"), pa.array(above), pa.array(np.full(len(above), own.num_rows))], schema=schema)

    counted = sources.groupBy("_part", "seg", "_block").cogroup(lines.groupBy("_range", "_seg", "_of")).applyInArrow(run, f"_key {kind}, _above long, _all long")
    p = counted.groupBy(F.col("_key").alias(key)).agg((F.sum("_above") / F.sum("_all")).alias("p"))
    out = signals.join(p, key, "left")
    return out.withColumn("p", F.when(F.col("signal").isNull(), 0.0).otherwise(F.col("p"))) if nan_as_zero else out


#: Pool rows and draws that meet in one group at most (draws on average).
STACK_ROWS, STACK_DRAWS = 512, 1_000_000

#: Draws that are shuffled at a time; twice the sources, if that is more.
BATCH_DRAWS = 20_000_000


def scaled_stacks(sources: DataFrame, pool: DataFrame, norms: list[float], n_stack: int | Column, seed: int | None = SEED, group: str = "bin_idx") -> DataFrame:
    """``group, r_idx, means``: stacks of random profiles for groups of sources of different sizes, as arrays
    over the repetitions.

    ``sources(group, number, size, theta)`` with places in the group.  In each stack every source draws
    a pool row and, apart from it, a size among those of its group; the row is interpolated at the
    scaled radii, clamped to the pool's.  ``n_stack`` may differ by group (a column of the sources).
    A draw is one row, whatever the number of radii: it goes to its pool row's block, whose profiles
    are a matrix there, and leaves as sums by group and repetition.  Repetitions are taken in batches, each
    of which stores its sums, so the disk holds the draws of one batch and not those of all.
    """
    spark = sources.sparkSession
    radii = np.array(pool_radii(pool))
    rows = numbered(pool.select("row").distinct(), F.col("row"), name="_row")
    n_rows = rows.count()
    reps = F.lit(n_stack) if isinstance(n_stack, int) else n_stack
    each = sources.select(group, "number", "size", reps.cast("long").alias("_reps"))
    total, n_sources, most = each.agg(F.sum("_reps"), F.count("*"), F.max("_reps")).first()
    total, most = total or 0, most or 1
    batches = min(most, max(1, -(-total // max(BATCH_DRAWS, 2 * n_sources))))
    blocks = -(-n_rows // STACK_ROWS)
    parts = max(1, -(-total // (batches * blocks * STACK_DRAWS)))
    draw = F.col("number") if seed is None else F.xxhash64(F.col(group), F.col("number"))
    place = F.floor(F.col("_row") / STACK_ROWS)

    def batch(first: int) -> DataFrame:
        """The draws of every so-many-th repetition."""
        reps = each.where(F.col("_reps") > first).withColumn("rep", F.explode(F.sequence(F.lit(first).cast("long"), F.col("_reps") - 1, F.lit(batches).cast("long"))))
        pick = reps.select(group, "rep", drawn(F.col("rep"), draw, F.lit(n_rows), seed, 1).alias("_row"), drawn(F.col("rep"), draw, F.col("size"), seed, 2, (6271, 92821, 29)).alias("number"))
        sized = pick.join(sources.select(group, "number", F.col("theta").cast("double").alias("theta")), [group, "number"])
        return sized.select(group, "rep", "_row", "theta", place.alias("_block"), F.pmod(F.floor(F.col("rep") / batches), F.lit(parts)).alias("_part"))

    profiles = pool.join(rows, "row").select("_row", F.col("radius").cast("double").alias("radius"), F.col("signal").cast("double").alias("signal"), place.alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))
    kind, arrow = _group_type(sources, group)
    out = pa.schema([(group, arrow), ("rep", pa.int64()), ("s", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])
    scale = np.array(norms, float)

    def run(some: pa.Table, own: pa.Table) -> pa.Table:
        if not some.num_rows:
            return out.empty_table()
        low = some.column("_block")[0].as_py() * STACK_ROWS
        known = np.full((STACK_ROWS, len(radii)), np.nan)
        known[own.column("_row").to_numpy() - low, np.searchsorted(radii, own.column("radius").to_numpy())] = own.column("signal").to_numpy(zero_copy_only=False)
        named = some.column(group).combine_chunks().dictionary_encode()
        rep = some.column("rep").to_numpy()
        code = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (int(rep.max()) + 1) + rep
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        row, theta = some.column("_row").to_numpy()[order] - low, some.column("theta").to_numpy()[order]
        s, w = np.zeros((len(first), len(scale))), np.zeros((len(first), len(scale)))
        mark = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        step = max(1, 4_000_000 // len(scale))
        for at in range(0, len(order), step):
            k, t = row[at : at + step, None], np.clip(theta[at : at + step, None] * scale, radii[0], radii[-1])
            j = np.searchsorted(radii[1:-1], t, "right")
            value = known[k, j] + (t - radii[j]) * (known[k, j + 1] - known[k, j]) / (radii[j + 1] - radii[j])
            good = np.isfinite(value)
            here = mark[at : at + step]
            begin = np.flatnonzero(np.diff(here, prepend=-1))
            s[here[begin]] += np.add.reduceat(np.where(good, value, 0.0), begin, axis=0)
            w[here[begin]] += np.add.reduceat(good.astype(float), begin, axis=0)
        lists = [pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * len(scale), pa.array(m.ravel())) for m in (s, w)]
        return pa.table([named.dictionary.take(named.indices.take(pa.array(order[first]))), pa.array(rep[order][first]), *lists], schema=out)

    by = ("_block", "_part")
    summed = None
    for first in range(batches):
        own = batch(first).groupBy(*by).cogroup(profiles.groupBy(*by)).applyInArrow(run, f"{group} {kind}, rep long, s array<double>, w array<double>")
        own = own if batches == 1 else written(own, "stack-sums")
        summed = own if summed is None else summed.unionByName(own)
    return _by_radius(summed, group, len(norms))


#: Repetitions whose sums by radius are turned into arrays together.
TURNED_REPS = 256


def _by_radius(summed: DataFrame, group: str, n_radii: int) -> DataFrame:
    """``group, r_idx, means`` of sums by repetition ``(group, rep, s, w)`` with arrays over the radii."""
    kind, arrow = _group_type(summed, group)
    schema = pa.schema([(group, arrow), ("r_idx", pa.int32()), ("chunk", pa.int32()), ("m", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        own, at = np.unique(rep, return_inverse=True)
        total = []
        for c in ("s", "w"):
            m = np.zeros((len(own), n_radii))
            np.add.at(m, at, table.column(c).combine_chunks().values.to_numpy().reshape(-1, n_radii))
            total.append(m)
        mean = np.divide(*total, out=np.full(total[0].shape, np.nan), where=total[1] > 0).T
        lists = pa.ListArray.from_arrays(np.arange(n_radii + 1, dtype=np.int32) * len(own), pa.array(mean.ravel(), from_pandas=True))
        name = pa.array([table.column(group)[0].as_py()] * n_radii, arrow)
        return pa.table([name, pa.array(np.arange(n_radii), pa.int32()), pa.array(np.full(n_radii, own[0] // TURNED_REPS), pa.int32()), lists], schema=schema)

    chunked = summed.withColumn("_chunk", F.floor(F.col("rep") / TURNED_REPS)).groupBy(group, "_chunk").applyInArrow(run, f"{group} {kind}, r_idx int, chunk int, m array<double>")
    chunks = F.array_sort(F.collect_list(F.struct("chunk", "m")))
    return chunked.groupBy(group, "r_idx").agg(F.flatten(F.transform(chunks, lambda x: x["m"])).alias("means"))


def group_bootstrap(profiles: DataFrame, sources: DataFrame, n_boot: int, seed: int | None = SEED, group: str = "bin_idx") -> DataFrame:
    """``group, r_idx, stack, error``: plain means of ``profiles(group, number, r_idx, signal)`` over a group,
    and the deviation of the means over resamples of its sources ``(group, number, size)``."""
    sizes = sources.groupBy(group).agg(F.max("size").alias("size"))
    good = profiles.where("signal is not null")
    means = resampled(good.join(sizes, group), group, n_boot, None, seed)
    error = means.select(group, "r_idx", array_deviation(F.col("means")).alias("error"))
    return good.groupBy(group, "r_idx").agg(F.avg("signal").alias("stack")).join(error, [group, "r_idx"], "left")


def tail_of_stacks(data: DataFrame, stacks: DataFrame, by: list[str], value: str = "stack") -> DataFrame:
    """``by.., p, sigma``: fraction of the stacks ``(by.., means)`` at or above the data, as sigma too."""
    good = F.filter("means", lambda m: m.isNotNull())
    above = F.size(F.filter(good, lambda m: m >= F.col("_d")))
    p = data.select(*by, F.col(value).alias("_d")).join(stacks, by).select(*by, F.try_divide(above.cast("double"), F.size(good)).alias("p"))
    return p.withColumn("sigma", normal_isf(F.col("p")))


def significance_profile(data: DataFrame, stacks: DataFrame, by: tuple[str, ...] = ("r_idx",)) -> DataFrame:
    """``by.., p, sigma``: fraction of random stacks at or above the data, as sigma too."""
    joined = stacks.join(data.select(*by, F.col("mean").alias("d")), list(by))
    p = joined.groupBy(*by).agg(F.avg(F.when(F.col("mean") >= F.col("d"), 1.0).otherwise(0.0)).alias("p"))
    return p.withColumn("sigma", normal_isf(F.col("p")))


def _student_fit(x: np.ndarray) -> tuple[float, float, float]:
    """Maximum likelihood (nu, mu, sigma) by expectation-maximisation with a line search over nu."""
    mu, sigma, nu = float(np.median(x)), float(x.std() or 1e-12), 8.0
    grid = np.geomspace(1.0, 400.0, 60)
    for _ in range(60):
        w = (nu + 1) / (nu + ((x - mu) / sigma) ** 2)
        mu = float((w * x).sum() / w.sum())
        sigma = max(float(np.sqrt((w * (x - mu) ** 2).mean())), 1e-300)
        z2 = ((x - mu) / sigma) ** 2
        like = [len(x) * (math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v)) - (v + 1) / 2 * np.log1p(z2 / v).sum() for v in grid]
        best = float(grid[int(np.argmax(like))])
        if best == nu:
            break
        nu = best
    return nu, mu, sigma


def _student_sf(t: float, nu: float) -> float:
    """Upper tail through the incomplete beta's continued fraction."""
    x, a, b = nu / (nu + t * t), nu / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
            h *= d * c
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        inc = 1.0
    elif x < (a + 1) / (a + b + 2):
        inc = front * fraction(a, b, x) / a
    else:
        inc = 1 - front * fraction(b, a, 1 - x) / b
    return inc / 2 if t >= 0 else 1 - inc / 2


def student_fits(data: DataFrame, stacks: DataFrame, by: list[str], every: int = 10, first: int = 0, value: str = "stack") -> DataFrame:
    """``by.., r_idx, p_t, sigma_t``: tail of a Student law fitted to the stacks at every n-th radius, as sigma too.

    ``stacks(by.., r_idx, means)`` are arrays, so each fit is one row and all groups are one pass.
    Between fitted radii both are interpolated in the radius number, beyond the last they stay.
    """
    keys = [*by, "r_idx"]
    wanted = data.select(*by, F.col("r_idx").cast("int").alias("r_idx"), F.col(value).alias("d"))
    chosen = stacks.where((F.col("r_idx") - first) % every == 0).withColumn("r_idx", F.col("r_idx").cast("int")).join(wanted, keys).where("d is not null")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = []
            for means, d in zip(batch.column("means"), batch.column("d").to_pylist(), strict=True):
                x = means.values.drop_null().to_numpy()
                if len(x) < 2:
                    tails.append(None)
                    continue
                nu, mu, sigma = _student_fit(x)
                tails.append(_student_sf((d - mu) / sigma, nu))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(tails, pa.float64())], [*keys, "p_t"])

    kinds = ", ".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}" for k in keys)
    fitted = written(chosen.select(*keys, "means", "d").mapInArrow(fit, f"{kinds}, p_t double").withColumn("sigma_t", normal_isf(F.col("p_t"))), "student")
    # One row for each fitted radius: neighbours come from a window over a group's few.
    at = Window.partitionBy(*by).orderBy("k0") if by else Window.orderBy("k0")
    lead = lambda c: F.lead(c).over(at)
    pieces = fitted.select(*by, F.col("r_idx").alias("k0"), F.col("p_t").alias("p0"), F.col("sigma_t").alias("s0")).select("*", lead("k0").alias("k1"), lead("p0").alias("p1"), lead("s0").alias("s1"))
    k = F.col("r_idx")
    here = (k >= F.col("k0")) & (k < F.coalesce("k1", F.lit(1 << 30)))
    met = wanted.select(*keys).join(pieces, by).where(here) if by else wanted.select(*keys).join(F.broadcast(pieces), here)
    line = lambda a, b: F.when(F.col("k1").isNull() | (k == F.col("k0")), F.col(a)).otherwise(F.col(a) + (k - F.col("k0")) * (F.col(b) - F.col(a)) / (F.col("k1") - F.col("k0")))
    return met.select(*keys, line("p0", "p1").alias("p_t"), line("s0", "s1").alias("sigma_t"))


def student_profile(data: DataFrame, stacks: DataFrame, every: int = 10, first: int = 0) -> DataFrame:
    """``r_idx, p_t, sigma_t`` of one group, from stacks as rows ``(rep, r_idx, mean)`` and data ``(r_idx, mean)``."""
    arrays = stacks.groupBy("r_idx").agg(F.collect_list("mean").alias("means"))
    return student_fits(data, arrays, [], every, first, "mean")


def stouffer(pvalues: DataFrame, group: str, p: str = "p") -> DataFrame:
    """``group, n, z, p_combined``: sum of sigmas over the root of their number (p-values kept off 0 and 1)."""
    z = normal_isf(F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15)))
    out = pvalues.where(F.col(p).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), (F.sum(z) / F.sqrt(F.count("*"))).alias("z"))
    return out.withColumn("p_combined", normal_sf(F.col("z")))


def overall_significance(clusters: DataFrame, matches: DataFrame, combined: DataFrame, unmatched_p: float = 0.5, key: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """Two levels of Stouffer's rule: ``key, label, p`` of every cluster, and one row over all of them.

    ``matches(key, label)`` pairs clusters with associations, ``combined(label, p_combined)`` joins the
    p-values of an association's members.  A cluster without an association, or whose association has no
    p-value, counts with ``unmatched_p``.
    """
    each = clusters.select(key).join(matches.select(key, "label"), key, "left").join(combined.select("label", F.col("p_combined").alias("_p")), "label", "left")
    each = each.select(key, "label", F.coalesce("_p", F.lit(float(unmatched_p))).alias("p"))
    whole = stouffer(each.withColumn("_all", F.lit(0)), "_all").join(each.agg(F.count("label").alias("n_matched")))
    return each, whole.select("n", "n_matched", "z", "p_combined")


def random_positions(spark, n: int, abs_b_min: float = 0.0, seed: int | None = None) -> DataFrame:
    """``id, lon, lat`` uniform on the sky beyond a latitude: at random, or on the golden-angle spiral without a seed."""
    rows = spark.range(n)
    lon, lat = random_position(F.col("id"), abs_b_min, None if seed is None else F.lit(seed))
    return rows.select("id", lon.alias("lon"), lat.alias("lat"))


def random_position(number: Column, abs_b_min: float = 0.0, seed: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude of a numbered point, by a hash of seed and number or by the spiral's fractions."""
    if seed is None:
        u, v, s = golden_fraction(number, 0.6180339887498949), golden_fraction(number, 0.3819660112501051), golden_fraction(number, 0.7548776662466927)
    else:
        u, v, s = (F.pmod(F.xxhash64(seed, F.lit(k), number), F.lit(1 << 53)) / F.lit(float(1 << 53)) for k in range(3))
    low = math.sin(math.radians(abs_b_min))
    size = low + (1 - low) * u
    return 360 * v, F.degrees(F.asin(F.least(size, F.lit(1.0)))) * F.when(s < 0.5, -1.0).otherwise(1.0)


def golden_fraction(key: Column, step: float) -> Column:
    return key * step - F.floor(key * step)


def numpy_positions(spark, n: int, abs_b_min: float | None, seed: int) -> DataFrame:
    """The same positions from numpy's generator, for agreement with numpy programs (one task)."""

    def draw(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        if abs_b_min is None:
            lat = np.rad2deg(np.arcsin(rng.uniform(-1, 1, n)))
        else:
            lat = np.rad2deg(np.arcsin(rng.uniform(np.sin(np.deg2rad(abs_b_min)), 1, n))) * rng.choice([-1, 1], n)
        yield pd.DataFrame({"id": np.arange(n), "lon": np.rad2deg(rng.uniform(0, 2 * np.pi, n)), "lat": lat})

    return spark.range(1, numPartitions=1).mapInPandas(draw, "id long, lon double, lat double")
