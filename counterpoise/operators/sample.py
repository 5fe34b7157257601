"""Repeatable sampling, splitting and dealing of rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draw import below, hash52, u
from .prefix import ordered_chunks, running_sums, shuffled_rank, sorted_rank

BINS = 1 << 12
MERGED_ROWS = 10_000
UNITS = Decimal(10**30)


def bootstrap(df: DataFrame, ids: list[str], tree: int = 0, seed="bootstrap") -> DataFrame:
    """N draws with replacement from N rows: the drawn rows and their ``copies``."""
    return _with_copies(df, ids, tree, seed, "inner")


def out_of_bag(df: DataFrame, ids: list[str], tree: int = 0, seed="bootstrap") -> DataFrame:
    """Rows the same bootstrap never drew."""
    return _with_copies(df, ids, tree, seed, "left_anti")


def _with_copies(df: DataFrame, ids: list[str], tree: int, seed, how: str) -> DataFrame:
    ranked = shuffled_rank(df, ids, seed=f"{seed}-rank", out="_row")
    size = df.agg(F.count(F.lit(1))).scalar()
    # row j makes draw j, so draws are as spread out as the rows themselves
    drawn = ranked.select(below(u(seed, F.lit(tree), "_row"), size).alias("_row"))
    copies = drawn.groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    return ranked.join(copies, "_row", how).drop("_row")


def random_split(df: DataFrame, ids: list[str], n: int, seed="split") -> tuple[DataFrame, DataFrame]:
    """(n random rows, the rows that remain)."""
    ranked = shuffled_rank(df, ids, seed=seed, out="_row")
    taken = ranked.where(F.col("_row") < n).drop("_row")
    return taken, ranked.where(F.col("_row") >= n).drop("_row")


def bernoulli_sample(df: DataFrame, ids: list[str], rate: float, seed="bernoulli") -> DataFrame:
    """Each row with probability ``rate``; a rate of 1 or more keeps all rows."""
    return df if rate >= 1 else df.where(u(seed, *ids) < rate)


def fixed_size_sample(df: DataFrame, ids: list[str], k: int, seed="reservoir", stable: bool = False) -> DataFrame:
    """k random rows, those of least draw; ``stable`` returns them in input (id) order.

    The k-th draw is found by histograms, each over the range that holds it in the one before.  Rows below
    that range are taken where they lie, and only the last at most ``MERGED_ROWS`` are merged in one task.
    """
    drawn = df.withColumn("_h", hash52(F.lit(str(seed)), *[F.col(c) for c in ids]))
    low, width, rest = 0, 1 << 52, k
    while rest > MERGED_ROWS and width > 1:
        step = max(1, width // BINS)
        inside = drawn.where((F.col("_h") >= low) & (F.col("_h") < low + width))
        counts = dict(inside.groupBy(F.floor((F.col("_h") - low) / step).alias("b")).agg(F.count(F.lit(1))).collect())
        if sum(counts.values()) <= rest:
            low, width, rest = low + width, 1 << 52, 0
            break
        for place in range(-(-width // step)):
            n = counts.get(place, 0)
            if n > rest:
                low, width = low + place * step, step
                break
            rest -= n
    taken = drawn.where(F.col("_h") < low)
    last = drawn.where((F.col("_h") >= low) & (F.col("_h") < low + width)).orderBy("_h", *ids).limit(rest)
    picked = (last if low == 0 else taken.union(last) if rest else taken).drop("_h")
    return picked.orderBy(*ids) if stable else picked


def sample_row_entries(matrix: DataFrame, n: int, seed="entries") -> DataFrame:
    """At most n random entries of each matrix row; each task first keeps n per row."""
    order = W.partitionBy("row").orderBy(u(seed, "row", "col"), "col")
    return matrix.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def stratified_partition(df: DataFrame, label: str, ids: list[str], p: int, seed="stratify") -> DataFrame:
    """Deal the rows of each class round-robin over p partitions from a random start."""
    ranked = shuffled_rank(df, ids, [label], seed=seed, out="_k")
    start = below(u(f"{seed}-start", label), p)
    return ranked.withColumn("part", F.pmod(F.col("_k") + start, F.lit(p))).drop("_k")


def _intervals(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, _lo, _hi): shares of ``UNITS`` whole units, as decimals, which add up without rounding.

    A weight keeps its interval down to 1e-30 of the total.
    """
    positive = weights.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w"))
    total = positive.agg(F.sum("_w")).scalar()
    units = positive.select(key, F.round((F.col("_w") / total).cast("decimal(38,36)") * F.lit(UNITS).cast("decimal(31,0)"), 0).cast("decimal(31,0)").alias("_w"))
    run = running_sums(ordered_chunks(units, key), [], ["_pos"], {"_run": F.col("_w")}).drop("_pos", "_chunk")
    top = units.agg(F.sum("_w")).scalar()
    # shares were rounded to doubles, so they miss the whole by a little, which is spread evenly
    run = run.withColumn("_top", top.cast("decimal(38,0)"))
    miss = (F.lit(UNITS).cast("decimal(31,0)") - F.col("_top")).cast("double")

    def placed(x: Column) -> Column:
        moved = x + F.round(x.cast("double") / F.col("_top").cast("double") * miss).cast("decimal(31,0)")
        return F.when(x == F.col("_top"), F.lit(UNITS).cast("decimal(31,0)")).otherwise(moved).cast("decimal(38,0)")

    return run.select(key, placed(F.col("_run") - F.col("_w")).alias("_lo"), placed(F.col("_run")).alias("_hi"))


def cumulative_distribution(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Interval [lo, hi) of each key on [0, 1), by exact running sums of normalised weights."""
    found = _intervals(weights, key, weight)
    return found.select(key, *[(F.col(f"_{c}").cast("double") / float(UNITS)).alias(c) for c in ("lo", "hi")])


def multinomial_sample(
    draws: DataFrame, draw: str, weights: DataFrame, key: str, weight: str, cells: int | None = None
) -> DataFrame:
    """Key whose interval holds each draw in [0, 1), a double or a decimal of up to 30 places.

    Draws and intervals meet on even cells of [0, 1), so the range join is an equi-join.
    There are as many cells as keys unless given, so a cell holds few intervals.
    """
    cells = max(1024, weights.count()) if cells is None else cells

    def cell(x: Column) -> Column:
        return F.least(F.floor(x.cast("double") / float(UNITS) * cells), F.lit(cells - 1))

    intervals = _intervals(weights, key, weight)
    spread = intervals.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    at = (F.col(draw).cast("decimal(31,30)") * F.lit(UNITS).cast("decimal(31,0)")).cast("decimal(38,0)")
    placed = draws.withColumn("_at", at).withColumn("_cell", cell(F.col("_at")))
    met = placed.join(spread, "_cell").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return met.drop("_cell", "_lo", "_hi", "_at")


def interleave_classes(df: DataFrame, label: str, ids: list[str], first: str, seed="interleave") -> DataFrame:
    """Alternate shuffled rows of ``first`` with shuffled other rows, then the remainder; adds ``place``.

    ``place`` is dense from 0, computed from class sizes alone.
    """
    side = df.withColumn("_first", (F.col(label) == F.lit(first)).cast("int"))
    ranked = shuffled_rank(side, ids, ["_first"], seed=seed, out="_k")
    sizes = side.groupBy("_first").agg(F.count(F.lit(1)).alias("n"))
    shorter = F.when(sizes.agg(F.count(F.lit(1))).scalar() > 1, sizes.agg(F.min("n")).scalar()).otherwise(0)
    place = F.when(F.col("_k") < F.col("_short"), 2 * F.col("_k") + 1 - F.col("_first")).otherwise(
        F.col("_k") + F.col("_short")
    )
    return ranked.withColumn("_short", shorter.cast("long")).withColumn("place", place).drop("_k", "_first", "_short")


def row_numbers(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Dense 0-based ``rank`` along ``order`` without one task per key."""
    return sorted_rank(df, order, keys)
