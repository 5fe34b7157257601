"""Distances to seed vectors and similarity of sparse rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..functions.distance import MEASURES
from ..functions.draw import u
from ..functions.info import llr, llr_array
from ..session import discard, fits, materialize
from .row_pieces import column_sizes, pack, top_partners
from .tiles import LIMIT, tile_join

MAX_SEEDS = 2_000
SMALLEST = 5e-324


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Mean vector of each label."""
    means = df.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
    return means.groupBy(label).agg(packed.alias(vec))


def vector_distance(
    df: DataFrame,
    id_col: str,
    vec: str,
    seeds: DataFrame,
    seed_id: str,
    measure: str | Callable[..., Column] = "sq_euclidean",
    max_seeds: int = MAX_SEEDS,
    **options,
) -> DataFrame:
    """(seed, id, distance) of every row to every seed.

    Up to ``max_seeds`` seeds travel as one array value next to the rows, which then never
    move.  More seeds are cut into blocks of that size, and rows meet each block.
    """
    function = MEASURES[measure] if isinstance(measure, str) else measure
    # a weight or matrix column becomes a plain column first: it may be a scalar subquery
    given = {f"_o_{k}": v for k, v in options.items() if isinstance(v, Column)}
    options = {k: F.col(f"_o_{k}") if isinstance(v, Column) else v for k, v in options.items()}
    df = df.withColumns(given) if given else df
    packed = F.collect_list(F.struct(F.col(seed_id).alias("seed"), F.col(vec).alias("v")))
    if fits(seeds, max_seeds):
        rows = df.withColumn("_seeds", seeds.agg(packed).scalar())
    else:
        blocks = -(-seeds.count() // max_seeds)
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
        block = F.floor(u("seed-block", seed_id) * blocks).cast("int")
        tables = seeds.groupBy(block.alias("_b")).agg(packed.alias("_seeds")).withColumn("_salt", salts)
        rows = df.withColumn("_salt", F.floor(u("seed-salt", id_col) * spread).cast("int")).withColumn(
            "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        ).join(tables, ["_b", "_salt"])
    met = rows.select(id_col, F.col(vec).alias("_a"), *given, F.explode("_seeds").alias("_s"))
    distance = function(F.col("_s.v"), F.col("_a"), **options)
    return met.select(F.col("_s.seed").alias(seed_id), id_col, distance.alias("distance"))


def distance_vectors(pairs: DataFrame, id_col: str, seed_id: str) -> DataFrame:
    """One array of distances per row, in seed order; its length is the number of seeds."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct(seed_id, "distance"))), lambda s: s["distance"])
    return pairs.groupBy(id_col).agg(packed.alias("distances"))


# row similarity


@dataclass(frozen=True)
class Measure:
    """How a similarity is made of the dot product n and the row statistics a and b.

    ``reach`` tells whether a row can reach a threshold by some of its entries alone: it
    gets (their sum of squares, their number, entries of the row, threshold).  ``array`` is
    ``similarity`` for numpy arrays.
    """

    similarity: Callable[[Column, Column, Column, Column], Column]
    prepare: str  # binary | raw | unit | centered
    consider: Callable[..., Column] | None = None
    reach: Callable[..., Column] | None = None
    array: Callable[..., np.ndarray] | None = None


def _consider_cosine(a: str, b: str, t: float) -> Column:
    # dot <= largest value of one row times the absolute sum of the other
    return (F.col(f"{a}_max") * F.col(f"{b}_sum") >= t) & (F.col(f"{b}_max") * F.col(f"{a}_sum") >= t)


def _consider_tanimoto(a: str, b: str, t: float) -> Column:
    return (F.col(f"{a}_nnz") >= F.col(f"{b}_nnz") * t) & (F.col(f"{b}_nnz") >= F.col(f"{a}_nnz") * t)


def _consider_count(a: str, b: str, t: float) -> Column:
    return (F.col(f"{a}_nnz") >= t) & (F.col(f"{b}_nnz") >= t)


SIMILARITIES: dict[str, Measure] = {
    "cooccurrence": Measure(
        lambda n, a, b, cols: n, "binary", _consider_count, lambda squares, some, nnz, t: some >= t,
        array=lambda n, a, b, cols: n,
    ),
    "loglikelihood": Measure(
        lambda n, a, b, cols: 1.0 - 1.0 / (1.0 + llr(n, b - n, a - n, cols - a - b + n)), "binary",
        array=lambda n, a, b, cols: 1.0 - 1.0 / (1.0 + llr_array(n, b - n, a - n, cols - a - b + n)),
    ),
    "tanimoto": Measure(
        lambda n, a, b, cols: n / (a + b - n), "binary", _consider_tanimoto, lambda squares, some, nnz, t: some >= t * nnz,
        array=lambda n, a, b, cols: n / (a + b - n),
    ),
    "cityblock": Measure(
        lambda n, a, b, cols: 1.0 / (1.0 + a + b - 2.0 * n), "binary",
        array=lambda n, a, b, cols: 1.0 / (1.0 + a + b - 2.0 * n),
    ),
    "cosine": Measure(
        lambda n, a, b, cols: n, "unit", _consider_cosine, lambda squares, some, nnz, t: squares >= t * t * (1 - 1e-9),
        array=lambda n, a, b, cols: n,
    ),
    "pearson": Measure(
        lambda n, a, b, cols: n, "centered", _consider_cosine, lambda squares, some, nnz, t: squares >= t * t * (1 - 1e-9),
        array=lambda n, a, b, cols: n,
    ),
    "euclidean": Measure(
        lambda n, a, b, cols: 1.0 / (1.0 + F.sqrt(F.greatest(F.lit(0.0), a - 2.0 * n + b))), "raw",
        array=lambda n, a, b, cols: 1.0 / (1.0 + np.sqrt(np.maximum(0.0, a - 2.0 * n + b))),
    ),
}


def row_statistics(entries: DataFrame) -> DataFrame:
    """Per row: entries, largest absolute value, absolute sum, sum and sum of squares."""
    return entries.groupBy("row").agg(
        F.count(F.lit(1)).cast("double").alias("nnz"), F.max(F.abs("val")).alias("max"),
        F.sum(F.abs("val")).alias("sum"), F.sum("val").alias("plain"), F.sum(F.col("val") * F.col("val")).alias("sq"),
    )


def _row_statistics_beside(entries: DataFrame) -> dict[str, Column]:
    """``row_statistics`` as columns of the entries: one shuffle by row serves the entries and the numbers."""
    val, whole = F.col("val"), W.partitionBy("row")
    made = {
        "nnz": F.count(F.lit(1)).cast("double"), "max": F.max(F.abs(val)), "sum": F.sum(F.abs(val)),
        "plain": F.sum(val), "sq": F.sum(val * val),
    }
    return {n: c.over(whole) if n != "nnz" else F.count(F.lit(1)).over(whole).cast("double") for n, c in made.items()}


def _prepared(entries: DataFrame, prepare: str, signed_mean: bool = False) -> DataFrame:
    """Entries as the measure needs them, with their row's statistics; the entries of a row lie together."""
    entries = entries.where((F.col("val") != 0) & F.col("row").isNotNull()).select("row", "col", F.col("val").cast("double").alias("val"))
    if prepare == "centered":
        beside = _row_statistics_beside(entries)
        mean = beside["plain" if signed_mean else "sum"] / beside["nnz"]
        centered = entries.withColumn("_m", mean).withColumn("val", F.col("val") - F.col("_m")).drop("_m")
        entries = centered.where(F.col("val") != 0)
    joined = entries.withColumns({f"_{n}": c for n, c in _row_statistics_beside(entries).items()})
    nnz, largest, total, squares = (F.col(f"_{n}") for n in ("nnz", "max", "sum", "sq"))
    if prepare == "binary":
        ready = {"val": F.lit(1.0), "norm": nnz, "max": F.lit(1.0), "sum": nnz}
    elif prepare == "raw":
        ready = {"val": F.col("val"), "norm": squares, "max": largest, "sum": total}
    else:
        length = F.sqrt(squares)
        ready = {"val": F.col("val") / length, "norm": F.lit(1.0), "max": largest / length, "sum": total / length}
    return joined.select("row", "col", nnz.alias("nnz"), *[c.alias(n) for n, c in ready.items()])


def prepare_rows(entries: DataFrame, prepare: str, signed_mean: bool = False) -> DataFrame:
    """Entries as the measure needs them, with their row's statistics: (row, col, val, norm, nnz, max, sum).

    The table is written: both sides of the self-join, the column counts and the dot
    products of candidates all read it.
    """
    return materialize(_prepared(entries, prepare, signed_mean), "row-entries")


def _sides(entries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    def side(name: str) -> DataFrame:
        return entries.select(F.col("col").alias("col"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return side("a"), side("b")


def _dots(entries: DataFrame, consider: Column | None, limit: int) -> DataFrame:
    """(a, b, n, a_norm, b_norm) for all row pairs a <= b that share a column.

    Row statistics ride along with the entries, so the pair table is never joined again.
    """
    columns = ["row", "val", "norm", "nnz", "max", "sum"]
    a, b = _sides(entries, columns)
    met = tile_join(a, b, "col", "a_row", "b_row", limit).where(F.col("a_row") <= F.col("b_row"))
    if consider is not None:
        met = met.where(consider)
    return met.groupBy(F.col("a_row").alias("a"), F.col("b_row").alias("b")).agg(
        F.sum(F.col("a_val") * F.col("b_val")).alias("n"), F.max("a_norm").alias("a_norm"), F.max("b_norm").alias("b_norm")
    )


def _hot_columns(entries: DataFrame, limit: int) -> DataFrame:
    return entries.groupBy("col").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") > limit).select("col")


def _dots_above(
    entries: DataFrame, measure: Measure, consider: Column, threshold: float, limit: int, hot: DataFrame
) -> DataFrame:
    """The same table for pairs that can reach the threshold, when some columns are hot.

    Most rows have too little weight in hot columns to reach the threshold by these
    alone, so such a pair must share another column.  Pairs are therefore made (1) from
    the other columns and (2) from hot columns between the rows that are heavy in them;
    pairs of (1) that (2) did not cover look up their hot entries.
    """
    cold = entries.join(hot, "col", "left_anti")
    warm = materialize(entries.join(hot, "col", "left_semi"), "hot-entries")
    weight = warm.groupBy("row").agg(
        F.sum(F.col("val") * F.col("val")).alias("_s"), F.count(F.lit(1)).alias("_c"), F.max("nnz").alias("nnz")
    )
    heavy = weight.where(measure.reach(F.col("_s"), F.col("_c"), F.col("nnz"), threshold)).select("row")
    columns = ["a", "b", "n", "a_norm", "b_norm"]
    first = materialize(_dots(cold, consider, limit), "cold-pairs")
    second = _dots(warm.join(heavy, "row", "left_semi"), consider, limit)

    marks = heavy.withColumn("_heavy", F.lit(True))
    marked = first.join(marks.select(F.col("row").alias("a"), F.col("_heavy").alias("_ha")), "a", "left")
    marked = marked.join(marks.select(F.col("row").alias("b"), F.col("_heavy").alias("_hb")), "b", "left")
    open_pairs = marked.where(F.col("_ha").isNull() | F.col("_hb").isNull()).select("a", "b", "a_norm", "b_norm")
    left, right = _sides(warm, ["row", "val"])
    looked_up = open_pairs.join(left, F.col("a") == F.col("a_row")).drop("a_row").join(
        right.withColumnRenamed("b_row", "b"), ["b", "col"]
    )
    third = looked_up.select("a", "b", (F.col("a_val") * F.col("b_val")).alias("n"), "a_norm", "b_norm")
    parts = first.select(*columns).unionByName(second.select(*columns)).unionByName(third)
    return parts.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max("a_norm").alias("a_norm"), F.max("b_norm").alias("b_norm")
    )


def _column_count(entries: DataFrame, rule: Measure, n_cols: Column | int | None) -> Column:
    if n_cols is None:
        n_cols = entries.agg(F.max("col") + 1).scalar() if rule is SIMILARITIES["loglikelihood"] else 0
    return (n_cols if isinstance(n_cols, Column) else F.lit(n_cols)).cast("double")


def row_pairs(
    entries: DataFrame,
    measure: str | Measure,
    threshold: float = SMALLEST,
    n_cols: Column | int | None = None,
    signed_mean: bool = False,
    limit: int = LIMIT,
) -> DataFrame:
    """(a, b, similarity) with a <= b, for pairs at or above the threshold."""
    rule = SIMILARITIES[measure] if isinstance(measure, str) else measure
    carried = prepare_rows(entries, rule.prepare, signed_mean)
    consider = rule.consider("a", "b", threshold) if rule.consider is not None and threshold > SMALLEST else None
    hot = _hot_columns(carried, limit) if consider is not None and rule.reach is not None else None
    if hot is not None and not hot.isEmpty():
        dots = _dots_above(carried, rule, consider, threshold, limit, hot)
    else:
        dots = _dots(carried, consider, limit)
    found = rule.similarity(F.col("n"), F.col("a_norm"), F.col("b_norm"), _column_count(entries, rule, n_cols))
    return dots.select("a", "b", found.alias("similarity")).where(F.col("similarity") >= threshold)


def top_pairs(pairs: DataFrame, top: int = 100, exclude_self: bool = False) -> DataFrame:
    """Both halves of the triangle, and the most similar rows of each row.

    ``row_number <= top`` is pushed below the shuffle: each task keeps its best rows first.
    """
    other = pairs.where(F.col("a") != F.col("b")).select(F.col("b").alias("row"), F.col("a").alias("other"), "similarity")
    kept = pairs.where(F.col("a") != F.col("b")) if exclude_self else pairs
    both = kept.select(F.col("a").alias("row"), F.col("b").alias("other"), "similarity").unionByName(other)
    order = W.partitionBy("row").orderBy(F.desc("_key"), "other")
    ranked = both.withColumn("_key", F.round("similarity", 9)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).drop("_key")


BLOCK_PAIRS = 500_000  # meetings made at a time
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _top_in_pieces(
    entries: DataFrame, rule: Measure, top: int, exclude_self: bool, threshold: float, limit: int,
    n_cols: Column | int | None = None, signed_mean: bool = False,
) -> DataFrame | None:
    """``top_pairs`` without a table of pairs; None when a column has more than ``limit`` entries."""
    seen = Observation("columns")
    counted = n_cols is None and rule is SIMILARITIES["loglikelihood"]
    source = entries.observe(seen, F.max("col").alias("last")) if counted else entries
    rows = _prepared(source, rule.prepare, signed_mean)
    # a value may be missing only in a column's name; such an entry counts in its row but meets nothing
    packed = pack(rows.where(F.col("col").isNotNull()), rule.prepare == "binary")
    # row groups stay small: a reader holds a whole one
    pieces = materialize(packed, "row-pieces", **{"parquet.block.size": 16 << 20})
    if (column_sizes(pieces).agg(F.max("f")).first()[0] or 0) > limit:
        discard(pieces)
        return None
    if isinstance(n_cols, Column):
        n_cols = entries.sparkSession.range(1).select(n_cols.cast("double")).first()[0]
    columns = float((seen.get["last"] or 0) + 1 if counted else n_cols or 0)
    similarity = rule.array
    return top_partners(
        pieces, dict(entries.dtypes), lambda n, a, b: similarity(n, a, b, columns), top, exclude_self, threshold, BLOCK_PAIRS)


LEVELS = 64
SLACK = 2e-9  # similarities equal to nine digits count as tied


def _asks(entries: DataFrame, hot: DataFrame, first: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """Entries of hot columns for the rows that ask, with the weakest ``_reach`` of a partner worth meeting,
    and for all rows with their ``_level``.

    Two rows that share hot columns only are at most as similar as the product of their lengths in
    these.  A row whose ``top`` best among ``first`` are at least ``_kth`` needs only partners of length
    ``_kth`` over its own.  Level L holds lengths above 2^(-(L + 1) / 2), up to 2^(-L / 2).
    """
    warm = entries.join(hot, "col", "left_semi")
    length = warm.groupBy("row").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("_length"))
    order = W.partitionBy("row").orderBy(F.desc("similarity"))
    both = first.select(F.col("a").alias("row"), "similarity").union(first.where(F.col("a") != F.col("b")).select("b", "similarity"))
    kth = both.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == top).select("row", F.col("similarity").alias("_kth"))
    known = materialize(length.join(kth, "row", "left").select(
        "row", "_length", F.greatest(F.coalesce("_kth", F.lit(0.0)) - SLACK, F.lit(0.0)).alias("_kth")), "hot-lengths")
    deepest = F.lit(float(LEVELS - 1))
    # rounding must not lift a partner over the edge of its level
    level = F.least(F.greatest(F.floor(-2 * F.log2(F.col("_length") * (1 + 1e-9))), F.lit(0)), deepest).cast("int")
    reach = F.when(F.col("_kth") > 0, F.least(F.floor(2 * F.log2(F.col("_length") / F.col("_kth") * (1 + 1e-9))), deepest)).otherwise(deepest).cast("int")
    lengths = known.select("row", level.alias("_level"), reach.alias("_reach"))
    full = warm.select("row", "col", "val").join(lengths, "row")
    return full.where(F.col("_reach") >= 0).drop("_level"), full.drop("_reach")


def _top_with_hot(entries: DataFrame, hot: DataFrame, top: int, exclude_self: bool, limit: int) -> DataFrame:
    """``top_pairs`` of unit rows when some columns are hot, without all pairs of these columns.

    Pairs that share another column are computed in full and give each row a bound; rows then meet
    through hot columns only partners heavy enough in them to get among their best.
    """
    cold = entries.join(hot, "col", "left_anti")
    warm = materialize(entries.join(hot, "col", "left_semi"), "hot-entries")
    pairs = materialize(_dots(cold, None, limit).select("a", "b", "n"), "cold-pairs")
    left, right = _sides(warm, ["row", "val"])
    looked_up = pairs.select("a", "b").join(left, F.col("a") == F.col("a_row")).drop("a_row").join(right.withColumnRenamed("b_row", "b"), ["b", "col"])
    hot_parts = looked_up.select("a", "b", (F.col("a_val") * F.col("b_val")).alias("n"))
    first = pairs.unionByName(hot_parts)
    if not exclude_self:
        # a row without other columns still is its own best partner
        own = entries.join(cold.select("row").distinct(), "row", "left_anti").groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("n"))
        first = first.unionByName(own.select(F.col("row").alias("a"), F.col("row").alias("b"), "n"))
    first = first.groupBy("a", "b").agg(F.sum("n").alias("similarity")).where(F.col("similarity") >= SMALLEST)
    if exclude_self:
        first = first.where(F.col("a") != F.col("b"))
    first = materialize(first, "first-pairs")

    asking, met = _asks(entries, hot, first, top)
    wanted = asking.select(
        F.col("row").alias("a_row"), F.col("val").alias("a_val"), F.col("col"), F.explode(F.sequence(F.lit(0), F.col("_reach"))).alias("_level"))
    levels = met.select("_level").distinct()
    key = F.concat_ws("|", "col", "_level").alias("_key")
    one = wanted.join(F.broadcast(levels), "_level", "left_semi").select(key, "a_row", "a_val")
    two = met.select(key, F.col("row").alias("b_row"), F.col("val").alias("b_val"))
    found = tile_join(one, two, "_key", "a_row", "b_row", limit).where(F.col("a_row") != F.col("b_row"))
    directed = found.groupBy(F.col("a_row").alias("row"), F.col("b_row").alias("other")).agg(F.sum(F.col("a_val") * F.col("b_val")).alias("similarity"))
    ends = pairs.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    new = directed.join(ends, (F.least("row", "other") == F.col("_a")) & (F.greatest("row", "other") == F.col("_b")), "left_anti")
    whole = first.select(F.col("a").alias("row"), F.col("b").alias("other"), "similarity")
    mirrored = first.where(F.col("a") != F.col("b")).select(F.col("b").alias("row"), F.col("a").alias("other"), "similarity")
    lists = whole.unionByName(mirrored).unionByName(new.where(F.col("similarity") >= SMALLEST))
    order = W.partitionBy("row").orderBy(F.desc("_key"), "other")
    ranked = lists.withColumn("_key", F.round("similarity", 9)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).drop("_key")


def row_similarity(
    entries: DataFrame,
    measure: str | Measure = "cosine",
    top: int = 100,
    exclude_self: bool = False,
    threshold: float = SMALLEST,
    **options,
) -> DataFrame:
    """(row, other, similarity, rank): the ``top`` most similar rows of each row."""
    rule = SIMILARITIES[measure] if isinstance(measure, str) else measure
    limit, types = options.get("limit", LIMIT), dict(entries.dtypes)
    if rule.array is not None and types["row"] in INTEGERS and types["col"] in INTEGERS:
        known = {n: options[n] for n in ("n_cols", "signed_mean") if n in options}
        found = _top_in_pieces(entries, rule, top, exclude_self, threshold, limit, **known)
        if found is not None:
            return found
    if threshold == SMALLEST and rule.prepare in ("unit", "centered"):
        carried = prepare_rows(entries, rule.prepare, options.get("signed_mean", False))
        hot = _hot_columns(carried, limit)
        if not hot.isEmpty():
            return _top_with_hot(carried, hot, top, exclude_self, limit)
        discard(carried)
    return top_pairs(row_pairs(entries, measure, threshold, **options), top, exclude_self)
