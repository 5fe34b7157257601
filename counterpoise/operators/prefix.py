"""Running sums and ranks whose groups may be far larger than one task.

A window over a whole group puts that group into one task.  Here the order is cut into
chunks; running sums inside a chunk are added to the totals of the chunks before it.
Only chunk totals (one row per chunk and key) meet in the second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.draw import u
from ..session import materialize


def ordered_chunks(df: DataFrame, *order) -> DataFrame:
    """Sort by ``order`` and add ``_chunk`` (range partition) and ``_pos`` (global position).

    Range partitioning samples the composite sort key, so one value that holds a third of
    the rows is split as long as the key has a unique tail.  The result is written, which
    pins chunk limits for every later use.
    """
    positioned = df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id())
    return materialize(positioned.withColumn("_chunk", F.shiftright("_pos", 33).cast("int")), "ordered")


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    chunk: str = "_chunk",
    previous: dict[str, str] | None = None,
    written: bool = False,
) -> DataFrame:
    """Add inclusive running sums per ``keys`` along ``order``.

    ``chunk`` is an integer column that never decreases along ``order``.  ``order`` must
    be unique inside (keys, chunk).  ``previous`` adds columns with the row before's value.
    ``written`` writes the totals first: their size is known then, and a few never make Spark shuffle the rows for them.
    """
    previous = previous or {}
    local = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    names = {n: f"_local_{n}" for n in sums}
    step = W.partitionBy(*keys, chunk).orderBy(*order)
    inner = df.select(
        "*",
        *[F.sum(c).over(local).alias(names[n]) for n, c in sums.items()],
        *[F.lag(c).over(step).alias(f"_local_{n}") for n, c in previous.items()],
    )

    totals = df.groupBy(*keys, chunk).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.struct(*order)).alias(f"_t_{n}") for n, c in previous.items()],
    )
    ahead = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(chunk)
    before, ahead = ahead, ahead.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(chunk).alias("_k_chunk"),
        *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.lag(f"_t_{n}").over(before).alias(f"_o_{n}") for n in previous],
    )
    offsets = materialize(offsets, "chunk-totals") if written else offsets
    on = F.col(chunk) == F.col("_k_chunk")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = inner.join(offsets, on)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(names[n]) + F.col(f"_o_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_local_{n}", f"_o_{n}").alias(n) for n in previous],
    )


def shuffled_rank(
    df: DataFrame,
    ids: list[str],
    keys: list[str] | None = None,
    seed="rank",
    out: str = "rank",
    chunks: int | None = None,
    draw: str | None = None,
    written: bool = False,
) -> DataFrame:
    """Dense 0-based rank of rows in hash order, per ``keys``.

    The order is (draw, ids).  The draw is even, so equal slices of [0, 1) are even chunks
    and no sort of the whole table is needed.
    """
    keys = keys or []
    if chunks is None:
        chunks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.withColumn("_u", F.col(draw) if draw else u(seed, *ids))
    drawn = drawn.withColumn("_slice", F.floor(F.col("_u") * chunks).cast("int"))
    ranked = running_sums(drawn, keys, ["_u", *ids], {out: F.lit(1)}, chunk="_slice", written=written)
    return ranked.withColumn(out, F.col(out) - 1).drop("_u", "_slice")


def sorted_rank(df: DataFrame, order: list[str], keys: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Dense 0-based rank of rows in column order, per ``keys``; ``order`` must be unique per key."""
    keys = keys or []
    ranked = running_sums(ordered_chunks(df, *keys, *order), keys, ["_pos"], {out: F.lit(1)})
    return ranked.withColumn(out, F.col(out) - 1).drop("_pos", "_chunk")
