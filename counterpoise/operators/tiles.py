"""Equi-joins whose hot keys are cut into tiles.

A key with many rows on both sides would put all their combinations into one task.  Rows
of such a key are dealt to chunks on either side, and every pair of chunks becomes a join
key of its own, so a task meets at most ``limit`` rows of each side per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.draw import u

LIMIT = 10_000


def tile_join(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, limit: int = LIMIT
) -> DataFrame:
    """Inner join on ``key``; the two sides may share no other column name."""
    def hot(side: DataFrame, name: str) -> DataFrame:
        counts = side.groupBy(F.col(key).alias(f"_{name}_key")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.where(F.col("_n") > limit).select(f"_{name}_key", F.ceil(F.col("_n") / limit).cast("int").alias(f"_{name}_tiles"))

    def dealt(side: DataFrame, own: str, other: str, id_col: str, own_hot: DataFrame, other_hot: DataFrame) -> DataFrame:
        sized = side.join(own_hot, F.col(key) == F.col(f"_{own}_key"), "left")
        sized = sized.join(other_hot, F.col(key) == F.col(f"_{other}_key"), "left")
        mine = F.floor(u("tile", id_col) * F.coalesce(F.col(f"_{own}_tiles"), F.lit(1))).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_{other}_tiles"), F.lit(1)) - 1))
        places = {own: mine.alias(f"_t_{own}"), other: met.alias(f"_t_{other}")}
        return sized.select(*[F.col(c).alias(c) for c in side.columns], places["l"], places["r"])

    left_hot, right_hot = hot(left, "l"), hot(right, "r")
    a = dealt(left, "l", "r", left_id, left_hot, right_hot)
    b = dealt(right, "r", "l", right_id, right_hot, left_hot)
    return a.join(b, [key, "_t_l", "_t_r"]).drop("_t_l", "_t_r")
