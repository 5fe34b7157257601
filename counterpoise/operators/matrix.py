"""Products of sparse matrices in (row, col, val) form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draw import u
from .tiles import LIMIT, tile_join


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def times(a: DataFrame, b: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A'B: rows of both matrices meet on their shared row index."""
    left = a.select(F.col("row").alias("_key"), F.col("col").alias("row"), F.col("val").alias("_a"))
    right = b.select(F.col("row").alias("_key"), F.col("col").alias("col"), F.col("val").alias("_b"))
    met = tile_join(left, right, "_key", "row", "col", limit)
    return met.groupBy("row", "col").agg(F.sum(F.col("_a") * F.col("_b")).alias("val"))


def mat_vec(a: DataFrame, v: DataFrame) -> DataFrame:
    """A v as (row, val); ``v`` is (col, val)."""
    vector = v.select(F.col("col").alias("_c"), F.col("val").alias("_v"))
    met = a.join(vector, F.col("col") == F.col("_c"))
    return met.groupBy("row").agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


def vec_mat(a: DataFrame, d: DataFrame) -> DataFrame:
    """A'd as (col, val); ``d`` is (row, val)."""
    vector = d.select(F.col("row").alias("_r"), F.col("val").alias("_d"))
    met = a.join(vector, F.col("row") == F.col("_r"))
    return met.groupBy("col").agg(F.sum(F.col("val") * F.col("_d")).alias("val"))


def at_a_v(a: DataFrame, v: DataFrame) -> DataFrame:
    """A'A v as (col, val)."""
    return vec_mat(a, mat_vec(a, v))


def omega(columns: DataFrame, k: int, seed="omega") -> DataFrame:
    """Random matrix with one row per column of A: hash draws in [-1/2, 1/2); nothing is stored."""
    spread = columns.select(F.col("col").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("col"))
    return spread.withColumn("val", u(seed, "row", "col") - 0.5)


def project(a: DataFrame, k: int, seed="omega") -> DataFrame:
    """A times the random matrix, as (row, col, val).

    The draws of a row's entries are computed in place, so nothing is joined.
    """
    spread = a.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.col("val") * (u(seed, "col", "_k") - 0.5)
    return spread.groupBy("row", F.col("_k").alias("col")).agg(F.sum(part).alias("val"))


def gram(y: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Y'Y."""
    return times(y, y, limit)


def scale(a: DataFrame, by: Column | float) -> DataFrame:
    return a.withColumn("val", F.col("val") * by)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("row", "col").agg(F.sum("val").alias("val"))
