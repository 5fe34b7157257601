"""Counts, sums and moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.draw import u


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def sum_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"))


def vector_sum(entries: DataFrame, key: str) -> DataFrame:
    """Element-wise sum of vectors in long form (key, col, val)."""
    return entries.groupBy(key, "col").agg(F.sum("val").alias("val"))


def merge_vectors(parts: DataFrame, key: str, version: str) -> DataFrame:
    """Merge partial vectors; where two hold the same element the later version wins."""
    return parts.groupBy(key, "col").agg(F.max_by("val", version).alias("val"))


def pack_vectors(entries: DataFrame, key: str) -> DataFrame:
    """Long form to one map column per key; the size of a row is that of its vector."""
    return entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("vector"))


def unpack_vectors(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.explode("vector").alias("col", "val"))


def partition_frequencies(df: DataFrame, part: str, label: str) -> DataFrame:
    """Rows of each class in each partition, zero counts included."""
    counts = df.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
    parts, names = counts.select(part).distinct(), counts.agg(F.collect_set(label)).scalar()
    grid = parts.withColumn(label, F.explode(names))
    return grid.join(counts, [part, label], "left").select(part, label, F.coalesce("n", F.lit(0)).alias("n"))


def majority_label(df: DataFrame, keys: list[str], label: str, seed="majority") -> DataFrame:
    """Most frequent label per key; ties are broken by a seeded draw per (key, label)."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(label, F.struct(F.col("n"), u(seed, *keys, label)))
    return counts.groupBy(*keys).agg(best.alias("majority"), F.max("n").alias("n"), F.sum("n").alias("total"))


def label_uniformity(df: DataFrame, keys: list[str], label: str, columns: list[str]) -> DataFrame:
    """Per key: are all labels identical, are all rows identical in ``columns``.

    Equality shows in minimum and maximum, so no distinct set is kept.
    """
    same_rows = F.lit(True)
    for c in columns:
        same_rows = same_rows & F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count(F.lit(1))))
    return df.groupBy(*keys).agg(
        (F.min(label) == F.max(label)).cast("int").alias("same_label"), same_rows.cast("int").alias("same_rows")
    )


def distinct_values(df: DataFrame, attr: str) -> DataFrame:
    return df.select(attr).distinct()


def variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample variance and deviation."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("stddev"),
    )


def ignore_marker(df: DataFrame, key: str) -> DataFrame:
    """Drop rows under the marker key -1, which carry totals rather than data."""
    return df.where(F.col(key) != -1)


def variance_given_mean(df: DataFrame, keys: list[str], value: str, mean: float) -> DataFrame:
    """Variance and deviation around a given mean: (sum of squares - n mean^2) / (n - 1)."""
    n = F.count(value)
    var = (F.sum(F.col(value) * F.col(value)) - n * mean * mean) / (n - 1)
    return df.groupBy(*keys).agg(n.alias("n"), var.alias("variance"), F.sqrt(var).alias("stddev"))


def column_means(entries: DataFrame, n_rows=None) -> DataFrame:
    """Mean of each matrix column; absent entries count as zero."""
    if n_rows is None:
        n_rows = entries.select("row").distinct().agg(F.count(F.lit(1))).scalar()
    return entries.groupBy("col").agg(F.sum("val").alias("_s")).select("col", (F.col("_s") / n_rows).alias("mean"))
