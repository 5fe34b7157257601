"""Entropy, conditional entropy and information gain of (key, value) pairs.

Everything is derived from the pair counts, so the data is aggregated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.info import xlogx

LN2 = 0.6931471805599453


def entropy_of(counts: Column) -> Column:
    """Aggregate: entropy in bits of a column of counts."""
    n = F.sum(counts)
    return (F.ln(n) - F.sum(xlogx(counts)) / n) / LN2


def pair_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Entropy in bits of one column: one row (entropy)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(entropy_of(F.col("n")).alias("entropy"))


def specific_conditional_entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's share of the conditional entropy, already weighted by the key's frequency."""
    counts = pair_counts(df, key, value)
    n = counts.agg(F.sum("n")).scalar()
    per_key = counts.groupBy(key).agg(
        F.sum("n").cast("double").alias("_s"), F.sum(xlogx(F.col("n"))).alias("_c")
    )
    return per_key.select(key, ((xlogx(F.col("_s")) - F.col("_c")) / (n * LN2)).alias("entropy"))


def conditional_entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """H(value given key)."""
    return specific_conditional_entropy(df, key, value).agg(F.sum("entropy").alias("entropy"))


def information_gain(df: DataFrame, key: str, value: str, split_info: str = "value") -> DataFrame:
    """One row: entropy of value, conditional entropy, gain, and gain ratio.

    The ratio divides by H(value); ``split_info='key'`` divides by H(key) as textbooks do.
    """
    counts = pair_counts(df, key, value)
    by_key = counts.groupBy(key).agg(F.sum("n").alias("n"))
    by_value = counts.groupBy(value).agg(F.sum("n").alias("n"))
    h_key = by_key.agg(entropy_of(F.col("n"))).scalar()
    h_value = by_value.agg(entropy_of(F.col("n"))).scalar()
    within = counts.agg(F.sum(xlogx(F.col("n")))).scalar()
    base = by_key.agg(F.sum(xlogx(F.col("n"))).alias("_k"), F.sum("n").alias("_n"))
    gained = base.select(
        h_value.alias("entropy"), ((F.col("_k") - within) / (F.col("_n") * LN2)).alias("conditional"), h_key.alias("_hk")
    ).withColumn("gain", F.col("entropy") - F.col("conditional"))
    divisor = F.col("entropy") if split_info == "value" else F.col("_hk")
    return gained.withColumn("ratio", F.col("gain") / divisor).drop("_hk")
