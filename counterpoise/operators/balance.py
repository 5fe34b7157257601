"""Class balancing by row replication and row removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draw import below, u


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, which class is largest and smallest (ties: first), and rows each class lacks."""
    counts = class_counts(df, label)
    top = counts.agg(F.min(F.struct(-F.col("n"), F.col(label)))).scalar()
    low = counts.agg(F.min(F.struct(F.col("n"), F.col(label)))).scalar()
    return counts.select(
        label,
        "n",
        (F.col(label) == top[label]).cast("int").alias("is_majority"),
        (F.col(label) == low[label]).cast("int").alias("is_minority"),
        (-top["col1"] - F.col("n")).alias("lack"),
    )


def _sizes(df: DataFrame, label: str, npos: int | None, nneg: int | None) -> tuple[Column, Column, Column]:
    """(larger size, smaller size, one of the class names) as scalar columns; sizes may be given."""
    counts = class_counts(df, label)
    if npos is not None and nneg is not None:
        return F.lit(max(npos, nneg)), F.lit(min(npos, nneg)), None
    summary = counts.agg(
        F.struct(
            F.max("n").alias("major"),
            F.min("n").alias("minor"),
            F.min(F.struct((-F.col("n")).alias("order"), F.col(label).alias("name")))["name"].alias("major_name"),
            F.min(F.struct(F.col("n").alias("order"), F.col(label).alias("name")))["name"].alias("minor_name"),
        )
    ).scalar()
    return summary["major"], summary["minor"], summary


def _same(label: str, name: Column) -> Column:
    return F.lower(F.col(label).cast("string")) == F.lower(name.cast("string"))


def random_oversample(
    df: DataFrame,
    label: str,
    ids: list[str],
    negclass: str | None = None,
    npos: int | None = None,
    nneg: int | None = None,
    fractional: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Replicate every row outside the majority class.

    The factor is ``floor(majority / minority)``.  A majority row appears once under a
    random ``copy_key``; every other row appears under each key.  With ``fractional`` a
    row outside the majority appears ``floor(f)`` or ``floor(f) + 1`` times, the latter
    with the probability of the fraction of ``f = majority / minority``.

    Rows are only read and exploded: no shuffle beyond the class counts.  Rows without a
    label are dropped.
    """
    df = df.where(F.col(label).isNotNull())
    major, minor, summary = _sizes(df, label, npos, nneg)
    if negclass is None and summary is None:
        raise ValueError("negclass is needed when class sizes are given")
    is_negative = _same(label, F.lit(negclass) if negclass is not None else summary["major_name"])
    whole = F.floor(major / minor)
    if fractional:
        extra = (u(f"{seed}-extra", *ids) < major / minor - whole).cast("long")
        copies = F.sequence(F.lit(0).cast("long"), whole + extra - 1)
        keys = F.when(is_negative, F.array(F.lit(0).cast("long"))).otherwise(copies)
    else:
        keys = F.when(is_negative, F.array(below(u(f"{seed}-copy", *ids), whole))).otherwise(
            F.sequence(F.lit(0).cast("long"), whole - 1)
        )
    return df.withColumn("copy_key", F.explode(keys))


def random_undersample(
    df: DataFrame,
    label: str,
    ids: list[str],
    posclass: str | None = None,
    npos: int | None = None,
    nneg: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Keep every positive row and each other row with probability ``minority / majority``.

    Rows without a label are dropped.
    """
    df = df.where(F.col(label).isNotNull())
    major, minor, summary = _sizes(df, label, npos, nneg)
    if posclass is None and summary is None:
        raise ValueError("posclass is needed when class sizes are given")
    positive = _same(label, F.lit(posclass) if posclass is not None else summary["minor_name"])
    return df.where(positive | (u(f"{seed}-keep", *ids) < minor / major))


def undersample_fast(df: DataFrame, label: str, fractions: dict, seed: int = 0) -> DataFrame:
    """Free-running variant: one pass, no repeatable draw per row."""
    return df.sampleBy(label, fractions, seed)
