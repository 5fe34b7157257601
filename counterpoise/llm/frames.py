"""Joins that cannot clash with the names of a caller's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns as one struct ``row``, beside the named ones."""
    own = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.struct(*own).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """Columns of ``row`` again; ``replaced`` ones take the given value or are added at the end."""
    kept = [replaced[c].alias(c) if c in replaced else F.col("row")[c].alias(c) for c in columns]
    added = [v.alias(n) for n, v in replaced.items() if n not in columns]
    return df.select(*kept, *added)


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame, gone: str) -> DataFrame:
    """Rows whose id is not among ``ids``; rows with a null id stay."""
    left = packed(docs, id=F.col(id_col))
    right = ids.where(F.col(gone).isNotNull()).select(F.col(gone).alias("gone")).distinct()
    return unpacked(left.join(right, F.col("id") == F.col("gone"), "left_anti"), docs.columns)
