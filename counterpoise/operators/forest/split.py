"""Split quality of attributes, for all nodes and attributes at once.

A histogram holds one row per (keys, attr, value) with the target's statistics: a count
per class, or (n, sum, sum of squares) of a number.  Impurity is a function of those, so
classification and regression share everything else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ...functions.draw import u
from ...functions.info import xlogx
from ...session import materialize
from ..entropy import LN2
from ..prefix import ordered_chunks, running_sums

# Gains equal up to this many decimals count as tied; the first value then wins.
TIE_DIGITS = 9
WINDOW_VALUES = 1_000_000
# classes are columns of a histogram
MAX_CLASSES = 10_000


def _xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(n, out=np.zeros(n.shape), where=n > 0)


@dataclass(frozen=True)
class Target:
    """A split criterion: the statistics of the label and what is computed from them.

    ``classes`` holds the classes counted, or is None when moments of a number are kept.  The histogram
    pass, the split search and the tree builders use nothing but these methods, so another criterion is
    a subclass with its own ``impurity`` (and, if it needs other statistics, ``names``, ``aggregates``,
    ``size``, ``pure`` and ``answer``).  With ``impurity_of``, the same on arrays, the last levels are grown in one step.
    """

    label: str
    classes: tuple | None = None

    @property
    def names(self) -> list[str]:
        return ["s_n", "s_y", "s_yy"] if self.classes is None else [f"s_{i}" for i in range(len(self.classes))]

    def aggregates(self, weight: Column | None = None) -> list[Column]:
        w = F.lit(1) if weight is None else weight
        if self.classes is None:
            y = F.col(self.label).cast("double")
            parts = [w, w * y, w * y * y]
        else:
            parts = [F.when(F.col(self.label) == c, w).otherwise(0) for c in self.classes]
        return [F.sum(p).alias(n) for p, n in zip(parts, self.names)]

    def size(self, stats: list[Column]) -> Column:
        return stats[0] if self.classes is None else sum(stats[1:], stats[0])

    def impurity(self, stats: list[Column]) -> Column:
        """n times the entropy in bits, or the sum of squared deviations."""
        if self.classes is None:
            n, y, yy = stats
            return F.when(n > 0, yy - y * y / n).otherwise(F.lit(0.0))
        parts = [xlogx(c.cast("double")) for c in stats]
        return (xlogx(self.size(stats).cast("double")) - sum(parts[1:], parts[0])) / LN2

    def impurity_of(self, counts: np.ndarray) -> np.ndarray:
        """``impurity`` of arrays of class counts, classes last."""
        return (_xlogx(counts.sum(axis=-1)) - _xlogx(counts).sum(axis=-1)) / LN2

    @property
    def in_arrays(self) -> bool:
        """Whether classes are counted and ``impurity_of`` is the criterion that ``impurity`` is, with the other methods as they are here."""
        def owner(name: str) -> type:
            return next(k for k in type(self).__mro__ if name in vars(k))

        plain = all(owner(n) is Target for n in ("names", "aggregates", "size", "gain", "pure"))
        return self.classes is not None and plain and owner("impurity") is owner("impurity_of")

    def gain(self, whole: list[Column], parts: Column) -> Column:
        """Drop of impurity; classification counts it per row."""
        drop = self.impurity(whole) - parts
        return drop if self.classes is None else drop / self.size(whole)

    def spread(self, stats: list[Column]) -> Column:
        """Impurity per row."""
        return F.try_divide(self.impurity(stats), self.size(stats).cast("double"))

    def pure(self, stats: list[Column], least: Column) -> Column:
        """Whether a node needs no split: one class, or a variance below ``least``."""
        if self.classes is None:
            return self.spread(stats) < least
        return sum((F.when(s > 0, 1).otherwise(0) for s in stats[1:]), F.when(stats[0] > 0, 1).otherwise(0)) <= 1

    def answer(self, stats: list[Column], *tie: Column) -> Column:
        """Label of a leaf: the mean, or the majority with ties broken by a draw from ``tie``; null without rows."""
        if self.classes is None:
            return F.try_divide(stats[1], stats[0].cast("double")).cast("string")
        ballot = F.array(*[F.struct(s.alias("n"), u(*tie, F.lit(c)).alias("u"), F.lit(str(c)).alias("c")) for s, c in zip(stats, self.classes)])
        return F.when(self.size(stats) > 0, F.array_max(ballot)["c"])


class GiniTarget(Target):
    """Classes by the Gini index: n times the chance that two rows drawn from a node differ in class."""

    def impurity(self, stats: list[Column]) -> Column:
        squares = [c.cast("double") * c for c in stats]
        n = self.size(stats).cast("double")
        return F.when(n > 0, n - sum(squares[1:], squares[0]) / n).otherwise(F.lit(0.0))

    def impurity_of(self, counts: np.ndarray) -> np.ndarray:
        n = counts.sum(axis=-1)
        return n - np.divide((counts * counts).sum(axis=-1), n, out=np.zeros(n.shape), where=n > 0)


def class_target(df: DataFrame, label: str, kind: type[Target] = Target) -> Target:
    """Target with the classes found in the data, in order."""
    found = df.select(F.col(label).alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct values: not a class column")
    return kind(label, tuple(sorted(r["v"] for r in found)))


def _long(df: DataFrame, keys: list[str], attrs: list[str], kind: str, label: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast(kind).alias("value")) for a in attrs]))
    return df.select(*keys, label, pairs.alias("p")).select(*keys, label, "p.attr", "p.value")


def histogram(df: DataFrame, keys: list[str], attrs: list[str], kind: str, target: Target) -> DataFrame:
    """(keys, attr, value, statistics); counted per task before the shuffle."""
    rows = _long(df, keys, attrs, kind, target.label)
    return rows.groupBy(*keys, "attr", "value").agg(*target.aggregates())


def categorical_gains(hist: DataFrame, keys: list[str], target: Target) -> DataFrame:
    """Gain of the multiway split of each attribute: (keys, attr, gain)."""
    stats = [F.col(n) for n in target.names]
    groups = hist.groupBy(*keys, "attr").agg(
        *[F.sum(n).alias(n) for n in target.names], F.sum(target.impurity(stats)).alias("_within")
    )
    return groups.select(*keys, "attr", target.gain(stats, F.col("_within")).alias("gain"))


def numeric_candidates(hist: DataFrame, keys: list[str], target: Target, chunked: bool | None = None) -> DataFrame:
    """Every split ``x < value`` with its gain: adds ``previous``, left and whole statistics.

    Groups above ``WINDOW_VALUES`` distinct values are summed in chunks instead of one
    window per group.
    """
    group = [*keys, "attr"]
    totals = hist.groupBy(*group).agg(
        *[F.sum(n).alias(f"t_{n}") for n in target.names], F.count(F.lit(1)).alias("_values")
    )
    if chunked is None:
        largest = totals.agg(F.max("_values")).first()[0] or 0
        chunked = largest > WINDOW_VALUES
    if chunked:
        run = running_sums(
            ordered_chunks(hist, *group, "value"), group, ["_pos"],
            {f"l_{n}": F.col(n) for n in target.names}, previous={"previous": "value"},
        ).drop("_pos", "_chunk")
    else:
        order = W.partitionBy(*group).orderBy("value")
        upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
        run = hist.select(
            "*", *[F.sum(n).over(upto).alias(f"l_{n}") for n in target.names], F.lag("value").over(order).alias("previous")
        )
    # rows at the value itself belong to the right
    left = run.withColumns({f"l_{n}": F.col(f"l_{n}") - F.col(n) for n in target.names})
    joined = left.join(totals.drop("_values"), group)
    lo = [F.col(f"l_{n}") for n in target.names]
    whole = [F.col(f"t_{n}") for n in target.names]
    hi = [w - part for w, part in zip(whole, lo)]
    return joined.withColumn("gain", target.gain(whole, target.impurity(lo) + target.impurity(hi)))


def numeric_splits(
    hist: DataFrame, keys: list[str], target: Target, digits: int = TIE_DIGITS, chunked: bool | None = None
) -> DataFrame:
    """Best split of each numeric attribute: (keys, attr, split, gain, n_lo, n_hi, statistics).

    Classification splits at a value, regression halfway between neighbours (no split
    when there is only one value).
    """
    found = numeric_candidates(hist, keys, target, chunked)
    split = F.col("value") if target.classes is not None else (F.col("previous") + F.col("value")) / 2
    if target.classes is None:
        found = found.where(F.col("previous").isNotNull())
    best = F.min_by(
        F.struct(
            split.alias("split"), "gain", *[f"l_{n}" for n in target.names], *[f"t_{n}" for n in target.names]
        ),
        F.struct(-F.round("gain", digits), F.col("value")),
    )
    return found.groupBy(*keys, "attr").agg(best.alias("b")).select(*keys, "attr", "b.*")


def categorical_gain(
    df: DataFrame, attrs: list[str], label: str, keys: list[str] | None = None, criterion: type[Target] = Target
) -> DataFrame:
    """Information gain, or the gain of another criterion, of categorical attributes about a class label."""
    target = class_target(df, label, criterion)
    return categorical_gains(histogram(df, keys or [], attrs, "string", target), keys or [], target)


def numeric_split(
    df: DataFrame, attrs: list[str], label: str, keys: list[str] | None = None, criterion: type[Target] = Target
) -> DataFrame:
    """Best threshold of numeric attributes about a class label: (attr, split, gain)."""
    target = class_target(df, label, criterion)
    hist = materialize(histogram(df, keys or [], attrs, "double", target), "histogram")
    return numeric_splits(hist, keys or [], target).select(*(keys or []), "attr", "split", "gain")


def regression_categorical_gain(df: DataFrame, attrs: list[str], label: str, keys: list[str] | None = None) -> DataFrame:
    target = Target(label)
    return categorical_gains(histogram(df, keys or [], attrs, "string", target), keys or [], target)


def regression_numeric_split(
    df: DataFrame, attrs: list[str], label: str, keys: list[str] | None = None, digits: int = 3
) -> DataFrame:
    target = Target(label)
    hist = materialize(histogram(df, keys or [], attrs, "double", target), "histogram")
    return numeric_splits(hist, keys or [], target, digits).select(*(keys or []), "attr", "split", "gain")


def default_attributes(n_attrs: int, regression: bool) -> int:
    """Attributes tried at a node: floor(log2 e) + 1, or ceil(e / 3) for regression."""
    return -(-n_attrs // 3) if regression else n_attrs.bit_length()


def random_attributes(rows: DataFrame, keys: list[str], m: int, seed="attributes") -> DataFrame:
    """Of the (keys, attr) rows, m attributes per key at random; at most one row per attribute is ranked."""
    order = W.partitionBy(*keys).orderBy(u(seed, *keys, "attr"), "attr")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= m).drop("_k")
