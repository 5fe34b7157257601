"""Distances and kernels between array<double> columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Distances equal up to this many decimals count as tied.
TIE_DIGITS = 9


def same_size(a: Column, b: Column) -> Column:
    """``a``, or an error when the two vectors differ in length."""
    message = F.concat(F.lit("vector sizes differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(message).cast("array<double>")).otherwise(a)


def checked(measure: Callable[..., Column]) -> Callable[..., Column]:
    """The measure, with an error where vectors, weights or matrix differ in size; null stays null."""

    def run(a: Column, b: Column, *more, **options) -> Column:
        for value in (*more, *options.values()):
            if isinstance(value, Column):
                b = same_size(b, value)
        return measure(same_size(a, b), b, *more, **options)

    return run


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def sq_euclidean_by_norms(a: Column, b: Column, a_sq: Column, b_sq: Column) -> Column:
    """Squared distance from squared norms known beforehand."""
    return F.greatest(a_sq - 2.0 * dot(a, b) + b_sq, F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, exponent: float = 3.0) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(exponent)))), F.lit(1.0 / exponent))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 when dot product and denominator are both 0."""
    product = dot(a, b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    safe = F.greatest(norms, product)
    return F.when((product == 0) & (safe == 0), F.lit(1.0)).otherwise(1.0 - product / safe)


def tanimoto(a: Column, b: Column, weights: Column | None = None) -> Column:
    def weighted(x: Column) -> Column:
        return x if weights is None else F.zip_with(x, weights, lambda v, w: v * w)

    ab, aa, bb = dot(weighted(a), b), dot(weighted(a), a), dot(weighted(b), b)
    # rounding must not push the ratio above 1
    denominator = F.greatest(aa + bb - ab, ab)
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(1.0 - ab / denominator)


def weighted_euclidean(a: Column, b: Column, weights: Column) -> Column:
    return F.sqrt(total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), weights, _times)))


def weighted_manhattan(a: Column, b: Column, weights: Column) -> Column:
    return total(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), weights, _times))


def _times(x: Column, w: Column) -> Column:
    return x * F.coalesce(w, F.lit(1.0))


def mahalanobis(a: Column, b: Column, inverse: Column) -> Column:
    """sqrt((a-b)' M (a-b)); ``inverse`` is the inverse covariance as an array of rows."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    projected = F.transform(inverse, lambda row: dot(row, gap))
    return F.sqrt(dot(gap, projected))


def mahalanobis_to_mean(a: Column, mean: Column, inverse: Column) -> Column:
    """Distance of a vector to the mean of its distribution; sizes must agree."""
    return MEASURES["mahalanobis"](a, mean, inverse)


MEASURES: dict[str, Callable[..., Column]] = {
    "sq_euclidean": checked(sq_euclidean),
    "euclidean": checked(euclidean),
    "manhattan": checked(manhattan),
    "chebyshev": checked(chebyshev),
    "minkowski": checked(minkowski),
    "cosine": checked(cosine),
    "tanimoto": checked(tanimoto),
    "weighted_euclidean": checked(weighted_euclidean),
    "weighted_manhattan": checked(weighted_manhattan),
    "mahalanobis": checked(mahalanobis),
}


def normal_kernel(distance: Column, bandwidth: float) -> Column:
    """Derivative of the normal profile: the normal density with deviation ``bandwidth``."""
    return F.exp(-distance * distance / (2.0 * bandwidth * bandwidth)) / (bandwidth * math.sqrt(2.0 * math.pi))


def triangular_kernel(distance: Column, bandwidth: float) -> Column:
    """Derivative of the triangular profile: 1 inside the bandwidth, else 0."""
    return F.when(distance < bandwidth, F.lit(1.0)).otherwise(F.lit(0.0))
