"""Seeded random columns.

Every draw is a hash of (seed, row key), so a row gets the same draw whatever the
partitioning, after a retry on another executor, and in plain SQL.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F


def _key(part) -> Column:
    return part if isinstance(part, Column) else F.col(part)


def hash32(*parts: Column) -> Column:
    """Unsigned 32-bit hash of the '|'-joined parts, as a long."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash52(*parts: Column) -> Column:
    """Unsigned 52-bit hash of the '|'-joined parts, as a long."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def u(seed, *keys) -> Column:
    """Uniform draw in [0, 1) for each row key; 52 bits reach every place of a table of any size."""
    return hash52(F.lit(str(seed)), *[_key(k) for k in keys]) / F.lit(float(1 << 52))


def u_value(*parts) -> float:
    """The draw of ``u`` for values outside of columns."""
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:13], 16) / float(1 << 52)


def u_open(seed, *keys) -> Column:
    """Uniform draw in (0, 1)."""
    return (hash52(F.lit(str(seed)), *[_key(k) for k in keys]) + F.lit(0.5)) / F.lit(float(1 << 52))


def u_closed(seed, *keys) -> Column:
    """Uniform draw in [0, 1]."""
    return hash52(F.lit(str(seed)), *[_key(k) for k in keys]) / F.lit(float((1 << 52) - 1))


def integer(seed, low: int, high: int, *keys, closed_low: bool = True, closed_high: bool = False) -> Column:
    """Uniform integer between ``low`` and ``high``; each end open or closed."""
    first = low if closed_low else low + 1
    last = high if closed_high else high - 1
    return (F.floor(u(seed, *keys) * (last - first + 1)) + first).cast("long")


def below(draw: Column, n) -> Column:
    """Integer in [0, n) from a draw in [0, 1)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(draw * n).cast("long")


def gaussian(seed, *keys, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Normal draw by the Box-Muller formula."""
    radius = F.sqrt(-2.0 * F.log(u_open(f"{seed}r", *keys)))
    return mean + sd * radius * F.cos(2.0 * math.pi * u(f"{seed}a", *keys))


def triangular(seed, low: float, mode: float, high: float, *keys) -> Column:
    """Draw from the triangle over [low, high] with its peak at ``mode``."""
    if low == high:
        return F.lit(float(mode))
    rise, base = mode - low, high - low
    side, height = u(f"{seed}s", *keys), F.sqrt(u(f"{seed}h", *keys))
    return F.when(side <= rise / base, rise * height + low).otherwise(base - (base - rise) * height + low)


def bucket(seed, partitions, *keys) -> Column:
    """Even hash bucket of a row, 0..partitions-1; stands for an input split."""
    return below(u(seed, *keys), partitions).cast("int")
