"""Entropy and likelihood-ratio expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def xlogx(n: Column) -> Column:
    """n ln n, and 0 for n = 0."""
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))


def _spread(*counts: Column) -> Column:
    total = sum(counts[1:], counts[0])
    return xlogx(total) - sum((xlogx(c) for c in counts[1:]), xlogx(counts[0]))


def llr(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """Log-likelihood ratio of a 2x2 table (Dunning 1993)."""
    rows = _spread(k11 + k12, k21 + k22)
    columns = _spread(k11 + k21, k12 + k22)
    return 2.0 * F.greatest(F.lit(0.0), rows + columns - _spread(k11, k12, k21, k22))


def llr_array(k11: np.ndarray, k12: np.ndarray, k21: np.ndarray, k22: np.ndarray) -> np.ndarray:
    """The same ratio of numpy arrays."""
    def x(n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.where(n > 0, n, 1.0)), 0.0)

    total = x(k11 + k12 + k21 + k22)
    rows = total - (x(k11 + k12) + x(k21 + k22))
    columns = total - (x(k11 + k21) + x(k12 + k22))
    return 2.0 * np.maximum(0.0, rows + columns - (total - (x(k11) + x(k12) + x(k21) + x(k22))))


def llr_sql(k11: str, k12: str, k21: str, k22: str) -> str:
    """The same ratio as SQL text, for checks."""
    def x(n: str) -> str:
        return f"(case when ({n}) > 0 then ({n}) * ln({n}) else 0::DOUBLE end)"

    total = x(f"{k11} + {k12} + {k21} + {k22}")
    cells = " - ".join(x(k) for k in (k11, k12, k21, k22))
    rows = f"{total} - {x(f'{k11} + {k12}')} - {x(f'{k21} + {k22}')}"
    cols = f"{total} - {x(f'{k11} + {k21}')} - {x(f'{k12} + {k22}')}"
    return f"(2 * greatest(0::DOUBLE, ({rows}) + ({cols}) - ({total} - {cells})))"
