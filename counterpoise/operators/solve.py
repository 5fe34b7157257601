"""Iterative solvers: every product is a Spark job.

The solvers take either form of vector.  Vectors of any length are tables of blocks with a
``BlockMatrix`` (operators/blocks.py): only scalars and k x k matrices reach the driver.  For matrices
of few columns (``SparseMatrix`` up to ``LOCAL_COLUMNS``, ``DenseMatrix`` up to ``LOCAL_DENSE``) a vector is an
array in the driver, which saves a job for each sum; rows and entries are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, materialize
from . import blocks, matrix
from .aggregate import column_means
from .blocks import BlockMatrix

LOCAL_COLUMNS = 5_000_000
LOCAL_DENSE = 2_000
BROADCAST_COLUMNS = 1_000_000


class SparseMatrix:
    """Matrix in (row, col, val) form with columns 0..n_cols-1."""

    def __init__(self, entries: DataFrame, n_cols: int | None = None):
        self.entries = materialize(entries.select("row", "col", F.col("val").cast("double").alias("val")), "matrix")
        self.n_cols = n_cols if n_cols is not None else int(self.entries.agg(F.max("col")).first()[0]) + 1
        _check(self.n_cols, LOCAL_COLUMNS)

    def _vector(self, v: np.ndarray) -> DataFrame:
        spark = self.entries.sparkSession
        frame = spark.createDataFrame(pd.DataFrame({"col": np.arange(len(v)), "val": v}))
        # a frame made in the driver has no size estimate: without the hint the matrix would be shuffled
        return F.broadcast(frame) if len(v) <= BROADCAST_COLUMNS else frame

    def _gathered(self, found: DataFrame) -> np.ndarray:
        out = np.zeros(self.n_cols)
        part = found.toPandas()
        out[part.iloc[:, 0].to_numpy(dtype=int)] = part["val"].to_numpy()
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """A v for a square matrix."""
        return self._gathered(matrix.mat_vec(self.entries, self._vector(v)))

    def times_squared(self, v: np.ndarray) -> np.ndarray:
        """A'A v."""
        return self._gathered(matrix.at_a_v(self.entries, self._vector(v)))


class DenseMatrix:
    """Rows as array columns of bounded length; each product is one pass without a shuffle of rows."""

    def __init__(self, vectors: DataFrame, vec: str):
        self.vectors = materialize(vectors.select(F.col(vec).alias("vec")), "matrix")
        self.n_cols = int(self.vectors.agg(F.max(F.size("vec"))).first()[0])
        _check(self.n_cols, LOCAL_DENSE)

    def _sum_over_batches(self, product) -> np.ndarray:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for part in parts:
                if len(part):
                    value = product(np.array(part["vec"].tolist(), dtype=float))
                    total = value if total is None else total + value
            if total is not None:
                yield pd.DataFrame({"pos": np.arange(len(total)), "val": total})

        cells = self.vectors.mapInPandas(run, "pos long, val double")
        found = cells.groupBy("pos").agg(F.sum("val").alias("val")).toPandas().sort_values("pos")
        return found["val"].to_numpy()

    def times_squared(self, v: np.ndarray) -> np.ndarray:
        return self._sum_over_batches(lambda x: x.T @ (x @ v))

    def gram(self) -> np.ndarray:
        """A'A, of columns squared."""
        return self._sum_over_batches(lambda x: (x.T @ x).ravel()).reshape(self.n_cols, self.n_cols)

    def column_sums(self) -> np.ndarray:
        return self._sum_over_batches(lambda x: x.sum(axis=0))


def _check(n: int, limit: int) -> None:
    if n > limit:
        raise ValueError(f"{n} columns: above {limit} use a BlockMatrix, whose vectors are tables")


def covariance(vectors: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance) of array rows."""
    dense = DenseMatrix(vectors, vec)
    n = dense.vectors.count()
    mean = dense.column_sums() / n
    return mean, (dense.gram() - n * np.outer(mean, mean)) / (n - 1)


def inverse_covariance(cov: np.ndarray) -> np.ndarray:
    """Inverse through the singular values; a singular covariance is an error."""
    u, s, vt = np.linalg.svd(cov)
    if s[-1] <= s[0] * 1e-12:
        raise ValueError("covariance is singular")
    return (vt.T / s) @ u.T


def array_literal(values: np.ndarray) -> Column:
    """Small vector or matrix as an array column."""
    if values.ndim == 1:
        return F.lit([float(x) for x in values])
    return F.array(*[array_literal(row) for row in values])


class _Arrays:
    """Vectors in the driver."""

    def product(self, a, v, symmetric: bool):
        return a.times(v) if symmetric else a.times_squared(v)

    def dot(self, x, y) -> float:
        return float(x @ y)

    def combined(self, *terms):
        return sum(f * v for f, v in terms)

    def free(self, v) -> None:
        pass


class _Tables(_Arrays):
    """Vectors as tables of blocks."""

    def product(self, a: BlockMatrix, v: DataFrame, symmetric: bool) -> DataFrame:
        first = materialize(a.times(v), "vector")
        if symmetric:
            return first
        second = materialize(a.times(first, transposed=True), "vector")
        discard(first)
        return second

    def dot(self, x: DataFrame, y: DataFrame) -> float:
        return float(blocks.inner(x, y)[0, 0])

    def combined(self, *terms) -> DataFrame:
        return blocks.combined(list(terms))

    def free(self, v: DataFrame) -> None:
        discard(v)


def conjugate_gradient(
    a, b, lam: float = 0.0, symmetric: bool = False, max_iter: int | None = None, tol: float = 1e-9
):
    """x with (A + lam I) x = b for a symmetric A, else (A'A + lam I) x = b.

    ``b`` is an array, or with a ``BlockMatrix`` a table of blocks; ``x`` comes in the same form.
    Tables need ``max_iter``.
    """
    space = _Tables() if isinstance(b, DataFrame) else _Arrays()
    r = space.combined((1.0, b if isinstance(b, DataFrame) else b.astype(float)))
    p, rr, x = r, space.dot(r, r), None
    stop = tol * tol * max(rr, 1e-300)
    for _ in range(max_iter or a.n_cols):
        if rr <= stop:
            break
        ap = space.product(a, p, symmetric)
        full = space.combined((1.0, ap), (lam, p))
        step = rr / space.dot(p, full)
        x, old = space.combined((step, p)) if x is None else space.combined((1.0, x), (step, p)), x
        r, old_r = space.combined((1.0, r), (-step, full)), r
        now = space.dot(r, r)
        p, old_p = space.combined((1.0, r), (now / rr, p)), p
        for gone in (ap, full, *([old] if old is not None else []), old_p, *([old_r] if old_r is not old_p else [])):
            space.free(gone)
        rr = now
    return x if x is not None else space.combined((0.0, b))


@dataclass
class LanczosState:
    """Basis and recurrence numbers; saved tables let a run go on after a stop."""

    basis: list[np.ndarray]
    alpha: list[float]
    beta: list[float]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in v], *self._numbers(i)) for i, v in enumerate(self.basis)]
        spark.createDataFrame(rows, "i int, v array<double>, alpha double, beta double").write.mode("overwrite").parquet(path)

    def _numbers(self, i: int) -> tuple[float | None, float | None]:
        return (self.alpha[i] if i < len(self.alpha) else None, self.beta[i] if i < len(self.beta) else None)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanczosState:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.i)
        return cls(
            [np.array(r.v) for r in rows], [r.alpha for r in rows if r.alpha is not None],
            [r.beta for r in rows if r.beta is not None],
        )


def lanczos(
    a, rank: int, symmetric: bool = False, state: LanczosState | None = None, save_to: str | None = None,
    spark: SparkSession | None = None,
):
    """(eigenvalues descending, eigenvectors, state) after ``rank`` products.

    Eigenvalues belong to A when symmetric, else to A'A.  The start vector has equal numbers; each new
    vector is made orthogonal to all before it.  Eigenvectors are the rows of an array, or for a
    ``BlockMatrix`` the columns of a table of blocks as wide as there are eigenvalues.
    """
    tables = isinstance(a, BlockMatrix)
    space = _Tables() if tables else _Arrays()
    if tables:
        ones = materialize(a.columns(), "vector")
        n = int(round(space.dot(ones, ones)))
        start = space.combined((1.0 / np.sqrt(n), ones))
    else:
        n = a.n_cols
        start = np.full(n, 1.0 / np.sqrt(n))
    state = state or LanczosState([start], [], [])
    while len(state.alpha) < min(rank, n):
        v = state.basis[len(state.alpha)]
        w = space.product(a, v, symmetric)
        state.alpha.append(space.dot(w, v))
        for _ in range(2):
            if tables:
                before, shares = w, blocks.dots(state.basis, w)
                w = space.combined((1.0, w), *[(-s, x) for s, x in zip(shares, state.basis)])
                space.free(before)
            else:
                known = np.array(state.basis)
                w = w - known.T @ (known @ w)
        beta = float(np.sqrt(space.dot(w, w)))
        if beta < 1e-10 * max(1.0, abs(state.alpha[0])) or len(state.basis) >= n:
            break
        state.beta.append(beta)
        state.basis.append(space.combined((1.0 / beta, w)))
        if save_to is not None:
            state.save(spark, save_to)
    k = len(state.alpha)
    off = state.beta[: k - 1]
    values, inner = np.linalg.eigh(np.diag(state.alpha) + np.diag(off, 1) + np.diag(off, -1))
    order = np.argsort(values)[::-1]
    if not tables:
        return values[order], inner[:, order].T @ np.array(state.basis[:k]), state
    wide = [blocks.turned(v, 1, inner[i : i + 1, order]) for i, v in enumerate(state.basis[:k])]
    out = wide[0]
    for part in wide[1:]:
        out = out.union(part)
    return values[order], materialize(blocks.summed(out, k), "eigenvectors"), state


def verify_eigenvectors(
    a, vectors, max_error: float = 0.05, min_eigenvalue: float = 0.0, max_keep: int | None = None,
    symmetric: bool = False, width: int | None = None,
) -> list[tuple[int, float, float]]:
    """(index, eigenvalue, error) of vectors the matrix only stretches, in index order.

    ``vectors`` are rows of an array, or for a ``BlockMatrix`` the ``width`` columns of a table.
    """
    if isinstance(a, BlockMatrix):
        found = materialize(a.times(vectors, width), "products")
        if not symmetric:
            found = materialize(a.times(found, width, transposed=True), "products")
        lengths, sizes, dots = (np.diag(blocks.inner(x, y, width, width)) for x, y in ((vectors, vectors), (found, found), (vectors, found)))
        numbers = [(float(np.sqrt(s)), float(np.sqrt(v)), float(d)) for s, v, d in zip(sizes, lengths, dots)]
    else:
        product = a.times if symmetric else a.times_squared
        numbers = []
        for v in vectors:
            w = product(v)
            numbers.append((float(np.linalg.norm(w)), float(np.linalg.norm(v)), float(v @ w)))
    kept = []
    for i, (size, length, dot) in enumerate(numbers):
        value = size / length if length else 0.0
        error = abs(1.0 - dot / (size * length)) if size and length else 1.0
        if error < max_error and value > min_eigenvalue:
            kept.append((i, value, error))
    return kept[:max_keep] if max_keep is not None else kept


# stochastic SVD


def _turn(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Every row vector times a small matrix."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                part["vec"] = list(np.array(part["vec"].tolist(), dtype=float) @ by)
            yield part

    return vectors.mapInPandas(run, f"{key} long, vec array<double>")


@dataclass
class Decomposition:
    """A ~ U diag(sigma) V'; ``q_blocks`` and ``b_blocks`` hold the rows of Q and of B', ``rank`` wide."""

    sigma: np.ndarray
    q_blocks: DataFrame
    b_blocks: DataFrame
    inner: np.ndarray
    rank: int

    @property
    def q(self) -> DataFrame:
        """(row, vec): rows of Q."""
        return blocks.unpack(self.q_blocks, "row", self.rank)

    def values(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.sigma)], "i int, sigma double")

    def _scale(self, scaling: str) -> np.ndarray:
        return {"none": np.ones_like(self.sigma), "sigma": self.sigma, "half": np.sqrt(self.sigma)}[scaling]

    def u(self, scaling: str = "none") -> DataFrame:
        """(row, vec): rows of U, of U Sigma, or of U Sigma^(1/2)."""
        return blocks.unpack(self.q_blocks, "row", self.rank, self.inner * self._scale(scaling))

    def v(self, scaling: str = "none") -> DataFrame:
        """(col, vec): rows of V, of V Sigma, or of V Sigma^(1/2)."""
        inverse = np.divide(1.0, self.sigma, out=np.zeros_like(self.sigma), where=self.sigma > self.sigma[0] * 1e-13)
        return blocks.unpack(self.b_blocks, "col", self.rank, self.inner * inverse * self._scale(scaling))

    def reconstruct(self) -> DataFrame:
        """(row, vec): rows of U Sigma V' for matrices of few columns; no rows are paired."""
        columns = self.v("sigma").agg(F.max("col")).first()[0] + 1
        _check(columns, LOCAL_DENSE)
        v = np.zeros((columns, len(self.sigma)))
        for r in self.v("sigma").collect():
            v[r["col"]] = r["vec"]
        return _turn(self.u(), "row", v.T)


def weighted(entries: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(col, vec): A' times the vectors of (row, vec); entries are never paired with each other."""
    found = BlockMatrix(entries).times(blocks.pack(vectors, "row"), width, transposed=True)
    return blocks.unpack(found, "col", width)


def stochastic_svd(
    entries: DataFrame, k: int, p: int = 15, q: int = 0, center: bool = False, means: DataFrame | None = None,
    seed="omega",
) -> Decomposition:
    """Rank-k decomposition by random projection with oversampling p and q power iterations.

    Bases come from QR factors, merged as a tree, so singular values down to about 1e-13 of the largest
    are found; ``rank`` tells how many directions have weight.  ``center`` subtracts the column means
    (given as (col, mean) or computed) without filling the zeros of the matrix: only small vectors
    and rows of Q and B' change.
    """
    a = BlockMatrix(entries)
    width = k + p
    mean = None
    if center:
        if means is None:
            means = column_means(entries)
        mean = materialize(blocks.pack(means.select("col", F.array("mean").alias("vec")), "col"), "means")

    def shifted(y: DataFrame, by: np.ndarray, size: int) -> DataFrame:
        """Rows of a row-side product less the same small vector."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(b, i, (np.frombuffer(v, float).reshape(-1, size) - by).tobytes()) for b, i, v in zip(batch["block"], batch["ids"], batch["vals"])]
                if rows:
                    yield pd.DataFrame(rows, columns=["block", "ids", "vals"])

        return y.mapInPandas(run, blocks.SCHEMA)

    y = a.times_random(width, seed)
    if center:
        draws = blocks.turned(a.columns(), 1, np.zeros((1, width)))

        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for b, i in zip(batch["block"], batch["ids"]):
                    keys = b * blocks.SIDE + np.frombuffer(i, np.int32).astype(np.int64)
                    rows.append((b, i, blocks.uniform(seed, keys, width).tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["block", "ids", "vals"])

        y = shifted(y, blocks.inner(mean, draws.mapInPandas(drawn, blocks.SCHEMA), 1, width)[0], width)
    y = materialize(y, "projected")
    for step in range(q + 1):
        basis, size = blocks.orthonormal(y, width)
        b = a.times(basis, size, transposed=True)
        if center:
            sums = blocks.column_sums(basis, size)
            b = blocks.summed(b.union(blocks.turned(mean, 1, -sums[None, :])), size)
        b = materialize(b, "b-rows")
        if step < q:
            # B' is made orthonormal too: its columns would square the sizes of small directions
            turn, width = blocks.orthonormal(b, size)
            y = a.times(turn, width)
            if center:
                y = shifted(y, blocks.inner(mean, turn, 1, width)[0], width)
            y = materialize(y, "projected")
            discard(basis)
            discard(turn)
    sigma, vectors = blocks.singular(b, size)
    return Decomposition(sigma[:k], basis, b, vectors[:, :k], size)
