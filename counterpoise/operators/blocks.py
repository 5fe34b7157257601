"""Matrices and vectors as tables of blocks.

A matrix is a table of tiles of ``SIDE`` by ``SIDE`` places, a set of vectors a table of blocks of ``SIDE``
places with ``width`` numbers each.  Both keep only places that have values.  A product joins tiles and
vector blocks on the block number; a task adds up what it can and Spark adds the partial blocks.
Nothing as long as a row or column of the matrix goes through the driver: only sums, and matrices
of ``width`` by ``width`` numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize

SIDE = 1024
PIECE = 1 << 16
HELD_BLOCKS = 64
FAN = 32
SCHEMA = "block long, ids binary, vals binary"


def _row(block: int, ids: np.ndarray, vals: np.ndarray) -> tuple[int, bytes, bytes]:
    return int(block), ids.astype(np.int32).tobytes(), np.ascontiguousarray(vals, dtype=float).tobytes()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "ids", "vals"])


def _read(ids: bytes, vals: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(ids, np.int32)
    return places, np.frombuffer(vals, float).reshape(len(places), width)


def pack(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Blocks of (key, vec) rows with unique integer keys and arrays of one length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = batch["key"].to_numpy(np.int64)
                vals = np.array(batch["vec"].tolist(), dtype=float)
                block, ids = keys // SIDE, keys % SIDE
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order])) + 1
                yield _frame([_row(block[part[0]], ids[part], vals[part]) for part in np.split(order, cuts)])

    parts = rows.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).mapInPandas(run, SCHEMA)
    width = rows.select(F.size(vec)).first()
    return summed(parts, width[0] if width else 1)


def unpack(blocks: DataFrame, key: str, width: int, by: np.ndarray | None = None) -> DataFrame:
    """(key, vec) rows of blocks; ``by`` multiplies every row by a small matrix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ids, vals in zip(batch["block"], batch["ids"], batch["vals"]):
                places, found = _read(ids, vals, width)
                yield pd.DataFrame({key: block * SIDE + places.astype(np.int64), "vec": list(found if by is None else found @ by)})

    return blocks.mapInPandas(run, f"{key} long, vec array<double>")


def summed(parts: DataFrame, width: int) -> DataFrame:
    """One row per block from partial blocks, added up as they arrive."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, current, out = np.zeros((SIDE, width)), np.zeros(SIDE, bool), None, []

        def close() -> None:
            if current is not None:
                places = np.flatnonzero(seen)
                out.append(_row(current, places, total[places]))

        for batch in batches:
            for block, ids, vals in zip(batch["block"], batch["ids"], batch["vals"]):
                if block != current:
                    close()
                    current = block
                    total[:], seen[:] = 0, False
                places, found = _read(ids, vals, width)
                total[places] += found
                seen[places] = True
            if len(out) >= HELD_BLOCKS:
                yield _frame(out)
                out.clear()
        close()
        if out:
            yield _frame(out)

    return parts.repartition("block").sortWithinPartitions("block", "ids", "vals").mapInPandas(run, SCHEMA)


def turned(blocks: DataFrame, width: int, by: np.ndarray) -> DataFrame:
    """Every row vector times a small matrix of ``width`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block, ids, vals in zip(batch["block"], batch["ids"], batch["vals"]):
                places, found = _read(ids, vals, width)
                rows.append(_row(block, places, found @ by))
            if rows:
                yield _frame(rows)

    return blocks.mapInPandas(run, SCHEMA)


def combined(terms: list[tuple[float, DataFrame]], width: int = 1) -> DataFrame:
    """Sum of tables of vectors, each times a number; written."""
    out = None
    for factor, blocks in terms:
        scaled = blocks if factor == 1 else turned(blocks, width, factor * np.eye(width))
        out = scaled if out is None else out.union(scaled)
    return materialize(summed(out, width), "vector")


def inner(x: DataFrame, y: DataFrame, x_width: int = 1, y_width: int = 1) -> np.ndarray:
    """X'Y, of x_width by y_width numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((x_width, y_width))
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = _read(row.ids, row.vals, x_width), _read(row.ids2, row.vals2, y_width)
                _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
                total += a[1][i].T @ b[1][j]
        yield pd.DataFrame({"place": np.arange(total.size), "val": total.ravel()})

    other = y.select("block", F.col("ids").alias("ids2"), F.col("vals").alias("vals2"))
    cells = x.join(other, "block").mapInPandas(run, "place long, val double").groupBy("place").agg(F.sum("val").alias("val")).collect()
    out = np.zeros(x_width * y_width)
    for place, val in cells:
        out[place] = val
    return out.reshape(x_width, y_width)


def dots(vectors: list[DataFrame], w: DataFrame) -> list[float]:
    """Inner products of several single vectors with ``w``, in one pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(count)
        for batch in batches:
            for row in batch.itertuples(index=False):
                full = np.zeros(SIDE)
                full[np.frombuffer(row.ids2, np.int32)] = np.frombuffer(row.vals2, float)
                total[row.i] += full[np.frombuffer(row.ids, np.int32)] @ np.frombuffer(row.vals, float)
        yield pd.DataFrame({"i": np.arange(count), "val": total})

    count = len(vectors)
    numbered = [v.withColumn("i", F.lit(i)) for i, v in enumerate(vectors)]
    rows = reduce(DataFrame.union, numbered).join(w.select("block", F.col("ids").alias("ids2"), F.col("vals").alias("vals2")), "block")
    found = dict(rows.mapInPandas(run, "i int, val double").groupBy("i").agg(F.sum("val")).collect())
    return [found.get(i, 0.0) for i in range(count)]


def column_sums(x: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            for ids, vals in zip(batch["ids"], batch["vals"]):
                total += _read(ids, vals, width)[1].sum(axis=0)
        yield pd.DataFrame({"place": np.arange(width), "val": total})

    found = dict(x.mapInPandas(run, "place long, val double").groupBy("place").agg(F.sum("val")).collect())
    return np.array([found.get(i, 0.0) for i in range(width)])


def uniform(seed, keys: np.ndarray, width: int) -> np.ndarray:
    """Draws in [-1/2, 1/2) of (seed, key, column); the same wherever they are made."""
    start = np.uint64(int(hashlib.md5(str(seed).encode()).hexdigest()[:16], 16))
    x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + start
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) - 0.5


def _tile_product(r: np.ndarray, c: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): rows of a tile times ``x``; a well-filled tile becomes a dense product."""
    rows, ri = np.unique(r, return_inverse=True)
    cols, ci = np.unique(c, return_inverse=True)
    if len(rows) * len(cols) <= 16 * len(v):
        dense = np.zeros((len(rows), len(cols)))
        np.add.at(dense, (ri, ci), v)
        return rows, dense @ x[cols]
    order = np.argsort(ri, kind="stable")
    first = np.searchsorted(ri[order], np.arange(len(rows)))
    return rows, np.add.reduceat(v[order, None] * x[c[order]], first, axis=0)


class BlockMatrix:
    """A matrix from (row, col, val) entries with integer indices; entries of one place add up."""

    def __init__(self, entries: DataFrame):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    row, col = batch["row"].to_numpy(np.int64), batch["col"].to_numpy(np.int64)
                    val = batch["val"].to_numpy(float)
                    bi, bj = row // SIDE, col // SIDE
                    order = np.lexsort((bj, bi))
                    cuts = np.flatnonzero((np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)) + 1
                    pieces = [p[i : i + PIECE] for p in np.split(order, cuts) for i in range(0, len(p), PIECE)]
                    yield pd.DataFrame([(
                        bi[p[0]], bj[p[0]], (row[p] % SIDE).astype(np.int32).tobytes(), (col[p] % SIDE).astype(np.int32).tobytes(), val[p].tobytes(),
                    ) for p in pieces], columns=["bi", "bj", "r", "c", "v"])

        cells = entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))
        placed = cells.repartition(F.floor(F.col("row") / SIDE), F.floor(F.col("col") / SIDE)).sortWithinPartitions(
            F.floor(F.col("row") / SIDE), F.floor(F.col("col") / SIDE))
        self.tiles = materialize(placed.mapInPandas(run, "bi long, bj long, r binary, c binary, v binary"), "tiles")

    def _product(self, met: DataFrame, transposed: bool, width: int, operand) -> DataFrame:
        """Partial blocks of a product, added up in the task while they are few."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def rows() -> pd.DataFrame:
                return _frame([_row(b, np.flatnonzero(seen), total[seen]) for b, (total, seen) in held.items()])

            for batch in batches:
                for row in batch.itertuples(index=False):
                    r, c = np.frombuffer(row.r, np.int32), np.frombuffer(row.c, np.int32)
                    if transposed:
                        r, c = c, r
                    places, found = _tile_product(r, c, np.frombuffer(row.v, float), operand(row))
                    out = row.bj if transposed else row.bi
                    if out not in held:
                        if len(held) >= HELD_BLOCKS:
                            yield rows()
                            held.clear()
                        held[out] = np.zeros((SIDE, width)), np.zeros(SIDE, bool)
                    held[out][0][places] += found
                    held[out][1][places] = True
            if held:
                yield rows()

        return summed(met.mapInPandas(run, SCHEMA), width)

    def times(self, x: DataFrame, width: int = 1, transposed: bool = False) -> DataFrame:
        """A X, or A'X, as blocks; rows without entries are absent."""
        def operand(row) -> np.ndarray:
            full = np.zeros((SIDE, width))
            places, found = _read(row.ids, row.vals, width)
            full[places] = found
            return full

        met = self.tiles.join(x, F.col("bi" if transposed else "bj") == F.col("block")).drop("block")
        return self._product(met, transposed, width, operand)

    def times_random(self, width: int, seed) -> DataFrame:
        """A times random columns, whose draws are made where they are needed."""
        def operand(row) -> np.ndarray:
            return uniform(seed, row.bj * SIDE + np.arange(SIDE), width)

        return self._product(self.tiles, False, width, operand)

    def columns(self) -> DataFrame:
        """Distinct columns that have entries, as blocks of ones."""
        def operand(row) -> np.ndarray:
            return np.ones((SIDE, 1))

        found = self._product(self.tiles.select("bi", "bj", "r", "c", "v"), True, 1, operand)

        def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [_row(b, np.frombuffer(i, np.int32), np.ones(len(i) // 4)) for b, i in zip(batch["block"], batch["ids"])]
                if rows:
                    yield _frame(rows)

        return found.mapInPandas(ones, SCHEMA)


# tall-skinny QR


def upper_factor(x: DataFrame, width: int) -> np.ndarray:
    """R of a QR factorization of the rows of X.

    Each task keeps one R of the blocks it has met; the Rs of the tasks merge ``FAN`` at a time.
    """
    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for batch in batches:
            for vals in batch["vals"]:
                r = np.linalg.qr(np.vstack((r, np.frombuffer(vals, float).reshape(-1, width))), mode="r")
        if len(r):
            yield pd.DataFrame({"vals": [np.ascontiguousarray(r).tobytes()]})

    found = materialize(x.select("vals").mapInPandas(factor, "vals binary"), "factors")
    count = found.count()
    while count > FAN:
        count = -(-count // FAN)
        merged = materialize(found.repartition(count).mapInPandas(factor, "vals binary"), "factors")
        discard(found)
        found = merged
        count = found.count()
    parts = [np.frombuffer(r["vals"], float).reshape(-1, width) for r in found.collect()]
    discard(found)
    return np.linalg.qr(np.vstack(parts), mode="r") if parts else np.zeros((0, width))


def orthonormal(y: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(Q, rank): blocks with Q'Q = I that span the columns of Y; a second pass mends what rounding left.

    R comes from QR factors, so no condition is squared and directions down to about 1e-13 of the
    largest survive; smaller ones are dropped, and Q has ``rank`` columns.
    """
    for _ in range(2):
        r = upper_factor(y, width)
        _, values, vt = np.linalg.svd(r) if len(r) else (None, np.zeros(0), np.zeros((0, width)))
        live = values > (values[0] if len(values) else 0.0) * 1e-13
        by = vt[: len(values)][live].T / values[live]
        before, y, width = y, materialize(turned(y, width, by), "orthonormal"), int(live.sum())
        discard(before)
    return y, width


def singular(x: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values descending, right singular vectors as columns) of the rows of X."""
    r = upper_factor(x, width)
    if not len(r):
        return np.zeros(0), np.zeros((width, 0))
    _, values, vt = np.linalg.svd(r, full_matrices=False)
    return values, vt.T
