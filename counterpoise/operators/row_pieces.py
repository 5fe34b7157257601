"""The most similar rows of each row, block against block.

Rows are packed into pieces: their entries as plain numbers, written once.  A task holds a block
of pieces by column and reads all pieces as a stream; products of rows that share a column are
added up there, and only the best partners of its own rows are kept.  So no pair is a row of a
table, nothing is shuffled for the search, and ranks are final.  Every pair is computed from both
ends.  Each block reads all pieces again: reading grows with the square of the table, in steps of
``BLOCK_ENTRIES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECE_ENTRIES = 1 << 14
STREAM_ENTRIES = 1 << 19  # entries of pieces that meet a block at a time
BLOCK_ENTRIES = 3_000_000  # of a block, at most
BLOCK_LISTED = 6_000_000  # rows of a block times the length of their lists
HELD = 1_000_000  # new partners of a block's rows before they are merged

PIECE = "ids binary, lengths binary, norms binary, cols binary, vals binary, entries long, members long"


def _numbers(scalar, kind) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer(), dtype=kind)


def _piece(rows: pa.Table, binary: bool) -> dict:
    row, col = (rows[c].to_numpy().astype(np.int64) for c in ("row", "col"))
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    if col.min() >= 0 and col.max() < 1 << 31:
        col = col.astype(np.int32)
    return {
        "ids": row[starts].tobytes(), "lengths": np.diff(np.append(starts, len(row))).astype(np.int64).tobytes(),
        "norms": rows["norm"].to_numpy()[starts].tobytes(), "cols": col.tobytes(),
        "vals": b"" if binary else rows["val"].to_numpy().tobytes(), "entries": len(row), "members": len(starts),
    }


def pack(rows: DataFrame, binary: bool) -> DataFrame:
    """Pieces of (row, col, val, norm) whose rows lie together in a task; no row is in two pieces."""
    schema = pa.schema([(c, pa.binary()) for c in ("ids", "lengths", "norms", "cols", "vals")] + [("entries", pa.int64()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            row = table["row"].to_numpy()
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            # the last row may go on in the next batch
            ends, made = np.append(starts[1:], len(row)) if last else starts[1:], 0
            while len(ends) and made < ends[-1]:
                end = int(ends[min(np.searchsorted(ends, made + PIECE_ENTRIES), len(ends) - 1)])
                yield pa.RecordBatch.from_pylist([_piece(table.slice(made, end - made), binary)], schema=schema)
                made = end
            held, size = table.slice(made).to_batches(), len(row) - made

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= PIECE_ENTRIES and held[0]["row"][0] != batch["row"][-1]:
                yield from cut(False)
        if size:
            yield from cut(True)

    return rows.select("row", "col", "val", "norm").mapInArrow(run, PIECE).withColumn("block", F.monotonically_increasing_id())


def column_sizes(pieces: DataFrame) -> DataFrame:
    """(col, f): entries of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STREAM_ENTRIES // PIECE_ENTRIES)
        for batch in batches:
            for lo in range(0, len(batch), step):
                some = batch.slice(lo, step)
                parts = [_columns(c, n.as_py()).astype(np.int64) for c, n in zip(some["cols"], some["entries"])]
                col, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(col), pa.array(n.astype(np.int64))], names=["col", "n"])

    return pieces.select("cols", "entries").mapInArrow(run, "col long, n long").groupBy("col").agg(F.sum("n").alias("f"))


def _columns(scalar, entries: int) -> np.ndarray:
    buffer = scalar.as_buffer()
    return np.frombuffer(buffer, dtype=np.int32 if buffer.size == 4 * entries else np.int64)


class Rows:
    """Some pieces as arrays: rows one after the other, with their entries."""

    def __init__(self, pieces: list[dict]):
        self.ids, self.lengths, self.norms, self.cols = (np.concatenate([p[c] for p in pieces]) for c in ("ids", "lengths", "norms", "cols"))
        vals = [p["vals"] for p in pieces]
        self.vals = np.concatenate(vals) if any(map(len, vals)) else None


class Block:
    """Rows by column, which meet other rows and keep their ``top`` best partners."""

    def __init__(self, rows: Rows, rule: Callable, top: int, exclude_self: bool, threshold: float, meetings: int):
        self.ids, self.norms = rows.ids, rows.norms
        self.rule, self.top, self.exclude_self, self.threshold, self.meetings = rule, top, exclude_self, threshold, meetings
        order = np.argsort(rows.cols, kind="stable")
        self.row = np.repeat(np.arange(len(rows.ids), dtype=np.int32), rows.lengths)[order]
        self.val = None if rows.vals is None else rows.vals[order]
        cols = rows.cols[order]
        self.low, span = int(cols[0]), int(cols[-1]) - int(cols[0]) + 1
        if span <= 8 * len(cols) + 1_000_000:
            self.names, self.start = None, np.append(0, np.cumsum(np.bincount(cols - cols[0], minlength=span)))
        else:
            self.names, first = np.unique(cols, return_index=True)
            self.start = np.append(first, len(cols))
        # weakest partner of each full list; others must come before it
        self.floor, self.last = np.full(len(self.ids), -np.inf), np.full(len(self.ids), np.iinfo(np.int64).max)
        none = np.zeros(0, np.int64)
        self.best, self.new, self.waiting = (none, none, np.zeros(0), np.zeros(0)), [], 0

    def _find(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of own entries in each of the columns."""
        if self.names is None:
            at = cols.astype(np.int64) - self.low
            met = (at >= 0) & (at < len(self.start) - 1)
            at = np.where(met, at, 0)
        else:
            at = np.minimum(np.searchsorted(self.names, cols), len(self.names) - 1)
            met = self.names[at] == cols
        start = self.start[at]
        return start, np.where(met, self.start[at + 1] - start, 0)

    def meet(self, other: Rows) -> None:
        start, n = self._find(other.cols)
        owner = np.repeat(np.arange(len(other.ids)), other.lengths)
        kept = np.flatnonzero(n)
        start, n, owner = start[kept], n[kept], owner[kept]
        vals = None if other.vals is None else other.vals[kept]
        if not len(n):
            return
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends, total = np.append(first[1:], len(n)), np.cumsum(n)
        lo = 0
        while lo < len(first):
            a = first[lo]
            done = int(total[a] - n[a])
            hi = max(int(np.searchsorted(total[ends - 1], done + self.meetings, side="right")), lo + 1)
            part = slice(a, ends[hi - 1])
            made = int(total[part.stop - 1]) - done
            add = self._long_row if made > self.meetings else self._sums
            self._keep(other, *add(start[part], n[part], owner[part], None if vals is None else vals[part]))
            lo = hi

    def _places(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        ends = np.cumsum(n)
        return np.arange(ends[-1]) + np.repeat(start - ends + n, n)

    def _sums(self, start, n, owner, vals) -> tuple[np.ndarray, ...]:
        """(own row, other row, sum of products) of rows that share a column."""
        at = self._places(start, n)
        key = np.repeat(owner * len(self.ids), n) + self.row[at]
        if self.val is None:
            key.sort()
        else:
            product = np.repeat(vals, n) * self.val[at]
            order = np.argsort(key)
            key, product = key[order], product[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        dots = np.diff(np.append(first, len(key))).astype(float) if self.val is None else np.add.reduceat(product, first)
        key = key[first]
        theirs = key // len(self.ids)
        return key - theirs * len(self.ids), theirs, dots

    def _long_row(self, start, n, owner, vals) -> tuple[np.ndarray, ...]:
        """The same for one row of more meetings than are made at a time."""
        dots, met = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        total, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(int(np.searchsorted(total, total[lo] - n[lo] + self.meetings, side="right")), lo + 1)
            at = self._places(start[lo:hi], n[lo:hi])
            weight = np.ones(len(at)) if self.val is None else np.repeat(vals[lo:hi], n[lo:hi]) * self.val[at]
            dots += np.bincount(self.row[at], weight, len(self.ids))
            met[self.row[at]] = True
            lo = hi
        own = np.flatnonzero(met)
        return own, np.full(len(own), owner[0]), dots[own]

    def _keep(self, other: Rows, own: np.ndarray, theirs: np.ndarray, dots: np.ndarray) -> None:
        found = self.rule(dots, self.norms[own], other.norms[theirs])
        key, names = np.round(found, 9), other.ids[theirs]
        nan = np.isnan(found)
        if nan.any():  # Spark's largest number
            key[nan] = np.inf
        floor = self.floor[own]
        good = (nan | (found >= self.threshold)) & ((key > floor) | ((key == floor) & (names < self.last[own])))
        if self.exclude_self:
            good &= names != self.ids[own]
        good = np.flatnonzero(good)
        self.new.append((own[good], names[good], key[good], found[good]))
        self.waiting += len(good)
        if self.waiting > HELD:
            self.merge()

    def merge(self) -> None:
        own, names, key, found = (np.concatenate(x) for x in zip(self.best, *self.new))
        order = np.lexsort((names, -key, own))
        own = own[order]
        self.place = np.arange(len(own)) - np.searchsorted(own, own)
        kept = self.place < self.top
        order, self.place = order[kept], self.place[kept]
        self.best = own[kept], names[order], key[order], found[order]
        self.new, self.waiting = [], 0
        full = self.place == self.top - 1
        self.floor[self.best[0][full]], self.last[self.best[0][full]] = self.best[2][full], self.best[1][full]


def _ranges(sizes: list, top: int, least: int) -> list[tuple[int, int, int]]:
    """(first piece, last piece, pieces) of each block: stretches of about the same number of entries."""
    entries, members = sum(s["entries"] for s in sizes), sum(s["members"] for s in sizes)
    count = max(-(-entries // BLOCK_ENTRIES), -(-members * top // BLOCK_LISTED), min(least, len(sizes)), 1)
    blocks, weight = [], 0
    for s in sorted(sizes, key=lambda s: s["block"]):
        at, weight = weight * count // entries, weight + s["entries"]
        if blocks and blocks[-1][0] == at:
            blocks[-1][1].append(s["block"])
        else:
            blocks.append((at, [s["block"]]))
    return [(b[0], b[-1], len(b)) for _, b in blocks]


def top_partners(
    pieces: DataFrame, types: dict[str, str], rule: Callable, top: int, exclude_self: bool, threshold: float, meetings: int
) -> DataFrame:
    """(row, other, similarity, rank) from written pieces; ``rule`` makes a similarity of (dots, norm, other norm)."""
    least = 2 * pieces.sparkSession.sparkContext.defaultParallelism
    blocks = _ranges(pieces.select("block", "entries", "members").collect(), top, least)
    expected = [n for *_, n in blocks]
    columns = ["ids", "lengths", "norms", "cols", "vals", "entries"]
    # a union of streams alone would count as one partition; this part has no rows
    streams = pieces.where(F.col("block") < 0).select(F.lit(-1).alias("block"), F.lit(False).alias("own"), *columns)
    for i, (first, last, _) in enumerate(blocks):
        mine = pieces.where(F.col("block").between(first, last)).select(F.lit(i).alias("block"), F.lit(True).alias("own"), *columns)
        every = pieces.select(F.lit(i).alias("block"), F.lit(False).alias("own"), *columns)
        streams = streams.unionByName(mine.unionByName(every).coalesce(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size, block, missing = [], [], 0, None, None
        for batch in batches:
            for i in range(len(batch)):
                piece = {c: _numbers(batch[c][i], np.float64 if c in ("norms", "vals") else np.int64) for c in ("ids", "lengths", "norms", "vals")}
                piece["cols"] = _columns(batch["cols"][i], batch["entries"][i].as_py())
                if missing is None:
                    missing = expected[batch["block"][i].as_py()]
                if batch["own"][i].as_py():
                    # a copy, since the batch is far larger than what is kept of it
                    own.append({c: x.copy() for c, x in piece.items()})
                    missing -= 1
                else:
                    waiting.append(piece if block else {c: x.copy() for c, x in piece.items()})
                    size += len(piece["cols"])
                if not missing and block is None:
                    block, own = Block(Rows(own), rule, top, exclude_self, threshold, meetings), None
                if block and size >= STREAM_ENTRIES:
                    block.meet(Rows(waiting))
                    waiting, size = [], 0
            if block and waiting:
                block.meet(Rows(waiting))
                waiting, size = [], 0
        if block:
            block.merge()
            row, other, _, found = block.best
            for lo in range(0, len(row), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[row[part]]), pa.array(other[part]), pa.array(found[part]), pa.array((block.place[part] + 1).astype(np.int32))],
                    names=["row", "other", "similarity", "rank"])

    made = streams.mapInArrow(run, "row long, other long, similarity double, rank int")
    return made.select(*[F.col(c).cast(types["row"]).alias(c) for c in ("row", "other")], "similarity", "rank")
