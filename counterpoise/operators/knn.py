"""Exact k nearest neighbours.

``knn_join`` is a block nested loop inside groups: query rows and data rows are cut into blocks of
bounded size.  Each task meets one query block and one data block, computes their distances in
numpy, and returns only k rows per query row; a second step merges the k best of every block.  Pairs
never become rows.

``nearest`` prunes by the triangle inequality first.  Data rows belong to the cell of their nearest
pivot; a cell knows the least and greatest distance to its pivot.  A query meets the cells nearest to
it, which gives a bound on its k-th distance, and then only those cells that the bound does not rule out.
For that, cells lie in shards and queries in parts of bounded size; where a shard and a part meet, one
product of matrices finds the few pairs within the bounds, and only these get an exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.draw import u
from ..functions.distance import TIE_DIGITS
from ..session import materialize

MAX_PIVOTS = 4096
PIVOT_NUMBERS = 4_000_000  # of all pivots together; they travel to every task
_CHUNK = 200_000  # distances held at a time, small enough for a processor cache
SHARDS = 8  # of a small table; larger ones are cut at SHARD_ROWS and SHARD_NUMBERS
SHARD_ROWS = 65_536
SHARD_NUMBERS = 4_000_000
ROUTED_NUMBERS = 1_000_000  # of the copies of queries made at a time


def _distances(metric: str, qn: np.ndarray, dn: np.ndarray, qc: np.ndarray, dc: np.ndarray) -> np.ndarray:
    """Distances between rows of q and d; ``*n`` numeric parts, ``*c`` class probabilities per category."""
    total = np.zeros((len(qn), len(dn)))
    for x, y in zip(qn.T, dn.T):
        term = x[:, None] - y[None, :]
        if metric == "product":
            np.abs(term, out=term)
        else:
            term *= term
        if metric != "euclidean" and not (np.isfinite(x).all() and np.isfinite(y).all()):
            term[np.isnan(term)] = 1.0
        total += term
    for i in range(qc.shape[1]):
        # a category has few values: their distances are looked up
        (a, at), (b, to) = (np.unique(c[:, i, :], axis=0, return_inverse=True) for c in (qc, dc))
        square = sum((p[:, None] - q[None, :]) ** 2 for p, q in zip(a.T, b.T))
        step = np.sqrt(square) if metric == "product" else square
        step[np.isnan(step)] = 1.0
        total += step[:, to.ravel()][at.ravel()]
    return np.sqrt(total)


def _best(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite numbers of each row; ties go to the first column."""
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if dist.shape[1] > k else np.inf
    row, column = np.nonzero((dist <= limit) & np.isfinite(dist))
    order = np.lexsort((column, dist[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _nearest(metric: str, k: int, n_cat: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        tagged = "tag" in data.columns
        columns = ["qid", "nid", "dist", *(["tag"] if tagged else [])]
        out = {c: [] for c in columns}
        if len(queries) and len(data):
            data = data.sort_values("id", kind="stable")
            dn, qn = _matrix(data["num"]), _matrix(queries["num"])
            dc = _matrix(data["cat"]).reshape(len(data), n_cat, -1) if n_cat else np.zeros((len(data), 0, 1))
            qc = _matrix(queries["cat"]).reshape(len(queries), n_cat, -1) if n_cat else np.zeros((len(queries), 0, 1))
            names, asked = data["id"].to_numpy(), queries["id"].to_numpy()
            tags = data["tag"].to_numpy() if tagged else None
            step = max(1, _CHUNK // len(data))
            for start in range(0, len(queries), step):
                dist = _distances(metric, qn[start : start + step], dn, qc[start : start + step], dc)
                dist = np.round(dist, TIE_DIGITS)
                dist[dist == 0] = np.inf
                row, column = _best(dist, k)
                out["qid"].append(asked[start + row])
                out["nid"].append(names[column])
                out["dist"].append(dist[row, column])
                if tagged:
                    out["tag"].append(tags[column])
        if not out["qid"]:
            return pd.DataFrame({c: [] for c in ["grp", *columns, "rank"]})
        found = pd.DataFrame({c: np.concatenate(out[c]) for c in columns})
        if queries["id"].duplicated().any():
            # an id that comes several times is one query
            found = found.sort_values(["qid", "dist", "nid"], kind="stable")
            found["rank"] = found.groupby("qid", dropna=False).cumcount() + 1
            found = found[found["rank"] <= k]
        else:
            found["rank"] = found.groupby("qid", sort=False, dropna=False).cumcount() + 1
        found.insert(0, "grp", queries["grp"].iloc[0])
        return found

    return run


def _found_schema(queries: DataFrame, data: DataFrame) -> str:
    types = dict(data.dtypes)
    tag = f", tag {types['tag']}" if "tag" in types else ""
    return f"grp int, qid {dict(queries.dtypes)['id']}, nid {types['id']}, dist double{tag}, rank int"


def knn_within(
    rows: DataFrame,
    asked: Column,
    k: int,
    metric: str = "euclidean",
    n_cat: int = 0,
    block_rows: int = 4096,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``knn_join`` of the ``asked`` rows of a table with the whole table.

    Where no group has more than ``block_rows`` rows each group meets in one task as it is: a row is
    shuffled once, and its ranks are final.  ``sizes`` is a table with the same ``grp`` values that is
    cheaper to count.  A column ``tag`` comes out with each neighbour.
    """
    counted = rows if sizes is None else sizes
    largest = counted.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    columns = ["grp", "id", "num", "cat", *(["tag"] if "tag" in rows.columns else [])]
    marked = rows.select(*columns, F.coalesce(asked, F.lit(False)).alias("_asked"))
    if largest > block_rows:
        marked = materialize(marked, "neighbour-rows")
        return knn_join(marked.where("_asked").drop("_asked"), marked.drop("_asked"), k, metric, n_cat, block_rows)
    whole = _whole_group(metric, k, n_cat, _nearest(metric, k, n_cat))
    return marked.groupBy("grp").applyInArrow(whole, _found_schema(marked, marked))


def _whole_group(metric: str, k: int, n_cat: int, by_names):
    """Neighbours of the asked rows of one group; ``by_names`` serves groups where an id comes several times.

    Groups are small and many, so rows stay Arrow columns and are known by their places.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["id"]))
        asked = np.flatnonzero(group["_asked"].to_numpy())
        tag = ["tag"] if "tag" in group.column_names else []
        types = pa.schema([("grp", pa.int32()), ("qid", group["id"].type), ("nid", group["id"].type), ("dist", pa.float64()),
                           *[(c, group[c].type) for c in tag], ("rank", pa.int32())])
        if pc.count_distinct(group["id"], mode="all").as_py() < len(group):
            rows = group.to_pandas()
            return pa.Table.from_pandas(by_names(rows[rows["_asked"]], rows), schema=types, preserve_index=False)
        num = _rows_of(group["num"])
        cat = _rows_of(group["cat"]).reshape(len(num), n_cat, -1) if n_cat else np.zeros((len(num), 0, 1))
        step, rows, columns, dists = max(1, _CHUNK // len(num)), [asked[:0]], [asked[:0]], [np.zeros(0)]
        for lo in range(0, len(asked), step):
            part = asked[lo : lo + step]
            dist = np.round(_distances(metric, num[part], num, cat[part], cat), TIE_DIGITS)
            dist[dist == 0] = np.inf
            row, column = _best(dist, k)
            rows.append(part[row])
            columns.append(column)
            dists.append(dist[row, column])
        row, column = np.concatenate(rows), np.concatenate(columns)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        qid, nid = (group["id"].take(pa.array(x)) for x in (row, column))
        grp = group["grp"].take(pa.array(row))
        return pa.table([grp, qid, nid, pa.array(np.concatenate(dists)), *[group[c].take(pa.array(column)) for c in tag], pa.array(rank.astype(np.int32))], schema=types)

    return run


def knn_join(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    metric: str = "euclidean",
    n_cat: int = 0,
    block_rows: int = 4096,
) -> DataFrame:
    """k nearest data rows of each query row inside its group: (grp, qid, nid, dist, rank).

    Both inputs hold (grp int, id, num array<double>, cat array<double>).  Rows at distance
    0 are not neighbours; distances equal to nine digits count as tied, and ties go to the
    smaller id.  Groups larger than ``block_rows`` are cut into blocks on either side.
    """
    q_sizes = queries.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_blocks"))
    d_sizes = data.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("d_blocks"))
    sizes = q_sizes.join(d_sizes, "grp")
    columns = ["id", "num", "cat"]

    def blocks(side: DataFrame, own: str, other: str, own_name: str, other_name: str, seed: str) -> DataFrame:
        sized = side.join(sizes, "grp")
        return sized.select(
            F.col("grp").alias("grp"),  # fresh columns: both sides may come from one table
            F.floor(u(seed, "id") * F.col(own)).cast("int").alias(own_name),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name),
            *[F.col(c).alias(c) for c in side.columns if c in (*columns, "tag")],
        )

    q = blocks(queries, "q_blocks", "d_blocks", "qb", "db", "q-block")
    d = blocks(data, "d_blocks", "q_blocks", "db", "qb", "d-block")
    d = d.select("grp", "qb", "db", *[c for c in d.columns if c in (*columns, "tag")])
    # a given number keeps adaptive execution from merging these small but costly tasks
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, d = (side.repartition(tasks, "grp", "qb", "db") for side in (q, d))
    found = (
        q.groupBy("grp", "qb", "db")
        .cogroup(d.groupBy("grp", "qb", "db"))
        .applyInPandas(_nearest(metric, k, n_cat), _found_schema(queries, data))
    ).drop("rank")
    order = W.partitionBy("grp", "qid").orderBy("dist", "nid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def no_categories() -> Column:
    return F.array().cast("array<double>").alias("cat")


class Cells:
    """Pivots, and of each cell its number of rows and its least and greatest distance to the pivot."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.squares = pivots, (pivots**2).sum(axis=1)
        self.rows = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances to all pivots, with what rounding may have added or lost in ``slack``."""
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + self.squares - 2 * (x @ self.pivots.T), 0))

    def part(self, own: np.ndarray) -> Cells:
        """Some of the cells, in the given order."""
        some = Cells(self.pivots[own])
        some.rows, some.low, some.high = self.rows[own], self.low[own], self.high[own]
        return some

    def slack(self, x: np.ndarray) -> float:
        # the squares cancel: their rounding counts as its root
        return 4e-8 * float(np.sqrt((x**2).sum(axis=1).max(initial=0) + self.squares.max(initial=0)) + 1)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.distances(x).argmin(axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least distance that a row of each cell can have to each query."""
        away = self.distances(x)
        return np.where(self.rows > 0, np.maximum(np.maximum(away - self.high, self.low - away), 0), np.inf)

    def first(self, x: np.ndarray, need: int) -> np.ndarray:
        """Queries x cells: the cells of least bound that hold ``need`` rows together."""
        bounds = self.bounds(x)
        order = np.lexsort((self.distances(x), bounds), axis=1)
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, before < need, axis=1)
        return chosen & (self.rows > 0)


def _finite(side: DataFrame) -> DataFrame:
    return side.where(F.forall("num", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def make_cells(data: DataFrame, n_rows: int, block_rows: int, seed="pivots") -> tuple[Cells, DataFrame]:
    """Cells of (id, num, cat) rows, and the rows with ``grp``, their cell."""
    dims = max(1, data.agg(F.max(F.size("num"))).first()[0] or 1)
    count = max(1, min(MAX_PIVOTS, PIVOT_NUMBERS // dims, -(-2 * n_rows // block_rows)))
    chosen = data.select("num", u(seed, "id").alias("_u"), "id").orderBy("_u", "id").limit(count).select("num").collect()
    cells = Cells(np.array([r["num"] for r in chosen], dtype=float).reshape(len(chosen), -1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, away = cells.home(_matrix(batch["num"]))
                yield batch.assign(grp=cell, away=away)

    placed = materialize(data.mapInPandas(place, T.StructType([*data.schema, T.StructField("grp", T.IntegerType()), T.StructField("away", T.DoubleType())])), "cells")
    for r in placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():
        cells.rows[r["grp"]], cells.low[r["grp"]], cells.high[r["grp"]] = r["n"], r["low"], r["high"]
    return cells, placed.drop("away")


def routes(queries: DataFrame, cells: Cells, k: int, bounded: bool) -> DataFrame:
    """Queries once per cell to visit, as ``grp``.

    Unbounded queries go to the nearest cells that hold enough rows.  ``bounded`` ones have
    ``limit``, their k-th distance so far, and go to all other cells that can hold a row within it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, _CHUNK * 5 // len(cells.rows))
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                x = _matrix(part["num"])
                visit = cells.first(x, 4 * k + 1)
                if bounded:
                    reach = part["limit"].to_numpy(float) + cells.slack(x)
                    visit = (cells.bounds(x) <= reach[:, None]) & ~visit & (cells.rows > 0)
                row, cell = np.nonzero(visit)
                if len(row):
                    yield part.iloc[row].assign(grp=cell)

    return queries.mapInPandas(run, T.StructType([*queries.schema, T.StructField("grp", T.IntegerType())]))


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    size = pc.min_max(pc.list_value_length(column)).as_py()
    if size["min"] != size["max"]:
        raise ValueError("vectors of different size")
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Within:
    """Pairs of query rows with data rows within the queries' limits."""

    def __init__(self, y: np.ndarray, k: int):
        self.y, self.k, self.squares = y, k, (y**2).sum(axis=1)
        self.wide = np.hstack([y, np.ones((len(y), 1)), -self.squares[:, None]])

    def ask(self, x: np.ndarray, limit: np.ndarray) -> None:
        self.x, self.limit, self.own = x, limit.copy(), (x**2).sum(axis=1)

    def error(self, rows: np.ndarray, to: slice) -> np.ndarray:
        """More than rounding can add to, or take from, a squared distance made of products."""
        return 2e-15 * (self.x.shape[1] + 8) * (self.own[rows] + self.squares[to].max(initial=0))

    def tighten(self, rows: np.ndarray, to: slice) -> None:
        """Limits of queries that have none, from the k nearest of some data rows that are surely no copies."""
        square = self.own[rows, None] + self.squares[to] - 2 * (self.x[rows] @ self.y[to].T)
        error = self.error(rows, to)
        square[~(square > error[:, None] + 1e-17)] = np.inf
        if square.shape[1] >= self.k:
            self.limit[rows] = np.sqrt(np.partition(square, self.k - 1, axis=1)[:, self.k - 1] + error) + 10.0**-TIE_DIGITS

    def pairs(self, rows: np.ndarray, to: slice) -> tuple[np.ndarray, np.ndarray]:
        """(query, data row) of all pairs within the limits, and of some just beyond."""
        reach = (self.limit[rows] + 10.0**-TIE_DIGITS) ** 2
        reach += self.error(rows, to) + 1e-14 * reach
        asked = np.hstack([2 * self.x[rows], (reach - self.own[rows])[:, None], np.ones((len(rows), 1))])
        row, column = np.nonzero(~(asked @ self.wide[to].T < 0))
        return rows[row], column + to.start

    def best(self, pairs: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, number of the data row, distance) of each query's k nearest; ties go to the smaller number."""
        row, column = (np.concatenate(p) for p in zip(*pairs))
        total = np.zeros(len(row))
        for a, b in zip(self.x.T, self.y.T):
            total += (a[row] - b[column]) ** 2
        dist = np.round(np.sqrt(total), TIE_DIGITS)
        near = (dist > 0) & np.isfinite(dist)
        return _first(row[near], numbers[column[near]], dist[near], self.k)


def _first(row: np.ndarray, number: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((number, dist, row))
    row, number, dist = row[order], number[order], dist[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], number[kept], dist[kept]


def _meet(cells: Cells, k: int, block: int = 512):
    """The k nearest rows of a shard within the limits of a part of the queries."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        if len(queries) and len(data):
            data = data.take(pc.sort_indices(data["id"], null_placement="at_start"))
            grp = data["grp"].to_numpy()
            # a row's number stands for its id; rows lie by cell
            numbers = np.argsort(grp, kind="stable")
            x, limits = _rows_of(queries["num"]), queries["limit"].to_numpy()
            meets = _Within(_rows_of(data["num"])[numbers], k)
            own, starts = np.unique(grp[numbers], return_index=True)
            mine, ends = cells.part(own), np.append(starts[1:], len(numbers))
            stretches = [(c, slice(a, min(a + 4 * block, e))) for c, (s, e) in enumerate(zip(starts, ends)) for a in range(s, e, 4 * block)]
            for lo in range(0, len(x), block):
                meets.ask(x[lo : lo + block], limits[lo : lo + block])
                bounds, slack = mine.bounds(meets.x), mine.slack(meets.x)
                held, met, n = found[0], [], 0
                for c, to in stretches:
                    rows = np.flatnonzero(bounds[:, c] <= meets.limit + slack)
                    if len(rows):
                        free = rows[np.isinf(meets.limit[rows])]
                        if len(free):
                            meets.tighten(free, to)
                        met.append(meets.pairs(rows, to))
                        n += len(met[-1][0])
                    if n > _CHUNK or (n and to is stretches[-1][1]):
                        held = _first(*map(np.concatenate, zip(held, meets.best(met, numbers))), k)
                        met, n = [], 0
                found.append((held[0] + lo, *held[1:]))
        row, number, dist = map(np.concatenate, zip(*found))
        return pa.table({"qid": queries["id"].take(pa.array(row)), "nid": data["id"].take(pa.array(number)), "dist": dist})

    return run


def shard_size(n_rows: int, dims: int, block_rows: int) -> int:
    return min(max(-(-n_rows // SHARDS), block_rows), SHARD_ROWS, max(1, SHARD_NUMBERS // max(1, dims)))


def shard_routes(limited: DataFrame, cells: Cells, size: int) -> DataFrame:
    """Queries once per ``shard`` of ``size`` rows that has a cell within their ``limit``."""
    ends = np.cumsum(cells.rows)
    shards, dims = -(-int(ends[-1]) // size), max(1, cells.pivots.shape[1])
    shard_of = np.zeros((len(cells.rows), shards), np.float32)
    for cell in np.flatnonzero(cells.rows):
        shard_of[cell, (ends[cell] - cells.rows[cell]) // size : (ends[cell] - 1) // size + 1] = 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, min(_CHUNK * 5 // len(cells.rows), ROUTED_NUMBERS // (dims * shards)))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.iloc[lo : lo + step]
                x = _matrix(part["num"])
                visit = (cells.bounds(x) <= part["limit"].to_numpy(float)[:, None] + cells.slack(x)) & (cells.rows > 0)
                row, shard = np.nonzero(visit.astype(np.float32) @ shard_of)
                if len(row):
                    yield part.iloc[row].assign(shard=shard)

    return limited.mapInPandas(run, T.StructType([*limited.schema, T.StructField("shard", T.IntegerType())]))


def within_limits(limited: DataFrame, n_queries: int, cells: Cells, placed: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """Data rows (qid, nid, dist) within the ``limit`` of each query, at most k of each shard.

    Shards are stretches of cells.  A query travels once to each shard that has a cell it can need,
    not once per cell, and a shard once to each part of the queries.
    """
    n_rows = int(cells.rows.sum())
    size = shard_size(n_rows, cells.pivots.shape[1], block_rows)
    n_shards, n_parts = -(-n_rows // size), max(1, -(-n_queries // size))
    spark, before = placed.sparkSession, np.cumsum(cells.rows) - cells.rows
    places = spark.createDataFrame([(int(c), int(before[c]), int(cells.rows[c])) for c in np.flatnonzero(cells.rows)], "grp int, before long, n long")
    place = F.col("before") + F.floor(u("shard", "id") * F.col("n"))
    d = placed.join(F.broadcast(places), "grp").select(
        F.floor(place / size).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "grp", "id", "num")
    q = limited.select("id", "num", "limit", F.floor(u("query-part", "id") * n_parts).cast("int").alias("part"))
    q = shard_routes(q, cells, size)
    # more partitions than meetings, so that few of these costly tasks share one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * n_shards * n_parts, 4096))
    q, d = (side.repartition(tasks, "shard", "part") for side in (q, d))
    types = f"qid {dict(limited.dtypes)['id']}, nid {dict(placed.dtypes)['id']}, dist double"
    return q.groupBy("shard", "part").cogroup(d.groupBy("shard", "part")).applyInArrow(_meet(cells, k), types)


def nearest(queries: DataFrame, data: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """k nearest data rows of each query row by Euclidean distance: (qid, nid, dist, rank).

    Both inputs hold (id, num array<double>); rows at distance 0 are not neighbours, ties go to the
    smaller id, and rows with a missing or infinite number take no part.
    """
    asked, rows = (_finite(side).select("id", "num", no_categories()) for side in (queries, data))
    n_rows = rows.count()
    if n_rows <= block_rows:
        one = F.lit(0).alias("grp")
        return knn_join(asked.select(one, "*"), rows.select(one, "*"), k, block_rows=block_rows).drop("grp")
    cells, placed = make_cells(rows, n_rows, block_rows)
    routed = materialize(routes(asked, cells, k, False), "routed")
    order = W.partitionBy("qid").orderBy("dist", "nid")
    near = knn_join(routed, placed, k, block_rows=block_rows).select("qid", "nid", "dist").withColumn("rank", F.row_number().over(order))
    kth = near.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("dist").alias("limit"))
    limited = asked.join(kth, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    found = within_limits(limited, asked.count(), cells, placed, k, block_rows)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(df: DataFrame, id_col: str, vec: str, k: int, block_rows: int = 4096) -> DataFrame:
    """k nearest rows of every row of one table by Euclidean distance: (id, neighbor, dist, rank)."""
    side = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("num"))
    found = nearest(side, side, k, block_rows)
    return found.select(F.col("qid").alias(id_col), F.col("nid").alias("neighbor"), "dist", "rank")


def vote(neighbors: DataFrame, labels: DataFrame, query: str, label: str) -> DataFrame:
    """Majority label of each query's neighbours, lowest label on ties, with its votes.

    ``neighbors`` has (``query``, nid); ``labels`` has (nid, ``label``).
    """
    counts = neighbors.join(labels, "nid").groupBy(query, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("order"), F.col(label).alias("label")))
    return counts.groupBy(query).agg(best.alias("best")).select(
        query, F.col("best.label").alias("predicted"), (-F.col("best.order")).alias("votes")
    )


def knn_classify(
    train: DataFrame, query: DataFrame, id_col: str, vec: str, label: str, k: int = 5, block_rows: int = 4096
) -> DataFrame:
    """Label of each query row by vote of its k nearest training rows at distance above 0."""
    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("num"))

    near = nearest(side(query), side(train), k, block_rows).select(F.col("qid").alias(id_col), "nid")
    return vote(near, train.select(F.col(id_col).alias("nid"), label), id_col, label)
