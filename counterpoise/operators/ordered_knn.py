"""Exact k nearest rows of a whole table under the mixed distance.

The terms of the distance are added up without a sign, so two rows are at least as far apart as in one number
alone.  Rows are put in order of the number that spreads most and cut into ranges of bounded size.  A
query finds its nearest inside its own range, where rows beyond its k-th distance in that number are not
looked at; then it travels to the other ranges within that distance, if there are any, to meet the rows
near their ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.distance import TIE_DIGITS
from ..session import materialize
from .knn import _CHUNK, _first, _rows_of, knn_join

RANGE_ROWS = 65_536


class _Pairs:
    """Distances of some pairs, with the terms and the order of ``knn._distances``.

    Numbers are weighted after they are subtracted, so that close rows keep their digits.
    """

    def __init__(self, metric: str, weights: list[float], num: np.ndarray, cat: np.ndarray, n_cat: int):
        self.metric, self.weights, self.num, self.tables, self.codes = metric, weights, num, [], []
        for part in np.split(cat, n_cat, axis=1) if n_cat else ():
            values, code = np.unique(part, axis=0, return_inverse=True)
            square = sum((p[:, None] - q[None, :]) ** 2 for p, q in zip(values.T, values.T))
            step = np.sqrt(square) if metric == "product" else square
            step[np.isnan(step)] = 1.0
            self.tables.append(step)
            self.codes.append(code.ravel())

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a))
        for x, weight in zip(self.num.T, self.weights):
            term = (x[a] - x[b]) * weight
            term = np.abs(term) if self.metric == "product" else term * term
            if self.metric != "euclidean":
                term[np.isnan(term)] = 1.0
            total += term
        for step, code in zip(self.tables, self.codes):
            total += step[code[a], code[b]]
        dist = np.round(np.sqrt(total), TIE_DIGITS)
        dist[~(np.isfinite(dist) & (dist > 0))] = np.inf
        return dist


def _reach(metric: str, limit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How far a row within ``limit`` can lie in one number, and a little more than rounding can change."""
    far = limit + 10.0**-TIE_DIGITS
    far = far * far if metric == "product" else far
    return far * (1 + 1e-12) + 4e-15 * np.abs(x)


def _search(pairs: _Pairs, x: np.ndarray, asked: np.ndarray, data: np.ndarray, numbers: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(index in ``asked``, data row, distance) of the k nearest within the limits; ``data`` lie in the order of ``x``."""
    reach = _reach(pairs.metric, limit, x[asked])
    lo = np.searchsorted(x[data], x[asked] - reach, side="left")
    n = np.searchsorted(x[data], x[asked] + reach, side="right") - lo
    none, total, start = np.zeros(0, np.int64), np.cumsum(n), 0
    found = [(none, none, np.zeros(0))]
    place = np.empty(len(x), np.int64)
    place[numbers[data]] = data
    while start < len(asked):
        end = max(int(np.searchsorted(total, total[start] - n[start] + _CHUNK, side="right")), start + 1)
        some = n[start:end]
        row = np.repeat(np.arange(start, end), some)
        column = data[np.arange(len(row)) + np.repeat(lo[start:end] - np.cumsum(some) + some, some)]
        dist = pairs.distances(asked[row], column)
        near = (dist <= limit[row]) & np.isfinite(dist)
        row, number, dist = _first(row[near], numbers[column[near]], dist[near], k)
        found.append((row, place[number], dist))
        start = end
    return tuple(map(np.concatenate, zip(*found)))


def _limits(pairs: _Pairs, asked: np.ndarray, n: int, k: int) -> np.ndarray:
    """An upper bound of each query's k-th distance from the rows beside it; all rows lie in order."""
    limit, left, wide = np.full(len(asked), np.inf), np.arange(len(asked)), 2 * k
    while len(left):
        beside = np.append(np.arange(-wide, 0), np.arange(1, wide + 1))
        for lo in range(0, len(left), max(1, _CHUNK // len(beside))):
            some = left[lo : lo + max(1, _CHUNK // len(beside))]
            at = asked[some, None] + beside
            dist = pairs.distances(np.repeat(asked[some], len(beside)), np.clip(at, 0, n - 1).ravel()).reshape(at.shape)
            dist[(at < 0) | (at >= n)] = np.inf
            limit[some] = np.partition(dist, k - 1, axis=1)[:, k - 1]
        left, wide = (left[np.isinf(limit[left])], wide * 4) if wide < n else (left[:0], wide)
    return limit


def _by_number(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows in the order of x, x, and the place of each row in the order of ids."""
    table = table.take(pc.sort_indices(table["id"], null_placement="at_start"))
    order = np.argsort(table["x"].to_numpy(), kind="stable")
    return table.take(pa.array(order)), table["x"].to_numpy()[order], order


def _cat(table: pa.Table) -> np.ndarray:
    return _rows_of(table["cat"]).reshape(len(table), -1)


def _inside(metric: str, weights: list[float], k: int, n_cat: int, cuts: np.ndarray) -> Callable:
    """Nearest rows inside a range, and a row for each other range that a query must visit."""

    def run(table: pa.Table) -> pa.Table:
        table, x, numbers = _by_number(table)
        asked = np.flatnonzero(table["_asked"].to_numpy())
        pairs = _Pairs(metric, weights, _rows_of(table["num"]).reshape(len(table), -1), _cat(table), n_cat)
        limit = _limits(pairs, asked, len(x), k)
        row, column, dist = _search(pairs, x, asked, np.arange(len(x)), numbers, limit, k)
        kth = np.full(len(asked), np.inf)
        full = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        kth[row[full]] = dist[full]
        reach, own = _reach(metric, kth, x[asked]), table["part"][0].as_py()
        first, last = np.searchsorted(cuts, x[asked] - reach, side="left"), np.searchsorted(cuts, x[asked] + reach, side="right")
        # the own range is not visited again
        n = last - first + 1
        who = np.repeat(np.arange(len(asked)), n)
        visited = np.arange(len(who)) + np.repeat(first - np.cumsum(n) + n, n)
        who, visited = who[visited != own], visited[visited != own]
        from_own, away = pa.array(asked[row]), pa.array(asked[who])
        ids, numbers_type = table["id"], pa.list_(pa.float64())
        near = [ids.take(from_own), ids.take(pa.array(column)), pa.array(dist), *(pa.nulls(len(row), t) for t in (pa.int32(), pa.int32(), pa.float64(), numbers_type, numbers_type))]
        gone = [ids.take(away), pa.nulls(len(who), ids.type), pa.array(kth[who]), pa.array(visited.astype(np.int32)), pa.array(np.full(len(who), own, np.int32)),
                pa.array(x[asked][who]), table["num"].take(away), table["cat"].take(away)]
        names = ["qid", "nid", "dist", "visits", "home", "x", "num", "cat"]
        both = [pa.chunked_array([*(a.chunks if isinstance(a, pa.ChunkedArray) else [a]), *(b.chunks if isinstance(b, pa.ChunkedArray) else [b])]) for a, b in zip(near, gone)]
        return pa.table(both, names=names)

    return run


def _visit(metric: str, weights: list[float], k: int, n_cat: int) -> Callable:
    """Nearest rows of a range for the queries that visit it."""

    def run(queries: pa.Table, table: pa.Table) -> pa.Table:
        if not len(queries) or not len(table):
            return pa.table({"qid": queries["qid"].slice(0, 0), "nid": queries["qid"].slice(0, 0), "dist": pa.array([], pa.float64())})
        table, x, numbers = _by_number(table)
        num, cat = (np.vstack([f(table), f(queries)]) for f in (lambda t: _rows_of(t["num"]).reshape(len(t), -1), _cat))
        pairs = _Pairs(metric, weights, num, cat, n_cat)
        x, asked, data = np.append(x, queries["x"].to_numpy()), len(table) + np.arange(len(queries)), np.arange(len(table))
        row, column, dist = _search(pairs, x, asked, data, numbers, queries["dist"].to_numpy(), k)
        return pa.table({"qid": queries["qid"].take(pa.array(row)), "nid": table["id"].take(pa.array(column)), "dist": dist})

    return run


def nearest_mixed(rows: DataFrame, weights: list[float], asked: Column, k: int, metric: str, n_cat: int, block_rows: int = 4096) -> DataFrame:
    """``knn_within`` when the whole table is one group: (grp, qid, nid, dist, rank).

    ``rows`` has (id, num, cat) and the columns of ``asked``, with numbers without their ``weights``; it is
    read several times.  A weight that is not known makes its number missing.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    marked = rows.select("id", "num", "cat", F.coalesce(asked, F.lit(False)).alias("_asked"))
    keys = [F.get("num", F.lit(i)) * w for i, w in enumerate(weights)]
    placed = [F.abs(x) < float("inf") for x in keys]  # false for NaN, which is Spark's largest number
    seen = marked.agg(F.count(F.lit(1)).alias("n"), *[f(F.when(p, x)).alias(f"{n}{i}") for i, (p, x) in enumerate(zip(placed, keys)) for n, f in (("n", F.count), ("s", F.stddev_pop))]).first()
    # the number that most rows have, of these the one that spreads most
    best = max(range(len(keys)), key=lambda i: (seen[f"n{i}"], seen[f"s{i}"] or 0.0), default=None)
    order = W.partitionBy("qid").orderBy("dist", "nid")

    def ranked(found: DataFrame) -> DataFrame:
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return top.select(F.lit(0).alias("grp"), "qid", "nid", "dist", "rank")

    weighed = F.array(*keys).cast("array<double>").alias("num")
    one = marked.select(F.lit(0).alias("grp"), "id", weighed, "cat", "_asked")
    if best is None or not seen[f"n{best}"]:
        return knn_join(one.where("_asked").drop("_asked"), one.drop("_asked"), k, metric, n_cat, block_rows)
    total = seen[f"n{best}"]
    count = max(-(-total // RANGE_ROWS), min(2 * spark.sparkContext.defaultParallelism, total // block_rows), 1)
    inner = marked.where(placed[best]).withColumn("x", keys[best])
    cuts = np.zeros(0)
    if count > 1:
        shares = [i / count for i in range(1, count)]
        cuts = np.sort(np.array(inner.agg(F.percentile_approx("x", shares, max(10_000, 4 * count))).first()[0], dtype=float))

    @F.pandas_udf("int")
    def part(x: pd.Series, draw: pd.Series) -> pd.Series:
        # rows of a value that fills whole ranges are dealt over these
        first, last = np.searchsorted(cuts, x, side="left"), np.searchsorted(cuts, x, side="right")
        return pd.Series(first + draw.to_numpy(np.int64) % (last - first + 1))

    inner = inner.withColumn("part", part("x", F.xxhash64("id")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(count, 4096))
    first = inner.repartition(tasks, "part").groupBy("part").applyInArrow(
        _inside(metric, weights, k, n_cat, cuts), f"qid {kind}, nid {kind}, dist double, visits int, home int, x double, num array<double>, cat array<double>")
    first = materialize(first, "near-rows")
    found = first.where(F.col("visits").isNull()).select("qid", "nid", "dist")

    away = first.where(F.col("visits").isNotNull()).withColumnRenamed("visits", "part")
    reach = F.col("dist") + 10.0**-TIE_DIGITS
    reach = (reach * reach if metric == "product" else reach) * (1 + 1e-9) + F.abs("x") * 1e-14
    ends = away.groupBy("part").agg(
        F.max(F.when(F.col("home") < F.col("part"), F.col("x") + reach)).alias("_below"),
        F.min(F.when(F.col("home") > F.col("part"), F.col("x") - reach)).alias("_above"))
    wanted = inner.join(F.broadcast(ends), "part").where((F.col("x") <= F.col("_below")) | (F.col("x") >= F.col("_above")))
    sides = (away.select("part", "qid", "dist", "x", "num", "cat"), wanted.select("part", "id", "x", "num", "cat"))
    visited, met = (side.repartition(tasks, "part").groupBy("part") for side in sides)
    found = found.unionByName(visited.cogroup(met).applyInArrow(_visit(metric, weights, k, n_cat), f"qid {kind}, nid {kind}, dist double"))
    if total < seen["n"] and metric != "euclidean":
        # rows without that number differ by 1 in it from all rows: they have no place and meet every row
        lost = materialize(marked.where(~F.coalesce(placed[best], F.lit(False))).select(F.lit(0).alias("grp"), "id", weighed, "cat", "_asked"), "rows-without-place")
        every, held = one.drop("_asked"), inner.where("_asked").select(F.lit(0).alias("grp"), "id", weighed, "cat")
        for q, d in ((lost.where("_asked").drop("_asked"), every), (held, lost.drop("_asked"))):
            found = found.unionByName(knn_join(q, d, k, metric, n_cat, block_rows).select("qid", "nid", "dist"))
    return ranked(found)
