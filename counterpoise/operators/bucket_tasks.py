"""Work on whole buckets: statistics, neighbours and what is made of them, in the task where a bucket lies.

A row is shuffled once, to its bucket, and its result is final.  This needs buckets of bounded size and ids
that come once; ``smote`` looks for both and else takes the way by tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.distance import TIE_DIGITS
from ..functions.draw import u_value
from .knn import _CHUNK, _best, _distances


def ids_come_once(df: DataFrame, id_col: str) -> bool:
    """False if an id comes twice or is missing, or if the hashes of two ids agree."""
    seen = df.groupBy(F.xxhash64(id_col).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"))
    return seen.where((F.col("n") > 1) | (F.col("ids") < 1)).isEmpty()


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy()


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(place of each value among the sorted values, -1 if missing; the sorted values)."""
    values = pc.unique(column.combine_chunks()).drop_null()
    values = values.take(pc.sort_indices(values))
    return pc.fill_null(pc.index_in(column, values), -1).to_numpy(), values


def _features(group: pa.Table, labels: np.ndarray, classes: int, numeric: list[str], categorical: list[str], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and class shares of the categories of one bucket, as ``smote.features`` has them."""
    num, cat = [], []
    for c in numeric:
        x, valid = _numbers(group[c]), group[c].is_valid().to_numpy()
        sigma = x[valid].std() if valid.any() else np.nan
        if metric == "product":
            x = x * sigma / 4
        elif metric == "standard":
            x = x * 0.0 if sigma == 0 or not valid.any() else x / (4 * sigma)
        num.append(x)
    for c in categorical if metric != "euclidean" else ():
        code, values = _codes(group[c])
        known = code >= 0
        counts = np.bincount(code[known] * classes + labels[known], minlength=len(values) * classes).reshape(len(values), classes)
        shares = np.full((len(values) + 1, classes), np.nan)  # the last for missing ones
        shares[:-1] = counts / counts.sum(axis=1, keepdims=True)
        cat.append(shares[code])
    n = len(group)
    return np.stack(num, axis=1) if num else np.zeros((n, 0)), np.stack(cat, axis=1) if cat else np.zeros((n, 0, 1))


def _neighbours(num: np.ndarray, cat: np.ndarray, asked: np.ndarray, pool: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in ``asked``, row of the neighbour, distance) by rank; rows lie in the order of their ids."""
    step, found = max(1, _CHUNK // max(1, len(pool))), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(asked), step):
        part = asked[lo : lo + step]
        dist = np.round(_distances(metric, num[part], num[pool], cat[part], cat[pool]), TIE_DIGITS)
        dist[dist == 0] = np.inf
        row, column = _best(dist, k)
        found.append((row + lo, pool[column], dist[row, column]))
    return tuple(map(np.concatenate, zip(*found)))


def _by_id(group: pa.Table, id_col: str) -> pa.Table:
    return group.take(pc.sort_indices(group[id_col]))


def classify(df: DataFrame, label: str, id_col: str, numeric: list[str], categorical: list[str], k: int, metric: str) -> DataFrame:
    """(id, predicted, votes): leave-one-out vote of the k nearest rows of each bucket."""
    types = dict(df.dtypes)

    def run(group: pa.Table) -> pa.Table:
        group = _by_id(group, id_col)
        labels, names = _codes(group[label])
        num, cat = _features(group, labels, len(names), numeric, categorical, metric)
        every = np.arange(len(group))
        row, column, _ = _neighbours(num, cat, every, every, k, metric)
        votes = np.bincount(row * len(names) + labels[column], minlength=len(group) * len(names)).reshape(len(group), len(names))
        # lowest label on ties
        best, held = votes.argmax(axis=1), np.flatnonzero(votes.any(axis=1))
        return pa.table({id_col: group[id_col].take(pa.array(held)), "predicted": names.take(pa.array(best[held])), "votes": votes.max(axis=1)[held].astype(np.int64)})

    columns = df.select("grp", *dict.fromkeys([id_col, label, *numeric, *categorical]))
    return columns.groupBy("grp").applyInArrow(run, f"`{id_col}` {types[id_col]}, predicted {types[label]}, votes long")


def balance(
    df: DataFrame, label: str, id_col: str, numeric: list[str], categorical: list[str], minority, lack: int, buckets: int,
    k: int = 5, metric: str = "product", neighbors: str = "all", compat: bool = False, seed="smote", **_,
) -> DataFrame:
    """Rows of each bucket and the synthetic ones it adds: (id as text, label, columns, synthetic).

    The draws are those of ``smote.synthesize``; ``lack`` is what the table lacks.
    """
    types = dict(df.dtypes)
    schema = [f"id string, label {types[label]}", *(f"n{i} double" for i in range(len(numeric))), *(f"c{i} {types[c]}" for i, c in enumerate(categorical)), "synthetic int"]

    def table(group: pa.Table, ids, numbers: list, values: list, synthetic: int) -> pa.Table:
        made = {"id": ids, "label": group[label], **{f"n{i}": x for i, x in enumerate(numbers)}, **{f"c{i}": x for i, x in enumerate(values)}}
        return pa.table({**made, "synthetic": pa.array(np.full(len(group), synthetic, np.int32))})

    def run(group: pa.Table) -> pa.Table:
        group = _by_id(group, id_col)
        grp, labels, names = group["grp"][0].as_py(), *_codes(group[label])
        given = table(group, group[id_col].cast(pa.string()), [group[c].cast(pa.float64()) for c in numeric], [group[c] for c in categorical], 0)
        own = np.flatnonzero(labels == names.index(pa.scalar(minority, names.type)).as_py())
        share = lack // buckets + (grp < lack % buckets)
        if share <= 0 or not len(own):
            return given
        num, cat = _features(group, labels, len(names), numeric, categorical, metric)
        row, column, _ = _neighbours(num, cat, own, own if neighbors == "minority" else np.arange(len(group)), k, metric)
        first, n = np.searchsorted(row, np.arange(len(own))), np.bincount(row, minlength=len(own))
        draws = [u_value(f"{seed}-order", i) for i in group[id_col].take(pa.array(own)).to_pylist()]
        turn = np.argsort(draws, kind="stable")  # rows lie by id, which breaks ties

        def drawn(name: str) -> np.ndarray:
            return np.array([u_value(f"{seed}-{name}", grp, i) for i in range(share)])

        parent = turn[np.arange(share) % len(own)]
        usable = n[parent] - 1 if compat else n[parent]
        choice = np.floor(drawn("nn") * np.maximum(usable, 1)).astype(np.int64)
        # a row without neighbours stays where it is
        some = n[parent] > 0
        other = own[parent]
        other[some] = column[(first[parent] + choice)[some]]
        parent, gap = own[parent], drawn("gap")
        numbers = []
        for c in numeric:
            x = _numbers(group[c])
            numbers.append(pa.array(x[parent] + gap * (x[other] - x[parent])))
        values = [group[c].take(pa.array(np.where(drawn(f"cat-{c}") < 0.5, parent, other))) for c in categorical]
        ids = pa.array([f"syn-{grp}-{i}" for i in range(share)])
        return pa.concat_tables([given, table(group.take(pa.array(parent)), ids, numbers, values, 1).cast(given.schema)])

    columns = df.select("grp", *dict.fromkeys([id_col, label, *numeric, *categorical]))
    found = columns.groupBy("grp").applyInArrow(run, ", ".join(schema))
    return found.select(
        F.col("id").alias(id_col), F.col("label").alias(label), *[F.col(f"n{i}").alias(c) for i, c in enumerate(numeric)],
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(categorical)], "synthetic")
