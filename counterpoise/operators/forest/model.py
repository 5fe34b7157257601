"""Forest models: the node table and scoring.

A model is small next to the data: it travels to the executors once, and a row is scored
against all trees where it lies.  Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...functions.draw import u
from ...session import fits

MEMORY_ROWS = 500_000
SCHEMA = (
    "tree int, node int, depth int, kind string, attr string, split double, cat_value string, "
    "child_lo int, child_hi int, label string"
)


@dataclass
class Node:
    kind: str  # leaf | numeric | categorical
    depth: int = 0
    attr: str | None = None
    split: float | None = None
    lo: int | None = None
    hi: int | None = None
    branches: dict[str, int] = field(default_factory=dict)
    label: str | None = None


@dataclass
class Forest:
    """Trees as lists of nodes; node 0 is the root."""

    numeric: list[str]
    categorical: list[str]
    trees: list[list[Node]]
    regression: bool = False

    @property
    def size(self) -> int:
        return sum(len(t) for t in self.trees)

    def table(self, spark: SparkSession) -> DataFrame:
        """Node table; a categorical node has one row per branch (branch in child_lo)."""
        rows = []
        for t, nodes in enumerate(self.trees):
            for i, n in enumerate(nodes):
                if n.kind == "categorical":
                    rows += [(t, i, n.depth, n.kind, n.attr, None, v, c, None, None) for v, c in sorted(n.branches.items())]
                else:
                    rows.append((t, i, n.depth, n.kind, n.attr, n.split, None, n.lo, n.hi, n.label))
        return spark.createDataFrame(rows, SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, numeric: list[str], categorical: list[str], regression: bool = False) -> Forest:
        """Read a node table of at most ``MEMORY_ROWS`` rows; defaults of other values need the domains and are left out."""
        if not fits(table, MEMORY_ROWS):
            raise ValueError(f"more than {MEMORY_ROWS} rows: score the model by its tables (nodes.ForestTable)")
        trees: dict[int, dict[int, Node]] = {}
        for r in table.collect():
            node = trees.setdefault(r.tree, {}).setdefault(r.node, Node(r.kind, r.depth))
            node.attr, node.split, node.label = r.attr, r.split, r.label
            if r.kind == "categorical":
                node.label = None
                if r.child_lo is not None:
                    node.branches[r.cat_value] = r.child_lo
            else:
                node.lo, node.hi = r.child_lo, r.child_hi
        return cls(numeric, categorical, [[t[i] for i in range(len(t))] for _, t in sorted(trees.items())], regression)


class _Arrays:
    """One tree as arrays, so a batch of rows steps down together."""

    def __init__(self, nodes: list[Node], forest: Forest, domains: dict[str, dict[str, int]]):
        n = len(nodes)
        self.depth = max((x.depth for x in nodes), default=0)
        self.kind = np.array([{"leaf": 0, "numeric": 1, "categorical": 2}[x.kind] for x in nodes], dtype=np.int8)
        self.attr = np.array(
            [forest.numeric.index(x.attr) if x.kind == "numeric" else forest.categorical.index(x.attr) if x.kind == "categorical" else 0
             for x in nodes], dtype=np.int32)
        self.split = np.array([x.split if x.split is not None else np.nan for x in nodes])
        self.lo = np.array([x.lo if x.lo is not None else -1 for x in nodes], dtype=np.int32)
        self.hi = np.array([x.hi if x.hi is not None else -1 for x in nodes], dtype=np.int32)
        # branches of all categorical nodes as one sorted list of (node, code) keys
        self.width = max([len(d) for d in domains.values()] + [1]) + 1
        keys = sorted(
            (i * self.width + domains[x.attr][v], c) for i, x in enumerate(nodes) for v, c in x.branches.items()
        )
        self.keys = np.array([k for k, _ in keys], dtype=np.int64)
        self.child = np.array([c for _, c in keys], dtype=np.int32)

    def leaves(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Node each row ends at, -1 when a category has no branch."""
        rows = numbers.shape[1] if numbers.size else codes.shape[1]
        at = np.zeros(rows, dtype=np.int32)
        for _ in range(self.depth + 1):
            here = np.where(at >= 0, at, 0)
            kind = np.where(at >= 0, self.kind[here], 0)
            num = np.flatnonzero(kind == 1)
            cat = np.flatnonzero(kind == 2)
            if not len(num) and not len(cat):
                break
            if len(num):
                node = at[num]
                at[num] = np.where(numbers[self.attr[node], num] < self.split[node], self.lo[node], self.hi[node])
            if len(cat):
                node = at[cat]
                code = codes[self.attr[node], cat]
                key = node.astype(np.int64) * self.width + code
                place = np.searchsorted(self.keys, key)
                place = np.minimum(place, max(len(self.keys) - 1, 0))
                found = (code >= 0) & (self.keys[place] == key) if len(self.keys) else np.zeros(len(cat), bool)
                at[cat] = np.where(found, self.child[place] if len(self.keys) else -1, -1)
        return at


def _domains(forest: Forest) -> dict[str, dict[str, int]]:
    values: dict[str, set[str]] = {a: set() for a in forest.categorical}
    for nodes in forest.trees:
        for x in nodes:
            if x.kind == "categorical":
                values[x.attr].update(x.branches)
    return {a: {v: i for i, v in enumerate(sorted(s))} for a, s in values.items()}


def _batches(forest: Forest, answer):
    """Pandas function over Arrow batches; ``answer`` turns leaves (trees x rows) into a column."""
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        domains = _domains(forest)
        trees = [_Arrays(t, forest, domains) for t in forest.trees]
        n_num = len(forest.numeric)
        for part in parts:
            part = (part,) if isinstance(part, pd.Series) else part  # one column comes without its tuple
            size = len(part[0])
            numbers = np.array([s.to_numpy(dtype=float) for s in part[:n_num]]).reshape(n_num, size)
            codes = np.array(
                [s.map(domains[a]).fillna(-1).to_numpy(dtype=np.int64) for a, s in zip(forest.categorical, part[n_num:])],
                dtype=np.int64,
            ).reshape(len(forest.categorical), size)
            yield pd.Series(answer([t.leaves(numbers, codes) for t in trees]))

    return run


def _inputs(forest: Forest) -> list[Column]:
    return [F.col(c).cast("double") for c in forest.numeric] + [F.col(c).cast("string") for c in forest.categorical]


def loaded(forest) -> Forest:
    """A forest in memory, whichever form it has."""
    return forest if isinstance(forest, Forest) else forest.in_memory


def leaf_column(forest) -> Column:
    """array<int>: the node each tree ends at, -1 for none."""
    forest = loaded(forest)

    def answer(leaves: list[np.ndarray]) -> list:
        return list(np.array(leaves).T)

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return _batches(forest, answer)(parts)

    return F.pandas_udf(run, "array<int>")(*_inputs(forest))


def votes_column(forest) -> Column:
    """array<string>: each tree's prediction, null for none."""
    forest = loaded(forest)

    def answer(leaves: list[np.ndarray]) -> list:
        columns = []
        for nodes, at in zip(forest.trees, leaves):
            labels = np.array([x.label for x in nodes] + [None], dtype=object)
            columns.append(labels[at])
        return [list(row) for row in np.array(columns, dtype=object).T]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return _batches(forest, answer)(parts)

    return F.pandas_udf(run, "array<string>")(*_inputs(forest))


def tree_votes(df: DataFrame, forest, out: str = "votes", ids: list[str] | None = None) -> DataFrame:
    """Adds each tree's prediction as an array.

    A model that fits memory travels to the rows; a larger one is joined round by round, for which
    ``ids`` must name unique columns.
    """
    if isinstance(forest, Forest) or forest.fits_memory:
        return df.withColumn(out, votes_column(forest))
    return forest.votes(df, ids, out)


def predict(df: DataFrame, forest, ids: list[str], out: str = "prediction", seed="vote") -> DataFrame:
    """Adds the majority of the trees (ties by a seeded draw) or their mean; null if no tree predicts."""
    voted = tree_votes(df, forest, "_votes", ids)
    known = F.filter("_votes", lambda v: v.isNotNull())
    if forest.regression:
        numbers = F.transform(known, lambda v: v.cast("double"))
        total = F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)
        return voted.withColumn(out, F.try_divide(total, F.size(numbers))).drop("_votes")
    voted = voted.withColumn("_known", known)
    ballot = F.transform(
        F.array_distinct("_known"),
        lambda v: F.struct(F.size(F.filter("_known", lambda w: w == v)).alias("n"), u(seed, *ids, v).alias("u"), v.alias("v")),
    )
    return voted.withColumn(out, F.array_max(ballot)["v"]).drop("_votes", "_known")


def tree_predictions(df: DataFrame, forest, ids: list[str]) -> DataFrame:
    """Long form of the prediction matrix: (ids, tree, prediction)."""
    return tree_votes(df, forest, ids=ids).select(*ids, F.posexplode("votes").alias("tree", "prediction"))


def score(df: DataFrame, forest, ids: list[str], label: str, seed="vote") -> DataFrame:
    """(ids, true label, prediction) of every row."""
    return predict(df, forest, ids, seed=seed).select(*ids, label, "prediction")


def decision_paths(df: DataFrame, forest, ids: list[str], tree: int = 0) -> DataFrame:
    """(ids, path): the tests a row passes in one tree and the label it gets."""
    forest = loaded(forest)
    nodes = forest.trees[tree]
    steps: dict[int, str] = {0: ""}
    for i, x in enumerate(nodes):
        here = steps[i]
        if x.kind == "numeric":
            steps[x.lo] = f"{here}{x.attr} < {x.split:g} -> "
            steps[x.hi] = f"{here}{x.attr} >= {x.split:g} -> "
        for v, c in x.branches.items():
            steps[c] = f"{here}{x.attr} = {v} -> "
    ends = [f"{steps[i]}{x.label}" if x.kind == "leaf" else None for i, x in enumerate(nodes)] + ["unknown"]
    single = Forest(forest.numeric, forest.categorical, [nodes], forest.regression)

    def answer(leaves: list[np.ndarray]) -> list:
        return [ends[i] for i in leaves[0]]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        return _batches(single, answer)(parts)

    return df.select(*ids, F.pandas_udf(run, "string")(*_inputs(single)).alias("path"))


def statistics(table: DataFrame) -> DataFrame:
    """One row: trees, nodes in all, mean nodes per tree, mean of the trees' greatest depths."""
    per_tree = table.groupBy("tree").agg(F.count_distinct("node").alias("nodes"), F.max("depth").alias("depth"))
    return per_tree.agg(
        F.count(F.lit(1)).alias("trees"), F.sum("nodes").alias("nodes"), F.avg("nodes").alias("mean_nodes"),
        F.avg("depth").alias("mean_depth"),
    )


def tree_statistics(table: DataFrame) -> DataFrame:
    """Nodes, leaves and greatest depth of each tree."""
    return table.groupBy("tree").agg(
        F.count_distinct("node").alias("nodes"), F.count_if(F.col("kind") == "leaf").alias("leaves"),
        F.max("depth").cast("int").alias("depth"),
    )
