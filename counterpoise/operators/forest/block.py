"""The last levels of a forest, whose open nodes hold few rows: grown, and walked, as arrays in a task.

Node numbers follow from all open nodes of a level and the attributes a node draws follow from its
number, so the open nodes of a level are numbered together.  The rules are those of ``train``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ...functions.draw import u_value
from .split import Target

GROWN = "tree int, node long, depth int, kind string, attr int, split double, child long, code long, stats array<long>"
KINDS = ("leaf", "numeric", "categorical", "retry")
LEAF, NUMERIC, CATEGORICAL, RETRY = range(4)
GAIN_DIGITS = 9


@dataclass(frozen=True)
class Rules:
    """Growth rules; ``widths`` holds the number of values of each categorical attribute."""

    target: Target
    names: list[str]
    n_numeric: int
    m: int
    min_split: int
    min_gain: float
    max_depth: int | None
    retry: bool
    seed: str
    widths: dict[int, int]

    def drawn(self, tree: np.ndarray, node: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The random attributes of each node in drawn order, -1 where there are no more."""
        out = np.full((len(node), min(self.m, len(self.names))), -1)
        for k, (t, n) in enumerate(zip(tree.tolist(), node.tolist())):
            free = sorted((u_value(self.seed, t, n, name), name, i) for i, name in enumerate(self.names) if not used[k, i])
            chosen = [i for _, _, i in free[: self.m]]
            out[k, : len(chosen)] = chosen
        return out

    def finished(self, stats: np.ndarray, used: np.ndarray, depth: np.ndarray) -> np.ndarray:
        done = ((stats > 0).sum(axis=1) <= 1) | (used.sum(axis=1) >= len(self.names))
        return done if self.max_depth is None else done | (depth >= self.max_depth)

    def gain(self, whole: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return (self.target.impurity_of(whole) - parts) / whole.sum(axis=1)


def cells(node: np.ndarray, code: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, code, counts by class) of each pair that occurs, in order."""
    width = int(code.max()) + 1
    keys, place = np.unique(node * width + code, return_inverse=True)
    counts = np.bincount(place * classes + y, weights=w, minlength=len(keys) * classes)
    return keys // width, keys % width, counts.reshape(-1, classes)


def first_of(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))


def grow(rows: dict[str, np.ndarray], numbers: list[np.ndarray], rules: Rules, base: int) -> Iterator[pa.RecordBatch]:
    """All levels below the open nodes that ``rows`` are at: nodes as in ``GROWN``, kind 'branch' for the branches.

    ``rows`` has tree, node, depth, used, y (class number), w and a code for each attribute; ``numbers``
    holds the value of each code of a numeric attribute.
    """
    classes, n_names = len(rules.target.classes), len(rules.names)
    y, w = rows["y"], rows["w"]
    codes = [rows[f"x{i}"] for i in range(n_names)]
    order = np.lexsort((rows["node"], rows["tree"]))
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(rows["tree"][order]) != 0) | (np.diff(rows["node"][order]) != 0))))
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(np.isin(np.arange(len(order)), starts)) - 1
    tree, node, depth, used = (rows[n][order[starts]] for n in ("tree", "node", "depth", "used"))

    def shown(kind, stats, tree, node, depth, attr=None, split=None, child=None, code=None) -> pa.RecordBatch:
        """``attr`` -1 is none; a split is there where the attribute is a number."""
        none = np.full(len(node), -1)
        attr, child, code = (none if c is None else c for c in (attr, child, code))
        number = (attr >= 0) & (attr < rules.n_numeric) & (split is not None)
        return pa.RecordBatch.from_arrays([
            pa.array(tree, pa.int32()), pa.array(node, pa.int64()), pa.array(depth, pa.int32()), pa.array(np.broadcast_to(np.array(kind, object), len(node)), pa.string()),
            pa.array(attr, pa.int32(), mask=attr < 0), pa.array(none.astype(float) if split is None else split, pa.float64(), mask=~number),
            pa.array(child, pa.int64(), mask=child < 0), pa.array(code, pa.int64(), mask=code < 0), pa.array(list(stats.astype(np.int64)), pa.list_(pa.int64())),
        ], ["tree", "node", "depth", "kind", "attr", "split", "child", "code", "stats"])

    while len(node):
        n = len(node)
        drawn = rules.drawn(tree, node, used)
        total = np.bincount(at * classes + y, weights=w, minlength=n * classes).reshape(n, classes)
        best = {"order": np.full(n, np.inf), "gain": np.full(n, np.nan), "attr": np.full(n, -1), "code": np.full(n, -1), "big": np.zeros(n, np.int64)}
        low = np.zeros((n, classes))
        for rank in range(drawn.shape[1]):
            for i in range(n_names):
                mine = np.flatnonzero(drawn[at, rank] == i)
                if not len(mine):
                    continue
                owner, code, counts = cells(at[mine], codes[i][mine], y[mine], w[mine], classes)
                first = first_of(owner)
                found = owner[first]
                if i < rules.n_numeric:
                    left = np.cumsum(counts, axis=0) - counts
                    group = np.cumsum(np.isin(np.arange(len(owner)), first)) - 1
                    left -= left[first][group]
                    whole = total[owner]
                    gain = rules.gain(whole, rules.target.impurity_of(left) + rules.target.impurity_of(whole - left))
                    chosen = np.lexsort((code, -np.round(gain, GAIN_DIGITS), owner))[first]
                    gain, at_code, at_left, big = gain[chosen], code[chosen], left[chosen], np.zeros(len(found), np.int64)
                else:
                    within = np.add.reduceat(rules.target.impurity_of(counts), first)
                    gain, at_code, at_left = rules.gain(total[found], within), np.full(len(found), -1), np.zeros((len(found), classes))
                    big = np.add.reduceat((counts.sum(axis=1) >= rules.min_split).astype(np.int64), first)
                better = -np.round(gain, GAIN_DIGITS) < best["order"][found]
                to = found[better]
                best["order"][to], best["gain"][to], best["attr"][to] = -np.round(gain, GAIN_DIGITS)[better], gain[better], i
                best["code"][to], best["big"][to], low[to] = at_code[better], big[better], at_left[better]

        attr, numeric = best["attr"], (best["attr"] >= 0) & (best["attr"] < rules.n_numeric)
        tried = used.copy()
        tried[np.arange(n)[attr >= 0], attr[attr >= 0]] = True
        poor = ~(best["gain"] >= rules.min_gain)
        kind = np.full(n, LEAF)
        kind[~numeric & (best["big"] >= 2)] = CATEGORICAL
        kind[numeric & (low.sum(axis=1) >= rules.min_split) & ((total - low).sum(axis=1) >= rules.min_split)] = NUMERIC
        kind[poor] = LEAF
        if rules.retry:
            kind[poor & ~rules.finished(total, tried, depth)] = RETRY
        kind[(attr < 0) | rules.finished(total, used, depth)] = LEAF

        widths = np.array([rules.widths.get(i, 0) for i in range(n_names)] + [0])
        span = np.where(kind == NUMERIC, 2, np.where(kind == CATEGORICAL, widths[attr], 0))
        upto = np.cumsum(span)
        first = first_of(tree)
        child = base + upto - span - np.repeat((upto - span)[first], np.diff(np.append(first, n)))
        after = np.where((kind == NUMERIC)[:, None], used & (np.arange(n_names) >= rules.n_numeric), np.where(np.isin(kind, (CATEGORICAL, RETRY))[:, None], tried, used))
        split = np.full(n, np.nan)
        for i in range(rules.n_numeric):
            split[attr == i] = numbers[i][best["code"][attr == i]]
        done = kind != RETRY
        yield shown(np.array(KINDS, object)[kind[done]], total[done], tree[done], node[done], depth[done], attr[done], split[done], child[done])

        # where each row goes: both halves of a number, the values that rows have of a category, the same node again
        parent = [np.flatnonzero(kind == NUMERIC).repeat(2)]
        place, stats = [child[parent[0]] + np.tile([0, 1], len(parent[0]) // 2)], [np.where(np.tile([True, False], len(parent[0]) // 2)[:, None], low[parent[0]], (total - low)[parent[0]])]
        moved, stay = np.full(len(at), -1), kind[at]
        for i in range(n_names):
            mine = np.flatnonzero(((stay == NUMERIC) | (stay == CATEGORICAL)) & (attr[at] == i))
            if not len(mine):
                continue
            if i < rules.n_numeric:
                moved[mine] = child[at[mine]] + (codes[i][mine] >= best["code"][at[mine]])
            else:
                moved[mine] = child[at[mine]] + codes[i][mine]
                owner, code, counts = cells(at[mine], codes[i][mine], y[mine], w[mine], classes)
                parent.append(owner), place.append(child[owner] + code), stats.append(counts)
                yield shown("branch", counts, tree[owner], node[owner], depth[owner], np.full(len(owner), i), None, child[owner] + code, code)
        parent, place, stats = np.concatenate(parent), np.concatenate(place), np.concatenate(stats)
        below = {"tree": tree[parent], "node": place, "depth": depth[parent] + 1, "used": after[parent]}
        closed = (stats.sum(axis=1) == 0) | rules.finished(stats, below["used"], below["depth"])
        yield shown("leaf", stats[closed], below["tree"][closed], place[closed], below["depth"][closed])
        base = max(base, int(place.max()) + 1 if len(place) else 1)

        again = np.flatnonzero(kind == RETRY)
        new = {k: np.concatenate((v[~closed], old)) for (k, v), old in zip(below.items(), (tree[again], node[again], depth[again], after[again]))}
        moved[stay == RETRY] = node[at[stay == RETRY]]
        order = np.lexsort((new["node"], new["tree"]))
        old_tree = tree[at]
        tree, node, depth, used = (new[k][order] for k in ("tree", "node", "depth", "used"))
        if not len(node):
            return
        kept = moved >= 0
        found = locate(tree, node, old_tree[kept], moved[kept])
        rest = np.flatnonzero(kept)[found >= 0]
        at, y, w, codes = found[found >= 0], y[rest], w[rest], [c[rest] for c in codes]


def locate(tree: np.ndarray, node: np.ndarray, of_tree: np.ndarray, of_node: np.ndarray) -> np.ndarray:
    """Place of each (tree, node) asked for in the sorted pairs, -1 if it is not there."""
    nodes = np.unique(node)
    key = tree.astype(np.int64) * len(nodes) + np.searchsorted(nodes, node)
    place = np.searchsorted(nodes, of_node)
    there = nodes[np.minimum(place, len(nodes) - 1)] == of_node
    asked = of_tree.astype(np.int64) * len(nodes) + place
    found = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    return np.where(there & (key[found] == asked), found, -1)


def grown(rows: DataFrame, rules: Rules, base: int) -> DataFrame:
    """Nodes below the open nodes, as in ``GROWN``, of (tree, node, depth, used, y, w, x0, x1, ...) rows known to be few."""
    n_names = len(rules.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        given = pa.Table.from_batches(parts).to_pandas()
        held = {c: given[c].to_numpy(np.int64) for c in ("tree", "node", "depth", "y", "w")}
        held["used"] = np.array([[i in set(u) for i in range(n_names)] for u in given["used"]], bool).reshape(len(given), n_names)
        numbers = []
        for i in range(n_names):
            if i < rules.n_numeric:
                values, held[f"x{i}"] = np.unique(given[f"x{i}"].to_numpy(float) + 0.0, return_inverse=True)
                numbers.append(values)
            else:
                held[f"x{i}"] = given[f"x{i}"].to_numpy(np.int64)
        for part in grow(held, numbers, rules, base):
            if part.num_rows:
                yield part

    return rows.repartition(1).mapInArrow(run, GROWN)


class Walk:
    """Nodes of the last levels as arrays, so that a batch of rows steps down together."""

    def __init__(self, nodes: pd.DataFrame, branches: pd.DataFrame, attrs: list[str], complemented: bool):
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.tree, self.node = nodes["tree"].to_numpy(np.int64), nodes["node"].to_numpy(np.int64)
        self.kind = nodes["kind"].map({k: i for i, k in enumerate(KINDS)}).to_numpy()
        self.attr = nodes["attr"].map({a: i for i, a in enumerate(attrs)}).fillna(-1).to_numpy(np.int64)
        self.split, self.child = nodes["split"].to_numpy(float), nodes["child"].fillna(-1).to_numpy(np.int64)
        self.label, self.attrs, self.complemented = nodes["label"].to_numpy(object), attrs, complemented
        text = [f"{a} " if a is not None else "" for a in nodes["attr"]]
        self.tests = [np.array([f"{t}{sign} {s} -> " for t, s in zip(text, nodes["shown"])], object) for sign in ("<", ">=")]
        branches = branches.assign(at=locate(self.tree, self.node, branches["tree"].to_numpy(np.int64), branches["node"].to_numpy(np.int64)))
        branches = branches.sort_values(["at", "code"])
        self.branch = branches["at"].to_numpy(np.int64), branches["code"].to_numpy(np.int64)
        self.to = branches["child"].to_numpy(np.int64)

    def end(self, tree: np.ndarray, at: np.ndarray, values: list, codes: dict[int, np.ndarray], path: np.ndarray, depth: np.ndarray):
        """(place is known, label, depth, path) of each row; ``values`` are numbers or words by attribute, code -1 for unknown words."""
        here = locate(self.tree, self.node, tree, at)
        known, label = here >= 0, np.full(len(at), None, object)
        path, depth, active = path.copy(), depth.copy(), np.flatnonzero(here >= 0)
        while len(active):
            kind = self.kind[here[active]]
            ended = active[kind == LEAF]
            label[ended] = self.label[here[ended]]
            to = np.full(len(at), -1)
            for i in range(len(self.attrs)):
                mine = active[(kind != LEAF) & (self.attr[here[active]] == i)]
                if not len(mine):
                    continue
                n = here[mine]
                depth[mine] += 1
                if i not in codes:
                    x, split = values[i][mine], self.split[n]
                    # as Spark orders numbers, NaN is above all others
                    low = (x < split) | (np.isnan(split) & ~np.isnan(x))
                    path[mine] = path[mine] + np.where(low, self.tests[0][n], self.tests[1][n])
                    to[mine] = self.child[n] + np.where(low, 0, 1)
                else:
                    code = codes[i][mine]
                    place = locate(*self.branch, n, code) if len(self.to) else np.full(len(mine), -1)
                    other, domain = place < 0, code >= 0
                    named = ~other | (domain & self.complemented)
                    path[mine] = [f"{p}{self.attrs[i]} = {v} -> " if ok else None for p, v, ok in zip(path[mine], values[i][mine], named)]
                    label[mine[other & named]] = self.label[n[other & named]]
                    to[mine[~other]] = self.to[place[~other]]
            active = np.flatnonzero(to >= 0)
            here[active] = locate(self.tree, self.node, tree[active], to[active])
        return known, label, depth, path


def walked(here: DataFrame, nodes: DataFrame, branches: DataFrame, numeric: list[str], categorical: list[str], ids: list[str], complemented: bool) -> DataFrame:
    """(ids, tree, label, depth, path) of rows at (tree, _at): the last levels, known to be few nodes, travel to the rows."""
    given = Walk(
        nodes.withColumn("shown", F.col("split").cast("string")).toPandas(), branches.select("tree", "node", "code", "child").toPandas(),
        [*numeric, *categorical], complemented)
    walk = here.sparkSession.sparkContext.broadcast(given)
    n_numeric, names = len(numeric), [f"_x{i}" for i in range(len(numeric))] + [f"_g{i}" for i in range(len(categorical))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def of(c: str) -> pd.Series:
                return batch.column(batch.schema.get_field_index(c)).to_pandas()

            values = [of(c).to_numpy(float if i < n_numeric else object) for i, c in enumerate(names)]
            codes = {i: of(f"{c}_code").fillna(-1).to_numpy(np.int64) for i, c in enumerate(names) if i >= n_numeric}
            known, label, depth, path = walk.value.end(
                of("tree").to_numpy(np.int64), of("_at").to_numpy(np.int64), values, codes, of("_path").to_numpy(object), of("_depth").to_numpy(np.int64))
            out = [batch.column(batch.schema.get_field_index(c)) for c in (*ids, "tree")]
            out += [pa.array(label, pa.string()), pa.array(depth, pa.int32()), pa.array(path, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*ids, "tree", "label", "depth", "path"]).filter(pa.array(known))

    types = dict(here.dtypes)
    return here.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in (*ids, "tree")] + ["label string", "depth int", "path string"]))
