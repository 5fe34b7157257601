"""Forests as tables of nodes: models of any size, and scoring by joins.

A model is a list of rounds.  The nodes of a round are those decided in one training pass, so
a child is always in a later round than its parent.  A categorical node keeps a branch for every
value its rows have, and a default label for the other values of the training table; values the
training table never had lead nowhere.  Rows are scored round by round with a join on (tree, node);
each round is a written table with a known size, so small ones are broadcast by Spark itself.
The last levels, whose rows were few, are one table that travels to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ...session import materialize
from .block import walked
from .model import Forest, Node

MEMORY_BYTES = 64 << 20
NODE_BYTES = 160


@dataclass
class ForestTable:
    """``rounds``: (tree, node, depth, kind, attr, split, child, label); numeric children are ``child`` and
    ``child + 1``.  ``steps``: (tree, node, attr, code, child) of the categorical nodes of each round.
    ``values``: (attr, value, code), the domains.  With ``complemented`` a categorical node's label holds
    for the values of its domain that have no branch.  ``last`` holds the nodes and the steps of all levels
    below the rounds, a bounded number."""

    numeric: list[str]
    categorical: list[str]
    n_trees: int
    rounds: list[DataFrame]
    steps: list[DataFrame]
    values: DataFrame
    complemented: bool = True
    regression: bool = False
    last: tuple[DataFrame, DataFrame] | None = None

    @property
    def nodes(self) -> DataFrame:
        return reduce(DataFrame.union, self.rounds + ([self.last[0]] if self.last else []))

    @property
    def branches(self) -> DataFrame:
        """(tree, node, value, child)"""
        return reduce(DataFrame.union, self.steps + ([self.last[1]] if self.last else [])).join(self.values, ["attr", "code"]).select("tree", "node", "value", "child")

    @cached_property
    def fits_memory(self) -> bool:
        """Whether the model, with all defaults as branches, stays within ``MEMORY_BYTES`` in a task."""
        size = F.coalesce(F.sum(F.octet_length("value") + NODE_BYTES), F.lit(0))
        total = self.nodes.count() * NODE_BYTES + self.branches.agg(size).first()[0]
        if self.complemented and total <= MEMORY_BYTES:
            width = self.values.groupBy("attr").agg(size.alias("_bytes"))
            splits = self.nodes.where(F.col("kind") == "categorical").groupBy("attr").agg(F.count(F.lit(1)).alias("_n"))
            total += splits.join(width, "attr").agg(F.coalesce(F.sum(F.col("_n") * F.col("_bytes")), F.lit(0))).first()[0]
        return total <= MEMORY_BYTES

    @cached_property
    def in_memory(self) -> Forest:
        """The same model as lists of nodes, for models known to be small."""
        if not self.fits_memory:
            raise ValueError(f"the model has more than {MEMORY_BYTES} bytes: score it by its tables")
        domains: dict[str, list[str]] = {}
        for r in self.values.collect() if self.complemented else []:
            domains.setdefault(r["attr"], []).append(r["value"])
        rows = sorted(self.nodes.collect(), key=lambda r: (r["tree"], r["node"]))
        place: dict[tuple[int, int], int] = {}
        trees: list[list[Node]] = []
        for r in rows:
            while len(trees) <= r["tree"]:
                trees.append([])
            place[r["tree"], r["node"]] = len(trees[r["tree"]])
            trees[r["tree"]].append(Node(r["kind"], r["depth"], r["attr"], r["split"], label=r["label"]))
        for r in rows:
            node = trees[r["tree"]][place[r["tree"], r["node"]]]
            if r["kind"] == "numeric":
                node.lo, node.hi = (place[r["tree"], r["child"] + i] for i in (0, 1))
        for r in self.branches.orderBy("tree", "node", "value").collect():
            trees[r["tree"]][place[r["tree"], r["node"]]].branches[r["value"]] = place[r["tree"], r["child"]]
        for nodes in trees:
            for node in [n for n in nodes if n.kind == "categorical"]:
                other = [v for v in domains.get(node.attr, ()) if v not in node.branches]
                if other:
                    nodes.append(Node("leaf", node.depth + 1, label=node.label))
                    node.branches |= dict.fromkeys(other, len(nodes) - 1)
                node.label = None
        return Forest(self.numeric, self.categorical, trees, self.regression)

    @property
    def trees(self) -> list[list[Node]]:
        return self.in_memory.trees

    def votes(self, df: DataFrame, ids: list[str], out: str) -> DataFrame:
        """Each tree's prediction as an array, by joins."""
        found = leaves(df, self, ids).groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("tree", "label"))).alias("_found"))
        found = found.select(*[F.col(c).alias(f"_k_{c}") for c in ids], F.transform("_found", lambda v: v["label"]).alias(out))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ids])
        return df.join(found, on).drop(*[f"_k_{c}" for c in ids])

    def table(self, spark: SparkSession) -> DataFrame:
        """Node table; a categorical node has one row per branch (branch in ``child_lo``) and, with domains,
        one without a value that carries the label of their other values."""
        none = F.lit(None)
        nodes, splits = self.nodes, self.nodes.where(F.col("kind") == "categorical")
        plain = nodes.where(F.col("kind") != "categorical").select(
            "tree", "node", "depth", "kind", "attr", "split", none.cast("string").alias("cat_value"),
            F.when(F.col("kind") == "numeric", F.col("child")).alias("child_lo"),
            F.when(F.col("kind") == "numeric", F.col("child") + 1).alias("child_hi"), F.when(F.col("kind") == "leaf", F.col("label")).alias("label"))
        wide = splits.drop("child").join(self.branches, ["tree", "node"]).select(
            "tree", "node", "depth", "kind", "attr", none.cast("double"), "value", "child", none.cast("long"), none.cast("string"))
        out = plain.union(wide)
        if self.complemented:
            out = out.union(splits.select(
                "tree", "node", "depth", "kind", "attr", none.cast("double"), none.cast("string"), none.cast("long"), none.cast("long"), "label"))
        return out


def leaves(df: DataFrame, forest: ForestTable, ids: list[str]) -> DataFrame:
    """(ids, tree, label, depth, path) of every row and tree, by joins with the rounds.

    ``path`` lists the tests passed.  Label and path are null where a category was not in training.
    Rows of one shallow node share a join key: rounds that small are broadcast, larger ones have
    many nodes.
    """
    numbers, words = [f"_x{i}" for i in range(len(forest.numeric))], [f"_g{i}" for i in range(len(forest.categorical))]
    here = df.select(
        *ids, *[F.col(c).cast("double").alias(x) for c, x in zip(forest.numeric, numbers)],
        *[F.col(c).cast("string").alias(x) for c, x in zip(forest.categorical, words)])
    for name, x in zip(forest.categorical, words):
        codes = forest.values.where(F.col("attr") == name).select(F.col("value").alias(x), F.col("code").alias(f"{x}_code"))
        here = here.join(codes, x, "left")
    kept = [*ids, "tree", *numbers, *words, *[f"{x}_code" for x in words]]
    here = here.withColumns({
        "tree": F.explode(F.sequence(F.lit(0), F.lit(forest.n_trees - 1))), "_at": F.lit(0).cast("long"), "_path": F.lit(""),
        "_label": F.lit(None).cast("string"), "_depth": F.lit(0), "_open": F.lit(True)})

    def of_attr(columns: dict[str, str], kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name, x in columns.items():
            out = F.when(F.col("_attr") == name, F.col(x)).otherwise(out)
        return out

    out = None
    for nodes, branches in zip(forest.rounds, forest.steps):
        node = nodes.select("tree", F.col("node").alias("_at"), *[F.col(c).alias(f"_{c}") for c in ("kind", "attr", "split", "child")], F.col("label").alias("_answer"))
        met = here.join(node, ["tree", "_at"], "left").withColumns({
            "_number": of_attr(dict(zip(forest.numeric, numbers)), "double"), "_word": of_attr(dict(zip(forest.categorical, words)), "string"),
            "_code": of_attr({n: f"{x}_code" for n, x in zip(forest.categorical, words)}, "long"), "_to": F.lit(None).cast("long")})
        if words:
            branch = branches.select("tree", F.col("node").alias("_at"), F.col("code").alias("_code"), F.col("child").alias("_branch"))
            met = met.join(branch, ["tree", "_at", "_code"], "left").withColumn("_to", F.col("_branch")).drop("_branch")
        kind = F.col("_kind")
        below = F.coalesce(F.col("_number") < F.col("_split"), F.lit(False))
        other = (kind == "categorical") & F.col("_to").isNull()
        known = other & F.col("_code").isNotNull() & F.lit(forest.complemented)
        test = F.when(kind == "numeric", F.concat("_attr", F.when(below, " < ").otherwise(" >= "), F.col("_split").cast("string"), F.lit(" -> ")))
        test = test.when((kind == "categorical") & (~other | known), F.concat("_attr", F.lit(" = "), "_word", F.lit(" -> "))).otherwise("")
        moved = met.select(
            *kept, F.when(kind == "numeric", F.col("_child") + F.when(below, 0).otherwise(1)).when(kind == "categorical", F.col("_to")).otherwise(F.col("_at")).alias("_at"),
            F.when(~other | known | kind.isNull(), F.concat("_path", test)).alias("_path"),
            F.when((kind == "leaf") | known, F.col("_answer")).alias("_label"),
            (F.col("_depth") + F.when(kind.isin("numeric", "categorical"), 1).otherwise(0)).alias("_depth"),
            F.coalesce((kind != "leaf") & ~other, F.lit(True)).alias("_open"))
        written = materialize(moved, "routed")
        done = written.where(~F.col("_open")).select(*ids, "tree", F.col("_label").alias("label"), F.col("_depth").alias("depth"), F.col("_path").alias("path"))
        out = done if out is None else out.union(done)
        here = written.where("_open")
    if forest.last:
        done = walked(here, *forest.last, forest.numeric, forest.categorical, ids, forest.complemented)
        out = done if out is None else out.union(done)
    return out
