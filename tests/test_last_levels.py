"""Levels grown as arrays in one task against levels grown as jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators.forest import nodes, split, train

SCHEMA = "id long, x double, z double, g string, h string, y string"


def rows_of(spark, n, seed, labels=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = [
        (i, float(rng.integers(0, 40)) * 1e6, float(rng.integers(-3, 4)), f"g{rng.integers(0, 5)}", f"h{rng.integers(0, 3)}", str(rng.choice(labels)))
        for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted(map(str, df.collect()))


CASES = {
    "simple": lambda df, **o: train.grow_simple_tree(df, "y", ["id"], ["x", "z"], ["g", "h"], **o),
    "whole": lambda df, **o: train.grow_tree(df, "y", ["id"], ["x", "z"], ["g", "h"], m=3, max_depth=3, **o),
    "gini": lambda df, **o: train.grow_tree(df, "y", ["id"], ["x"], ["g"], m=2, max_depth=2, criterion=split.GiniTarget, **o),
    "bags": lambda df, **o: train.train_forest(df, "y", ["id"], ["x", "z"], ["g", "h"], n_trees=3, max_depth=3, min_split=3, **o),
    "parts": lambda df, **o: train.train_forest(df.limit(2), "y", ["id"], ["x"], ["g"], n_trees=6, mode="partitioned", partitions=6, **o),
}


@pytest.mark.parametrize("case", CASES)
def test_blocks_grow_and_walk_as_levels_do(spark, monkeypatch, case):
    df = rows_of(spark, 24 if case == "simple" else 60, 4, ("a", "b", "c") if case == "gini" else ("a", "b")).localCheckpoint()
    strange = spark.createDataFrame([
        (900, float("nan"), 0.0, "g1", "h0", "a"), (901, None, -0.0, None, "h1", "a"), (902, 2e6, 9.0, "unseen", "h2", "b"), (903, 1.0, None, "g2", None, "b")], SCHEMA)
    asked, found = df.union(strange).localCheckpoint(), []
    for cells in (0, 60, 1 << 18) if case == "simple" else (0, 1 << 18):
        monkeypatch.setattr(train, "LAST_CELLS", cells)
        forest = CASES[case](df)
        found.append((shown(forest.table(spark)), shown(nodes.leaves(asked, forest, ["id"]))))
    assert all(f == found[0] for f in found)


def test_equal_values_and_nan_in_training(spark, monkeypatch):
    rows = [(i, v, 1.0, "g", "h", y) for i, (v, y) in enumerate([(float("nan"), "a"), (-0.0, "b"), (0.0, "a"), (1.0, "b"), (float("nan"), "b"), (2.0, "a"), (1.0, "b")])]
    df, found = spark.createDataFrame(rows, SCHEMA).localCheckpoint(), []
    for cells in (0, 1 << 18):
        monkeypatch.setattr(train, "LAST_CELLS", cells)
        forest = train.grow_simple_tree(df, "y", ["id"], ["x", "z"], ["g", "h"])
        found.append((shown(forest.table(spark)), shown(nodes.leaves(df, forest, ["id"]))))
    assert found[0] == found[1]


def test_own_criterion_without_arrays_is_grown_in_levels(spark):
    class Halved(split.Target):
        def impurity(self, stats):
            return super().impurity(stats) / 2

    df = rows_of(spark, 40, 2)
    assert not Halved("y", ("a", "b")).in_arrays and split.GiniTarget("y", ("a", "b")).in_arrays and not split.Target("y").in_arrays
    assert train.grow_tree(df, "y", ["id"], ["x"], [], m=1, max_depth=2, criterion=Halved).last is None


def test_deep_tree_costs_few_jobs(spark):
    """A tree of some 200 levels, each a cut at its edge."""
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = nodes.leaves(df, train.grow_tree(df, "y", ["id"], ["x"], [], m=1, min_split=1), ["id"]).join(df, "id").collect()
    assert len(found) == 400 and all(r["label"] == r["y"] for r in found) and max(r["depth"] for r in found) > 20
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 100
