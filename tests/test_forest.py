"""Split search against brute force, growth rules and scoring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators.forest import model, split, train
from counterpoise.operators.forest.model import Forest, Node


def test_hand_computed_splits(spark):
    cat = spark.createDataFrame([("u", "A"), ("u", "A"), ("v", "A"), ("v", "B")], "g string, y string")
    assert split.categorical_gain(cat, ["g"], "y").first()["gain"] == pytest.approx(0.311278, abs=1e-6)
    num = spark.createDataFrame([(1.0, "A"), (2.0, "A"), (3.0, "B"), (4.0, "B")], "x double, y string")
    assert tuple(split.numeric_split(num, ["x"], "y").first()) == ("x", 3.0, pytest.approx(1.0))
    reg = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 5.0), (4.0, 5.0)], "x double, y double")
    assert tuple(split.regression_numeric_split(reg, ["x"], "y").first()) == ("x", 2.5, pytest.approx(16.0))
    constant = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert split.regression_numeric_split(constant, ["x"], "y").count() == 0


def entropy(labels):
    _, n = np.unique(labels, return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("chunked", [False, True])
def test_numeric_split_matches_brute_force(spark, chunked):
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, 300).astype(float), rng.integers(0, 3, 300)
    y[x > 17] = 2
    best = None
    for v in np.unique(x):
        lo, hi = y[x < v], y[x >= v]
        gain = entropy(y) - sum(len(s) / len(y) * entropy(s) for s in (lo, hi) if len(s))
        if best is None or gain > best[1] + 1e-9:
            best = (v, gain)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int").repartition(5)
    target = split.class_target(df, "y")
    hist = split.histogram(df, [], ["x"], "double", target)
    row = split.numeric_splits(hist, [], target, chunked=chunked).first()
    assert (row["split"], row["gain"]) == (best[0], pytest.approx(best[1]))


def tabular(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, z, g = float(rng.normal()), float(rng.integers(0, 5)), "abc"[int(rng.integers(3))]
        rows.append((i, x, z, g, "yes" if (x > 0.3 and g != "b") or z == 4 else "no", x * 2 + (g == "a")))
    return spark.createDataFrame(rows, "id long, x double, z double, g string, y string, t double")


def test_full_tree_fits_training_rows(spark):
    df = tabular(spark)
    tree = train.grow_tree(df, "y", ["id"], ["x", "z"], ["g"], m=3)
    wrong = model.predict(df, tree, ["id"]).where("prediction is null or prediction <> y").count()
    assert wrong == 0
    simple = train.grow_simple_tree(df, "y", ["id"], ["x", "z"], ["g"])
    assert model.predict(df, simple, ["id"]).where("prediction <> y").count() == 0


def test_categories_are_used_once_on_a_path_and_complemented(spark):
    df = tabular(spark)
    tree = train.grow_tree(df, "y", ["id"], ["x"], ["g", "z"], m=3).trees[0]
    domains = {"g": {"a", "b", "c"}, "z": {f"{v}.0" for v in range(5)}}

    def walk(i, used):
        n = tree[i]
        if n.kind == "categorical":
            assert n.attr not in used and set(n.branches) == domains[n.attr]
        for c in [*n.branches.values(), *[x for x in (n.lo, n.hi) if x is not None]]:
            walk(c, used | {n.attr} if n.kind == "categorical" else used)

    walk(0, set())


def test_min_split_and_depth(spark):
    df = tabular(spark)
    tree = train.grow_tree(df, "y", ["id"], ["x", "z"], ["g"], m=3, min_split=1000)
    assert [n.kind for n in tree.trees[0]] == ["leaf"]
    stats = model.statistics(train.grow_tree(df, "y", ["id"], ["x", "z"], ["g"], m=3, max_depth=2).table(spark)).first()
    assert stats["mean_depth"] == 2.0 and stats["trees"] == 1


def test_regression_tree(spark):
    df = tabular(spark)
    tree = train.grow_tree(df, "t", ["id"], ["x"], ["g"], m=2, regression=True)
    scored = model.predict(df, tree, ["id"])
    error = scored.agg(F.sqrt(F.avg((F.col("t") - F.col("prediction")) ** 2))).first()[0]
    assert error < 0.1 * df.agg(F.stddev("t")).first()[0]


def test_bags_are_draws_with_replacement_per_partition(spark):
    df = tabular(spark)
    bags = train.bag_rows(df, ["id"], 7, 3)
    sizes = {r["grp"]: r["n"] for r in train.partition_class_counts(df.withColumn("one", F.lit("1")), "one", ["id"], 3, "bag").collect()}
    drawn = bags.select("grp", F.explode("bag").alias("tree")).groupBy("grp", "tree").count().collect()
    assert len(drawn) == 7 and all(r["count"] == sizes[r["grp"]] for r in drawn)
    assert sorted((r["grp"], r["tree"]) for r in drawn) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]


def test_forest_beats_chance_and_bins_agree(spark):
    df = tabular(spark, 600)
    test = tabular(spark, 300, seed=2)
    for options in ({}, {"max_bins": 32}, {"mode": "partitioned", "partitions": 2}):
        forest = train.train_forest(df, "y", ["id"], ["x", "z"], ["g"], n_trees=7, max_depth=6, **options)
        right = model.predict(test, forest, ["id"]).where("prediction = y").count()
        assert right > 250


def test_model_table_round_trip_and_unknown_category(spark):
    df = tabular(spark)
    forest = train.train_forest(df, "y", ["id"], ["x"], ["g"], n_trees=3, max_depth=3, complemented=False)
    again = Forest.from_table(forest.table(spark), ["x"], ["g"])
    a = {r["id"]: r["prediction"] for r in model.predict(df, forest, ["id"]).collect()}
    b = {r["id"]: r["prediction"] for r in model.predict(df, again, ["id"]).collect()}
    assert a == b
    tree = [Node("categorical", 0, "g", branches={"a": 1}), Node("leaf", 1, label="no")]
    only = Forest([], ["g"], [tree])
    found = {r["g"]: r["prediction"] for r in model.predict(df, only, ["id"]).collect()}
    assert found == {"a": "no", "b": None, "c": None}


def test_default_attribute_counts():
    for e in range(1, 40):
        assert split.default_attributes(e, False) == int(math.log2(e)) + 1
        assert split.default_attributes(e, True) == math.ceil(e / 3)


def test_mean_ignores_missing_trees(spark):
    one = [Node("leaf", 0, label="3.0")]
    two = [Node("categorical", 0, "g", branches={"a": 1}), Node("leaf", 1, label="5.0")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, g string")
    found = {r["id"]: r["prediction"] for r in model.predict(df, Forest([], ["g"], [one, two], True), ["id"]).collect()}
    assert found == {1: 4.0, 2: 3.0}


def test_category_of_200_000_values(spark):
    """No value goes through the driver: unseen values lead nowhere, values without a branch to the default."""
    value = F.col("id") % 200_000
    df = spark.range(400_000).select("id", F.concat(F.lit("v"), value).alias("g"), F.when(value % 3 == 0, "yes").otherwise("no").alias("y"))
    wide = train.grow_tree(df, "y", ["id"], [], ["g"], m=1)
    assert wide.branches.count() == 200_000 and not wide.fits_memory
    asked = df.union(spark.createDataFrame([(-1, "other", "yes"), (-2, None, "no")], df.schema))
    got = {(r["y"], r["prediction"]): r["n"] for r in model.predict(asked, wide, ["id"]).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("yes", "yes"): 133_334, ("no", "no"): 266_666, ("yes", None): 1, ("no", None): 1}


@pytest.mark.parametrize("complemented", [True, False])
def test_joined_scores_equal_scores_in_memory(spark, monkeypatch, complemented):
    df = tabular(spark)
    forest = train.train_forest(df, "y", ["id"], ["x", "z"], ["g"], n_trees=3, max_depth=4, complemented=complemented)
    asked = tabular(spark, 200, seed=5).union(spark.createDataFrame([(900, 0.1, 2.0, "unseen", "no", 0.0), (901, 0.1, 2.0, None, "no", 0.0)], df.schema))
    near = {r["id"]: r["votes"] for r in model.tree_votes(asked, forest, ids=["id"]).collect()}
    joined = {r["id"]: r["votes"] for r in forest.votes(asked, ["id"], "votes").collect()}
    assert near == joined


def test_nodes_are_numbered_in_chunks_alike(spark, monkeypatch):
    df = tabular(spark)
    options = dict(n_trees=2, max_depth=3)
    whole = train.train_forest(df, "y", ["id"], ["x", "z"], ["g"], **options).table(spark).collect()
    monkeypatch.setattr(train, "WINDOW_NODES", 0)
    monkeypatch.setattr(train, "NODE_CHUNK", 2)
    assert sorted(map(str, train.train_forest(df, "y", ["id"], ["x", "z"], ["g"], **options).table(spark).collect())) == sorted(map(str, whole))


def test_gini_split_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 200).astype(float), rng.integers(0, 3, 200)

    def gini(part):
        _, n = np.unique(part, return_counts=True)
        return len(part) - (n**2).sum() / len(part) if len(part) else 0.0

    gains = {v: (gini(y) - gini(y[x < v]) - gini(y[x >= v])) / len(y) for v in np.unique(x)}
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    r = split.numeric_split(df, ["x"], "y", criterion=split.GiniTarget).first()
    assert r["gain"] == pytest.approx(max(gains.values())) and gains[r["split"]] == pytest.approx(r["gain"])
