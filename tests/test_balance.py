"""Hand-computed cases and invariants of balancing and neighbour search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import balance, knn, smote
from counterpoise.operators.prefix import ordered_chunks, running_sums, shuffled_rank, sorted_rank


def labelled(spark, neg, pos):
    rows = [(i, "neg") for i in range(neg)] + [(neg + i, "pos") for i in range(pos)]
    return spark.createDataFrame(rows, "id long, label string")


def counts(df, label="label"):
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def test_class_distribution_breaks_ties_by_name(spark):
    found = {r["label"]: r for r in balance.class_distribution(labelled(spark, 3, 3), "label").collect()}
    assert (found["neg"]["is_majority"], found["neg"]["is_minority"], found["neg"]["lack"]) == (1, 1, 0)
    assert (found["pos"]["is_majority"], found["pos"]["is_minority"]) == (0, 0)


@pytest.mark.parametrize("neg,pos,expected", [(7, 2, {"neg": 7, "pos": 6}), (9, 5, {"neg": 9, "pos": 5})])
def test_oversample_factor_is_floored(spark, neg, pos, expected):
    out = balance.random_oversample(labelled(spark, neg, pos), "label", ["id"])
    assert counts(out) == expected


def test_oversample_takes_given_sizes_and_name_case(spark):
    out = balance.random_oversample(labelled(spark, 7, 2), "label", ["id"], negclass="NEG", npos=2, nneg=7)
    assert counts(out) == {"neg": 7, "pos": 6}


def test_fractional_oversample_has_floor_or_one_more(spark):
    out = balance.random_oversample(labelled(spark, 700, 200), "label", ["id"], fractional=True)
    copies = {r["count"] for r in out.where("label = 'pos'").groupBy("id").count().collect()}
    assert copies == {3, 4}


def test_undersample_keeps_positives(spark):
    out = counts(balance.random_undersample(labelled(spark, 7000, 2000), "label", ["id"]))
    assert out["pos"] == 2000 and abs(out["neg"] - 2000) < 200


def mixed(spark):
    rows = [(1, "a", 1.0, "pos"), (2, "a", 2.0, "pos"), (3, "b", 4.0, "neg"), (4, "b", 5.0, "neg"), (5, "a", 6.0, "neg")]
    return spark.createDataFrame(rows, "id long, g string, x double, label string").withColumn("grp", F.lit(0))


def test_value_difference_and_sigma(spark):
    found = smote.value_difference(mixed(spark), "label", ["g"]).where("a = 'a' and b = 'b'").first()
    assert found["distance"] == pytest.approx(0.942809, abs=1e-6)
    assert smote.numeric_sigma(mixed(spark), ["x"]).first()["sigma"] == pytest.approx(1.854724, abs=1e-6)


@pytest.mark.parametrize("metric,expected", [("product", 1.527695), ("standard", 1.025868)])
def test_mixed_distance(spark, metric, expected):
    near = smote.hvdm_neighbors(mixed(spark), "label", "id", ["x"], ["g"], k=4, metric=metric)
    assert near.where("qid = 1 and nid = 3").first()["dist"] == pytest.approx(expected, abs=1e-6)
    if metric == "product":
        assert near.where("qid = 1 and nid = 2").first()["dist"] == pytest.approx(0.680941, abs=1e-6)


def test_missing_values_count_as_one(spark):
    rows = mixed(spark).withColumn("x", F.when(F.col("id") != 2, F.col("x")))
    near = smote.hvdm_neighbors(rows, "label", "id", ["x"], ["g"], k=4)
    assert near.where("qid = 1 and nid = 2").first()["dist"] == pytest.approx(1.0)


def numbers(spark, n=400, share=4):
    rng = np.random.default_rng(3)
    rows = [
        (i, float(rng.normal()), float(rng.normal()), "xyz"[int(rng.integers(3))], "pos" if i % share == 0 else "neg")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, x double, y double, g string, label string")


def test_smote_balances_every_bucket_between_parents(spark):
    df = numbers(spark)
    split = smote.assign_buckets(df, "id", partitions=3)
    made = smote.synthesize(split, "label", "id", ["x", "y"], ["g"], per_bucket=True)
    need = split.groupBy("grp").agg((F.expr("count_if(label = 'neg') - count_if(label = 'pos')")).alias("lack"))
    have = {r["grp"]: r["count"] for r in made.groupBy("grp").count().collect()}
    assert have == {r["grp"]: r["lack"] for r in need.collect()}
    values = {r["id"]: r for r in df.collect()}
    for r in made.collect():
        a, b = values[r["parent"]], values[r["neighbor"]]
        for c in ("x", "y"):
            assert min(a[c], b[c]) - 1e-9 <= r[c] <= max(a[c], b[c]) + 1e-9
        assert r["g"] in (a["g"], b["g"])
    whole = smote.smote(df, "label", "id", ["x", "y"], ["g"], partitions=3)
    assert counts(whole)["pos"] == counts(whole)["neg"] == 300


def test_smote_tie_and_small_minority(spark):
    even = numbers(spark, 40, 2)
    assert smote.smote(even, "label", "id", ["x"], [], partitions=1).count() == 40
    lone = numbers(spark, 9, 20)  # one minority row; the minority alone has no neighbours
    made = smote.smote(lone, "label", "id", ["x", "y"], [], partitions=1, neighbors="minority")
    new = made.where("synthetic = 1").collect()
    first = lone.where("id = 0").first()
    assert len(new) == 7 and all(r["x"] == first["x"] for r in new)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_knn_matches_brute_force_for_any_block_size(spark, block_rows):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(60, 3)), 1)
    points[5] = points[4]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    found = {}
    for r in knn.knn(df, "id", "vec", 4, block_rows).collect():
        found.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    for i, p in enumerate(points):
        dist = np.round(np.sqrt(((points - p) ** 2).sum(axis=1)), 9)
        best = [j for _, j in sorted((d, j) for j, d in enumerate(dist) if d > 0)][:4]
        assert [found[i][k + 1] for k in range(4)] == best


def test_knn_classify_prefers_lowest_label_on_ties(spark):
    rows = [(0, [0.0], "z"), (1, [1.0], "b"), (2, [-1.0], "a")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    found = {r["id"]: r["predicted"] for r in knn.knn_classify(df, df, "id", "vec", "label", 2).collect()}
    assert found[0] == "a"


def test_results_do_not_depend_on_partitions(spark):
    df = numbers(spark)
    outputs = []
    for parts in (1, 7):
        made = smote.smote(df.repartition(parts), "label", "id", ["x", "y"], ["g"], minority_rows=10)
        outputs.append(sorted(tuple(r) for r in made.collect()))
    assert outputs[0] == outputs[1]


def test_running_sums_with_one_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(5)
    for frame, order, chunk in (
        (ordered_chunks(df, "id"), ["_pos"], "_chunk"), (df.withColumn("c", F.floor(F.col("id") / 17)), ["id"], "c")
    ):
        got = {r["id"]: (r["s"], r["p"]) for r in running_sums(frame, ["k"], order, {"s": F.col("v")}, chunk, {"p": "id"}).collect()}
        seen, last = {}, {}
        for i, k, v in rows:
            seen[k] = seen.get(k, 0) + v
            assert got[i] == (seen[k], last.get(k))
            last[k] = i


def test_ranks_are_dense(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for ranked in (shuffled_rank(df, ["id"], ["k"]), sorted_rank(df, ["id"], ["k"])):
        for k in range(3):
            places = sorted(r["rank"] for r in ranked.where(F.col("k") == k).collect())
            assert places == list(range(len(places)))
    ordered = [r["rank"] for r in sorted_rank(df, ["id"]).orderBy("id").collect()]
    assert ordered == list(range(100))


def test_gap_is_uniform(spark):
    from counterpoise.functions.draw import gaussian, triangular, u

    row = spark.range(20000).agg(
        F.avg(u("t", "id")).alias("m"), F.stddev(gaussian("t", "id")).alias("s"), F.avg(triangular("t", 0, 1, 4, "id")).alias("t")
    ).first()
    assert row["m"] == pytest.approx(0.5, abs=0.01) and row["s"] == pytest.approx(1, abs=0.02)
    assert row["t"] == pytest.approx(5 / 3, abs=0.03) and not math.isnan(row["s"])


def test_cells_rule_out_most_pairs_and_lose_no_neighbour(spark):
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(40, 6)) * 20
    points = centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6))
    points[100:130] = points[100]  # copies are not neighbours of each other
    points[7] = [1e6] * 6
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + [(4000, [float("nan")] * 6), (4001, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(6)
    side = df.where("id < 4000").select("id", F.col("vec").alias("num"))
    cells, placed = knn.make_cells(side, 4000, 100)
    assert len(cells.rows) == 80 and cells.rows.sum() == 4000
    first = knn.routes(side, cells, 5, False).groupBy("grp").count().collect()
    limits = knn.knn(df, "id", "vec", 5, 100).where("rank = 5").select("id", F.col("dist").alias("limit"))
    second = knn.routes(side.join(limits, "id"), cells, 5, True).groupBy("grp").count().collect()
    visited = sum(r["count"] * int(cells.rows[r["grp"]]) for r in [*first, *second])
    assert visited < 0.1 * 4000 * 4000
    got = {}
    for r in knn.knn(df, "id", "vec", 5, 100).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["dist"]))
    assert set(got) == set(range(4000))
    for i in [*range(0, 4000, 97), 7, 100, 129]:
        dist = np.round(np.sqrt(((points - points[i]) ** 2).sum(axis=1)), 9)
        want = [j for _, j in sorted((d, j) for j, d in enumerate(dist) if d > 0)[:5]]
        assert [n for _, n, _ in sorted(got[i])] == want
