"""Neighbours under the mixed distance in the whole table: no bucket hides a partner."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import knn, ordered_knn, smote


def _table(spark, n=500, odd=True):
    rng = np.random.default_rng(61)
    rows = [(f"r{i}", "pos" if i % 3 == 0 else "neg", float(rng.normal() * 30), float(rng.integers(0, 4)), "abc"[int(rng.integers(0, 3))]) for i in range(n)]
    if odd:
        rows += [(f"t{i}", "pos" if i % 4 == 0 else "neg", 7.0, float(i % 5), "ab"[i % 2]) for i in range(150)]  # one value fills ranges
        rows += [(f"m{i}", "pos", None if i % 2 else 3.0, None if i % 3 else 1.0, None if i % 5 == 0 else "a") for i in range(20)]
        rows += [(f"f{i}", "neg", 5e4 * (i + 1), 1.0, "c") for i in range(3)] + rows[:6] + [("r1", "pos", 9.0, 2.0, "b")]
    return spark.createDataFrame(rows, "id string, cls string, x double, y double, g string").repartition(3)


def _lists(found):
    return sorted((r["grp"], r["qid"], r["rank"], r["nid"], round(r["dist"], 6)) for r in found.collect())


@pytest.mark.parametrize("metric", ["product", "standard", "euclidean"])
@pytest.mark.parametrize("size", [40, 10**6])
def test_ranges_give_the_lists_of_all_pairs(spark, monkeypatch, metric, size):
    monkeypatch.setattr(ordered_knn, "RANGE_ROWS", size)
    df = _table(spark)
    asked = F.col("cls") == "pos"
    got = smote.hvdm_neighbors(df, "cls", "id", ["x", "y"], ["g"], 4, metric, queries=asked)
    one = smote.features(df.withColumn("grp", F.lit(0)), "cls", "id", ["x", "y"], ["g"], metric)
    want = knn.knn_within(one, asked, 4, metric, 0 if metric == "euclidean" else 1, block_rows=10**6)
    assert _lists(got) == _lists(want)


def test_copies_of_a_row_leave_the_search_whole(spark, monkeypatch):
    monkeypatch.setattr(ordered_knn, "RANGE_ROWS", 30)
    rows = [(f"c{i}", "pos", 1.0, "a") for i in range(100)] + [(f"d{i}", "neg", 2.0 + i, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, cls string, x double, g string")
    found = smote.hvdm_neighbors(df, "cls", "id", ["x"], ["g"], 3, queries=F.col("cls") == "pos").collect()
    assert len(found) == 300 and {(r["rank"], r["nid"]) for r in found} == {(1, "d0"), (2, "d1"), (3, "d2")}


def test_query_finds_the_nearest_of_the_table_not_of_a_bucket(spark, tmp_path):
    from counterpoise.plans import catalog

    rng = np.random.default_rng(62)
    rows = [(i, i, 1, 1 + i % 7, float(rng.integers(1, 50)), float(rng.integers(1000, 90000)), 0.01 * (i % 9), "R" if i % 3 == 0 else "N", "O") for i in range(1800)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["smote_neighbors"](spark, str(tmp_path)).where("rank = 1").collect()
    ids = [f"{r[0]}-{r[3]}-{r[1]}-{r[2]}" for r in rows]
    q, p, d = (np.array([r[j] for r in rows]) for j in (4, 5, 6))
    line, pos = np.array([r[3] for r in rows]), np.array([r[7] == "R" for r in rows])
    share = {v: pos[line == v].mean() for v in range(1, 8)}
    shares = np.array([share[v] for v in line])
    assert len(found) == pos.sum()
    for r in found[::20]:
        i = ids.index(r["qid"])
        far = sum(np.abs(x - x[i]) * x.std() / 4 for x in (q, p, d)) + np.sqrt(2) * np.abs(shares - shares[i])
        far[i] = np.inf
        assert r["dist"] == pytest.approx(np.sqrt(far.min()), abs=1e-3)
