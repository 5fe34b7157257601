"""Top-k row similarity when a column holds a third of the entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import similarity


@pytest.mark.parametrize("measure,exclude", [("cosine", True), ("cosine", False), ("pearson", True)])
def test_hot_columns_keep_every_list(spark, measure, exclude):
    rng = np.random.default_rng(21)
    cells = []
    for i in range(400):
        cells.append((i, 0, float(rng.choice([0.1, 0.2, 5.0], p=[0.6, 0.3, 0.1]) * rng.choice([1, 1, -1]))))
        if i % 7:
            cells += [(i, int(c), float(rng.normal() + 1)) for c in rng.choice(np.arange(1, 120), 3, replace=False)]
    cells += [(400, 0, 2.0), (401, 5, 1.0)]
    df = spark.createDataFrame(cells, "row long, col long, val double").repartition(4)
    want = {(r["row"], r["rank"]): (r["other"], round(r["similarity"], 7)) for r in similarity.row_similarity(df, measure, 6, exclude, limit=10**6).collect()}
    got = {(r["row"], r["rank"]): (r["other"], round(r["similarity"], 7)) for r in similarity.row_similarity(df, measure, 6, exclude, limit=50).collect()}
    assert got == want


def test_hot_column_meets_fewer_pairs_than_its_square(spark):
    rng = np.random.default_rng(22)
    cells = []
    for i in range(1200):
        cells.append((i, 0, 8.0 if i % 40 == 0 else 0.3))
        cells += [(i, 1 + (i // 6) * 3 + j, float(rng.uniform(1, 2))) for j in range(2)]
    df = spark.createDataFrame(cells, "row long, col long, val double")
    carried = similarity.prepare_rows(df, "unit")
    hot = similarity._hot_columns(carried, 100)
    assert [r["col"] for r in hot.collect()] == [0]
    cold = carried.join(hot, "col", "left_anti")
    first = similarity._dots(cold, None, 100).select("a", "b", F.col("n").alias("similarity")).where("a <> b")
    asking, met = similarity._asks(carried, hot, first, 3)
    one = asking.select("col", F.explode(F.sequence(F.lit(0), F.col("_reach"))).alias("_level"))
    visited = one.join(met, ["col", "_level"]).count()
    assert visited < 0.2 * 1200 * 1200
