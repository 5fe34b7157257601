"""Neighbours of rows that no bound keeps apart: queries travel to shards, copies do not hide neighbours."""

import numpy as np
from pyspark.sql import functions as F

from counterpoise.operators import knn


def _points():
    rng = np.random.default_rng(41)
    points = rng.normal(size=(900, 24))
    points[200:320] = points[200]  # more copies than the first cells of a query are asked for
    points[400:440] = np.round(points[400:440])
    points[440:480] = -points[400:440]
    return points


def _table(spark):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(_points())], "id long, vec array<double>").repartition(5)


def test_neighbours_are_exact_where_no_cell_is_ruled_out(spark):
    points, got = _points(), {}
    for r in knn.knn(_table(spark), "id", "vec", 5, 20).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["dist"]))
    for i, p in enumerate(points):
        dist = np.round(np.sqrt(((points - p) ** 2).sum(axis=1)), 9)
        want = sorted((d, j) for j, d in enumerate(dist) if d > 0)[:5]
        assert [n for _, n, _ in sorted(got[i])] == [j for _, j in want]
        assert np.allclose([d for _, _, d in sorted(got[i])], [d for d, _ in want], atol=2e-9)


def test_queries_travel_to_shards_not_to_cells(spark):
    side = _table(spark).select("id", F.col("vec").alias("num"))
    cells, placed = knn.make_cells(side, 900, 20)
    size = knn.shard_size(900, 24, 20)
    limited = side.withColumn("limit", F.lit(9.0))
    to_shards = knn.shard_routes(limited, cells, size)
    assert len(cells.rows) == 90 and knn.routes(limited, cells, 5, True).count() > 20 * 900
    assert to_shards.count() == to_shards.distinct().count() <= knn.SHARDS * 900


def test_large_tables_are_cut_into_bounded_shards():
    assert knn.shard_size(10_000_000, 64, 4096) == 62_500
    assert knn.shard_size(10_000_000, 8, 4096) == knn.SHARD_ROWS
    assert knn.shard_size(1000, 4, 4096) == 4096
