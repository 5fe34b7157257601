"""Samples of any size, and weights far below the resolution of a double sum."""

import decimal
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from counterpoise.functions.draw import u
from counterpoise.operators import sample


@pytest.mark.parametrize("k", [0, 3, 10, 700, 1499, 1500, 4000])
def test_fixed_size_sample_takes_least_draws(spark, monkeypatch, k):
    monkeypatch.setattr(sample, "MERGED_ROWS", 10)
    monkeypatch.setattr(sample, "BINS", 16)
    df = spark.range(1500).repartition(4)
    want = {r["id"] for r in df.orderBy(u("reservoir", "id"), "id").limit(k).collect()}
    assert {r["id"] for r in sample.fixed_size_sample(df, ["id"], k).collect()} == want
    ordered = [r["id"] for r in sample.fixed_size_sample(df, ["id"], k, stable=True).collect()]
    assert ordered == sorted(want)


def test_half_of_a_table_meets_in_no_single_task(spark):
    df = spark.range(60_000).repartition(6)
    picked = sample.fixed_size_sample(df, ["id"], 30_000)
    sizes = picked.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 30_000 and max(r["count"] for r in sizes) <= sample.MERGED_ROWS


def test_tiny_weights_are_drawn(spark):
    decimal.getcontext().prec = 60
    weights = spark.createDataFrame([("a", 1.0), ("b", 1e-18), ("c", 2.0), ("d", 3e-25), ("e", 0.0), ("f", 1e-18)], "k string, w double")
    third = Decimal(1) / 3
    places = {
        "a": [Decimal(0), third - Decimal("1e-17")], "b": [third + Decimal("1e-19")], "c": [third + Decimal("1e-17"), Decimal("0.9999")],
        "d": [Decimal(1) - Decimal("3.333e-19") - Decimal("5e-26")], "f": [Decimal(1) - Decimal("1e-19"), Decimal(1) - Decimal("1e-29")],
    }
    rows = [(k, round(x, 30)) for k, xs in places.items() for x in xs]
    draws = spark.createDataFrame(rows, "want string, d decimal(31,30)")
    got = sample.multinomial_sample(draws, "d", weights, "k", "w").collect()
    assert len(got) == len(rows)
    assert {(r["want"], r["k"]) for r in got if r["want"] != "d"} == {(k, k) for k in "abcf"}
    found = {r["k"]: (r["_lo"], r["_hi"]) for r in sample._intervals(weights, "k", "w").collect()}
    assert found["d"][1] - found["d"][0] == pytest.approx(1e5, rel=1e-3) and found["b"][1] - found["b"][0] == pytest.approx(Decimal(10**12) / 3, rel=1e-3)
    edges = sorted(found.values())
    assert edges[0][0] == 0 and edges[-1][1] == 10**30 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
