"""AUC of groups cut into parts: any cut gives the serial result, in a batch and over micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import auc
from counterpoise.streaming import auc as stream


def serial(rows, policy, window, key="", history=10):
    slots, means, counts = [{}, {}], [0.5, 0.5], [0, 0]
    for c, s in rows:
        place = auc.slot(policy, counts[c], history, key, c)
        if place >= 0:
            slots[c][place] = s
        counts[c] += 1
        other = slots[1 - c].values()
        if other:
            x = sum(1.0 if s > v else 0.5 if s == v else 0 for v in other) / len(other)
            means[c] += (x - means[c]) / (counts[c] if window is None else min(window, counts[c]))
    return means


@pytest.mark.parametrize("policy", ["fifo", "fair", "random"])
def test_parts_equal_serial(spark, monkeypatch, policy):
    monkeypatch.setattr(auc, "BLOCK", 13)
    rng = np.random.default_rng(7)
    rows = [(i, "ab"[int(rng.random() < 0.1)], int(rng.random() < 0.3), float(rng.integers(0, 30))) for i in range(500)]
    df = spark.createDataFrame(rows, "t long, g string, c int, s double").repartition(3)
    for window in (None, 20):
        for r in auc.group_auc(df, ["t"], "c", "s", ["g"], window_size=window, policy=policy).collect():
            assert [r["a0"], r["a1"]] == pytest.approx(serial([x[2:] for x in rows if x[1] == r["g"]], policy, window, r["g"]))


def test_one_rare_row_among_many(spark, monkeypatch):
    monkeypatch.setattr(auc, "BLOCK", 4096)
    rng = np.random.default_rng(8)
    rows = [(i, int(i == 777), float(rng.integers(0, 99))) for i in range(100_001)]
    df = spark.createDataFrame(rows, "t long, c int, s double").repartition(4)
    r = auc.online_auc(df, ["t"], "c", "s").first()
    assert (r["n0"], r["n1"]) == (100_000, 1)
    assert [r["a0"], r["a1"]] == pytest.approx(serial([x[1:] for x in rows], "fifo", None))


@pytest.mark.parametrize("policy,window", [("fifo", None), ("fair", 15)])
def test_split_stream_equals_serial_stream(spark, monkeypatch, tmp_path, policy, window):
    monkeypatch.setattr(auc, "BLOCK", 11)
    rng = np.random.default_rng(9)
    rows = [(i, ["a", "b", None][int(rng.integers(3)) if i < 100 else 0], int(rng.integers(2)), float(rng.integers(0, 9))) for i in range(300)]
    schema = "ord1 long, grp string, cls int, score double"
    for b in range(3):
        spark.createDataFrame(rows[b * 100 : b * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def source():
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return read.withColumn("ord2", F.col("ord1"))

    found = {r["grp"]: r for r in stream.advance_stream(source(), "split", policy, window_size=window).collect()}
    assert set(found) == {"a", "b", None}
    for g in ("a", "b"):
        mine = [r[2:] for r in rows if r[1] == g]
        assert found[g]["n0"] + found[g]["n1"] == len(mine)
        assert [found[g]["a0"], found[g]["a1"]] == pytest.approx(serial(mine, policy, window, g))


def test_empty_table(spark):
    df = spark.createDataFrame([], "t long, g string, c int, s double")
    assert auc.group_auc(df, ["t"], "c", "s", ["g"]).count() == 0
