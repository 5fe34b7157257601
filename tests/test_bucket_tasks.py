"""Buckets worked on where they lie give the rows of the way by tables."""

import numpy as np
import pytest

from counterpoise.operators import bucket_tasks, smote


def _table(spark, n=400, repeats=False, missing=False):
    rng = np.random.default_rng(71)
    rows = [(f"é{i}" if i % 7 == 0 else f"r{i}", "pos" if i % 4 == 0 else ("neg" if i % 5 else "mid"), float(rng.integers(0, 60)), float(rng.normal()), "abc"[i % 3], "uvw"[int(rng.integers(0, 3))]) for i in range(n)]
    if missing:
        rows = [(a, b, None if i % 11 == 0 else c, d, None if i % 13 == 0 else e, f) for i, (a, b, c, d, e, f) in enumerate(rows)]
    rows += rows[:9] if repeats else []
    return spark.createDataFrame(rows, "id string, cls string, x double, y double, g string, h string").repartition(3)


def _rows(df):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect())


def _by_tables(monkeypatch):
    monkeypatch.setattr(smote, "_bounded", lambda *a, **k: None)


ARGS = ("cls", "id", ["x", "y"], ["g", "h"])


@pytest.mark.parametrize("options", [{}, {"metric": "standard", "compat": True}, {"metric": "euclidean", "neighbors": "minority", "seed": "s", "k": 3}])
def test_balanced_rows(spark, monkeypatch, options):
    df = _table(spark)
    made = smote.smote(df, *ARGS, minority_rows=15, **options)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]
    got = _rows(made)
    _by_tables(monkeypatch)
    want = smote.smote(df, *ARGS, minority_rows=15, **options)
    assert made.dtypes == want.dtypes and got == _rows(want) and sum(r[-1] for r in got) > 100


@pytest.mark.parametrize("metric", ["product", "standard", "euclidean"])
@pytest.mark.parametrize("missing", [False, True])
def test_votes(spark, monkeypatch, metric, missing):
    def run():
        return smote.hvdm_classify(smote.deal_buckets(_table(spark, missing=missing), "cls", "id", 15), *ARGS, 4, metric)

    made = run()
    assert "grp" in str(made._jdf.queryExecution().optimizedPlan()) and made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    got = _rows(made)
    _by_tables(monkeypatch)
    want = run()
    assert made.dtypes == want.dtypes and got == _rows(want) and len(got) > 350


def test_repeated_ids_and_large_buckets_take_the_tables(spark):
    df = _table(spark, repeats=True)
    assert smote._bounded(smote.deal_buckets(df, "cls", "id", 15), *ARGS) is None
    once = smote.deal_buckets(_table(spark), "cls", "id", 15)
    assert smote._bounded(once, *ARGS)["buckets"] == 4 and smote._bounded(once, *ARGS, 50) is None
    assert smote._bounded(_table(spark).selectExpr("*", "0 as grp"), *ARGS) is None
    assert not bucket_tasks.ids_come_once(spark.createDataFrame([("a",), (None,)], "id string"), "id")


def test_rows_are_shuffled_for_their_rank_and_to_their_bucket_only(spark):
    made = smote.smote(_table(spark), *ARGS, minority_rows=15)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    # the third one counts classes
    assert plan.count("Exchange hashpartitioning(") == 3
