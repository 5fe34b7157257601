"""Rules that hold whatever the size of a table: balance, sizes of vectors, labels, draws."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from counterpoise.functions import distance, draw
from counterpoise.operators import balance, encode, smote, text


def classes(df, label="label"):
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


@pytest.mark.parametrize("pos,neg", [(6, 6000), (49, 51), (2040, 1960), (300, 9000)])
def test_smote_evens_the_table(spark, pos, neg):
    df = spark.range(pos + neg).select(
        "id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") * 7 % 31).cast("double").alias("y"),
        (F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") < pos, "pos").otherwise("neg").alias("label"),
    )
    out = smote.smote(df, "label", "id", ["x", "y"], ["g"], minority_rows=50).cache()
    assert classes(out) == {"pos": max(pos, neg), "neg": max(pos, neg)}
    rare = "pos" if pos < neg else "neg"
    assert classes(out.where("synthetic = 1")) == {rare: abs(pos - neg)}


def test_share_keys_keep_names_apart(spark):
    rows = [(i, "b=c" if i % 2 else "z", "c" if i % 3 else "y", float(i), "pos" if i % 5 == 0 else "neg") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a string, `a=b` string, x double, label string")
    shares = smote._bucket_statistics(df.withColumn("grp", F.lit(0)), "label", ["x"], ["a"]).first()["_shares"]
    assert len(shares) == 2
    assert smote._share_key is not None
    keys = df.select(smote._share_key(F.lit("a"), F.lit("b=c")).alias("k1"), smote._share_key(F.lit("a=b"), F.lit("c")).alias("k2")).first()
    assert keys["k1"] != keys["k2"]


@pytest.mark.parametrize("name", sorted(distance.MEASURES))
def test_measures_refuse_unequal_sizes(spark, name):
    extra = {"weights": F.array(F.lit(1.0), F.lit(1.0))} if name.startswith("weighted") else {}
    if name == "mahalanobis":
        extra = {"inverse": F.array(F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(0.5), F.lit(1.0)))}
    measure = distance.MEASURES[name]

    def value(a, b):
        row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        return row.select(measure(F.col("a"), F.col("b"), **extra)).first()[0]

    assert value([1.0, 2.0], [2.0, 1.0]) is not None
    assert value(None, [2.0, 1.0]) is None
    with pytest.raises(PySparkException, match="vector sizes differ"):
        value([1.0, 2.0], [1.0, 2.0, 3.0])
    if extra:
        with pytest.raises(PySparkException, match="vector sizes differ"):
            value([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])


def test_weight_gets_the_number_of_features(spark):
    vectors = spark.createDataFrame([(1, 0, 2), (1, 4, 1), (2, 0, 1)], "doc long, term_id long, tf long")
    got = text.weigh(vectors, "doc", lambda tf, df, length, n: tf * length + n, max_df_pct=100.0).collect()
    assert {(r["doc"], r["term_id"]): r["val"] for r in got} == {(1, 0): 12, (1, 4): 7, (2, 0): 7}


def test_interaction_weights_multiply(spark):
    df = spark.createDataFrame([(1, "u", "v"), (2, "u", "w")], "row long, a string, b string")
    a = spark.createDataFrame([("u", 2.0)], "word string, weight double")
    b = spark.createDataFrame([("v", 5.0)], "word string, weight double")
    coded = encode.encode_interaction(df, "row", "a", "b", weight=3.0, probes=1, a_weights=a, b_weights=b)
    assert {r["row"]: r["val"] for r in coded.collect()} == {1: 30.0, 2: 15.0}


def test_rows_without_label_are_dropped(spark):
    df = spark.createDataFrame([(i, None if i < 5 else "p" if i < 7 else "n") for i in range(17)], "id long, label string")
    assert classes(balance.random_oversample(df, "label", ["id"])) == {"p": 10, "n": 10}
    assert None not in classes(balance.random_undersample(df, "label", ["id"]))


def test_draws_have_52_bits(spark):
    got = spark.range(200).select(draw.u("s", "id").alias("u"), draw.u_open("s", "id").alias("o"), draw.u_closed("s", "id").alias("c")).collect()
    assert all(0 <= r["u"] < 1 and 0 < r["o"] < 1 and 0 <= r["c"] <= 1 for r in got)
    assert all((r["u"] * 2**52).is_integer() for r in got) and not all((r["u"] * 2**32).is_integer() for r in got)
