"""N-grams are made inside the row of their text."""

from counterpoise.operators import text


def test_no_row_of_a_token_carries_the_text(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"]), (3, []), (4, None)], "doc long, tokens array<string>")
    grams = text.sliding_ngrams(df, "doc", 3)
    assert [(r["doc"], r["gram"]) for r in grams.orderBy("doc").collect()] == [
        (1, "a"), (1, "a"), (1, "a b"), (1, "a"), (1, "a b"), (1, "a b c"), (2, "d")]
    assert grams._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    labelled = text.labelled_ngrams(df, "doc", 2)
    assert sorted(tuple(r) for r in labelled.collect()) == [(1, "a", "b"), (1, "a", "b"), (1, "a", "b c")]
    assert labelled._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
