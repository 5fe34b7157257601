"""Top-k row similarity by blocks of pieces: nothing is shuffled for the search, every list is whole."""

import numpy as np
import pytest

from counterpoise.operators import row_pieces, similarity


def _cells(spark, odd=True):
    rng = np.random.default_rng(51)
    cells = {(int(r), int(c)): float(v) for r, c, v in zip(rng.integers(0, 90, 900), rng.integers(-3, 60, 900), rng.integers(-4, 9, 900))}
    rows = [(r, c, v) for (r, c), v in cells.items()]
    rows += [(200, c, 1.0 + c % 3) for c in range(60)]  # a row longer than a piece
    if odd:
        rows += [(None, 3, 1.0), (7, None, 2.0), (8, 5, None), (9, 10**12, 3.0), (10, 10**12, 4.0), (11, 99, 0.0), (12, None, 1.0), (201, None, 4.0), (13, 7, 2.0), (13, 7, 5.0)]
    return spark.createDataFrame(rows, "row long, col long, val double").repartition(3)


def _lists(rows):
    return sorted((r["row"], r["rank"], r["other"], round(r["similarity"], 8)) for r in rows.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(row_pieces, "PIECE_ENTRIES", 20)
    monkeypatch.setattr(row_pieces, "STREAM_ENTRIES", 50)
    monkeypatch.setattr(row_pieces, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(row_pieces, "HELD", 40)


@pytest.mark.parametrize("measure", list(similarity.SIMILARITIES))
@pytest.mark.parametrize("exclude,threshold", [(False, similarity.SMALLEST), (True, 0.15)])
def test_many_blocks_and_long_rows_give_the_lists_of_the_pair_table(spark, monkeypatch, small, measure, exclude, threshold):
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 60)
    df = _cells(spark)
    want = similarity.top_pairs(similarity.row_pairs(df, measure, threshold), 4, exclude)
    assert _lists(similarity.row_similarity(df, measure, 4, exclude, threshold)) == _lists(want)


def test_search_shuffles_nothing(spark):
    found = similarity.row_similarity(_cells(spark), "cosine", 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() > 1  # the blocks are tasks of their own


def test_columns_of_zeros_count_for_the_likelihood(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 2, 1.0), (3, 40, 0.0)], "row int, col int, val double")
    got = _lists(similarity.row_similarity(df, "loglikelihood", 5))
    assert got == _lists(similarity.top_pairs(similarity.row_pairs(df, "loglikelihood"), 5))
    assert got == _lists(similarity.row_similarity(df, "loglikelihood", 5, n_cols=41))
    assert similarity.row_similarity(df, "loglikelihood", 5).dtypes[:2] == [("row", "int"), ("other", "int")]


def test_names_that_are_no_numbers_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 2.0)], "row string, col string, val double")
    assert [r["other"] for r in similarity.row_similarity(df, "cosine", 5, True).orderBy("row").collect()] == ["b", "a"]
    assert similarity.row_similarity(df.where("val > 9").selectExpr("1L as row", "2L as col", "val"), "cosine").collect() == []


def test_pieces_hold_whole_rows(spark, small):
    rows = similarity._prepared(_cells(spark, odd=False), "raw")
    got = {}
    for p in row_pieces.pack(rows, False).collect():
        ids, lengths = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["lengths"], np.int64)
        assert p["entries"] == lengths.sum() and p["members"] == len(ids)
        for i, n in zip(ids.tolist(), lengths.tolist()):
            assert i not in got
            got[i] = n
    assert got == {r["row"]: r["count"] for r in rows.groupBy("row").count().collect()}
