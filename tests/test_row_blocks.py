"""Row similarity without a shuffled pair table; counts by document without shuffled terms."""

import numpy as np
import pytest

from counterpoise.operators import colloc, encode, similarity, text
from counterpoise.sources.io import gather


def _cells(spark):
    rng = np.random.default_rng(41)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 60, 400), rng.integers(0, 40, 400), rng.integers(1, 9, 400))]
    return spark.createDataFrame([*{(r, c): (r, c, v) for r, c, v in cells}.values(), (None, 3, 1.0), (7, None, 2.0)], "row long, col long, val double")


@pytest.mark.parametrize("measure", list(similarity.SIMILARITIES))
@pytest.mark.parametrize("exclude,threshold", [(False, similarity.SMALLEST), (True, 0.2)])
def test_blocks_give_the_lists_of_the_pair_table(spark, monkeypatch, measure, exclude, threshold):
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 300)
    df = _cells(spark)
    key = lambda rows: sorted((r["row"], r["rank"], r["other"], round(r["similarity"], 8)) for r in rows.collect())
    found = similarity.row_similarity(df, measure, 5, exclude, threshold)
    assert key(found) == key(similarity.top_pairs(similarity.row_pairs(df, measure, threshold), 5, exclude))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "block" in plan


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_counts_by_document_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1 c1"), (2, "b1"), (1, "a1 b1"), (None, "a1 a1"), (3, None)], "doc long, text string")
    tokens = text.tokenize(gather(docs, "doc"), "doc", "text")
    plain = text.tokenize(docs, "doc", "text")
    for made in (lambda t: colloc.shingles(t, "doc", 3), lambda t: text.document_terms(t, "doc")):
        assert sorted(map(str, made(tokens).collect())) == sorted(map(str, made(plain).collect()))
        assert _exchanges(made(tokens)) == 1
    assert _exchanges(encode.encode_text(docs, "doc", "text")) == 1
