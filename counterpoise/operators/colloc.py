"""Collocations: shingles, their subgram totals and log-likelihood ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.info import llr
from ..session import materialize


def shingle_array(tokens: Column, n: int) -> Column:
    """All contiguous 2..n-grams of a token array as structs (head, tail)."""
    def of_size(m: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - m + 1)
        grams = F.transform(
            starts,
            lambda i: F.struct(
                F.array_join(F.slice(tokens, i, m - 1), " ").alias("head"), F.element_at(tokens, i + (m - 1)).alias("tail")
            ),
        )
        return F.when(F.size(tokens) >= m, grams).otherwise(F.array().cast("array<struct<head:string,tail:string>>"))

    return F.flatten(F.array(*[of_size(m) for m in range(2, n + 1)]))


def gram_text(gram: Column) -> Column:
    return F.concat_ws(" ", gram["head"], gram["tail"])


def shingles(tokens: DataFrame, doc: str, n: int = 2) -> DataFrame:
    """(doc, head, tail, freq): n-grams per document, head = all but the last token."""
    rows = tokens.select(doc, F.explode(shingle_array(F.col("tokens"), n)).alias("g"))
    return rows.groupBy(doc, "g.head", "g.tail").agg(F.count(F.lit(1)).alias("freq"))


def gram_totals(tokens: DataFrame, n: int = 2) -> DataFrame:
    """(head, tail, freq) over all documents; counted per task before the shuffle."""
    rows = tokens.select(F.explode(shingle_array(F.col("tokens"), n)).alias("g"))
    return rows.groupBy("g.head", "g.tail").agg(F.count(F.lit(1)).alias("freq"))


def ngram_totals(tokens: DataFrame, n: int = 2, min_support: int = 2) -> DataFrame:
    """(gram, head, tail, freq, head_total, tail_total) of grams with ``min_support``.

    The limit applies to the gram, not to the totals.  Totals are aggregates joined back:
    a hot head is added up in every task first and never fills one window.
    """
    return _with_totals(materialize(gram_totals(tokens, n), "gram-totals"), min_support)


def _with_totals(totals: DataFrame, min_support: int) -> DataFrame:
    heads = totals.groupBy("head").agg(F.sum("freq").alias("head_total"))
    tails = totals.groupBy("tail").agg(F.sum("freq").alias("tail_total"))
    kept = totals.where(F.col("freq") >= min_support)
    return kept.join(heads, "head").join(tails, "tail").select(
        F.concat_ws(" ", "head", "tail").alias("gram"), "head", "tail", "freq", "head_total", "tail_total"
    )


def collocations(
    tokens: DataFrame,
    doc: str,
    n: int = 2,
    min_support: int = 2,
    min_llr: float = 1.0,
    unigrams: bool = False,
    score: Callable[[Column, Column, Column, Column], Column] = llr,
) -> DataFrame:
    """(gram, kind, freq, score) of n-grams with a score of at least ``min_llr``.

    ``unigrams`` adds single tokens, which keep their count as score.
    """
    # one pass over the text: a single token is a gram without a head
    grams = shingle_array(F.col("tokens"), n)
    if unigrams:
        alone = F.transform("tokens", lambda t: F.struct(F.lit(None).cast("string").alias("head"), t.alias("tail")))
        grams = F.concat(grams, alone)
    rows = tokens.select(F.explode(grams).alias("g")).groupBy("g.head", "g.tail").agg(F.count(F.lit(1)).alias("freq"))
    counted = materialize(rows, "gram-totals")
    totals = counted.where(F.col("head").isNotNull())
    pairs = _with_totals(totals, min_support)
    n_total = totals.agg(F.sum("freq")).scalar()
    f, head, tail = (F.col(c).cast("double") for c in ("freq", "head_total", "tail_total"))
    scored = pairs.withColumn("_n", n_total.cast("double")).withColumn(
        "score", score(f, head - f, tail - f, F.col("_n") - (head + tail - f))
    )
    found = scored.where(F.col("score") >= min_llr).select("gram", F.lit("ngram").alias("kind"), "freq", "score")
    if not unigrams:
        return found
    words = counted.where(F.col("head").isNull() & (F.col("freq") >= min_support))
    single = words.select(F.col("tail").alias("gram"), F.lit("unigram").alias("kind"), "freq", F.col("freq").cast("double").alias("score"))
    return found.unionByName(single)
