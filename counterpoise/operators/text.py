"""Documents to weighted term vectors in long form (doc, term_id, val)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from ..sources.io import gather
from . import colloc
from .prefix import shuffled_rank

# The 33 English stop words of the standard analyzer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()

TOKEN = r"([\p{L}\p{N}]+)"


def standard_analyzer(text: Column) -> Column:
    """Lower-cased words of letters and digits without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def tokenize(
    docs: DataFrame, doc: str, text: str, analyzer: Callable[[Column], Column] = standard_analyzer
) -> DataFrame:
    """(doc, tokens); empty tokens are dropped.  No shuffle."""
    tokens = analyzer(F.col(text))
    if analyzer is not standard_analyzer:  # whose tokens are never empty
        tokens = F.filter(tokens, lambda w: w != "")
    return docs.select(doc, tokens.alias("tokens"))


def token_rows(tokens: DataFrame, doc: str) -> DataFrame:
    """(doc, pos, term)."""
    return tokens.select(doc, F.posexplode("tokens").alias("pos", "term"))


def term_counts(tokens: DataFrame, min_support: int = 2) -> DataFrame:
    """Total occurrences of each term, at least ``min_support``; counted per task before the shuffle."""
    words = tokens.select(F.explode("tokens").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)


def dictionary(terms: DataFrame, seed="dictionary") -> DataFrame:
    """(term, term_id): dense ids from 0 in hash order of the term, so no task ranks all terms.

    Terms and the finished dictionary are written: each is read several times.
    """
    ranked = shuffled_rank(materialize(terms.select("term"), "terms"), ["term"], seed=seed, out="term_id")
    return materialize(ranked, "dictionary")


def document_terms(tokens: DataFrame, doc: str, ngram: int = 1) -> DataFrame:
    """(doc, term, tf) of words, or of words and shingles up to ``ngram``."""
    words = F.col("tokens")
    if ngram > 1:
        words = F.concat(words, F.transform(colloc.shingle_array(F.col("tokens"), ngram), colloc.gram_text))
    rows = tokens.select(doc, F.explode(words).alias("term"))
    return rows.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_vectors(doc_terms: DataFrame, doc: str, terms: DataFrame) -> DataFrame:
    """(doc, term_id, tf) over the dictionary; documents without known terms have no rows.

    The dictionary side is joined without a hint: it is broadcast when its measured size
    allows, otherwise both sides are sorted and hot terms are split at run time.
    """
    return doc_terms.join(terms, "term").select(doc, "term_id", "tf")


def frequency_vectors(
    tokens: DataFrame, doc: str, min_support: int = 2, ngram: int = 1, min_llr: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(term-frequency vectors, dictionary).

    The text is cut into tokens once: counts per document and term are written, and term
    totals, dictionary and vectors are made of that table.
    """
    doc_terms = materialize(document_terms(tokens, doc, ngram), "document-terms")
    if ngram > 1:
        found = colloc.collocations(tokens, doc, ngram, min_support, min_llr, unigrams=True)
        terms = found.select(F.col("gram").alias("term"))
    else:
        terms = doc_terms.groupBy("term").agg(F.sum("tf").alias("n")).where(F.col("n") >= min_support)
    ids = dictionary(terms)
    return term_vectors(doc_terms, doc, ids), ids


def empty_documents(docs: DataFrame, vectors: DataFrame, doc: str) -> DataFrame:
    """Documents without a vector."""
    return docs.select(doc).join(vectors.select(doc), doc, "left_anti")


def document_frequency(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))


def vector_count(vectors: DataFrame, doc: str) -> Column:
    """Number of documents with a vector, as a scalar."""
    return vectors.select(doc).distinct().agg(F.count(F.lit(1))).scalar()


def feature_counts(vectors: DataFrame, doc: str) -> DataFrame:
    """One row: features and documents."""
    features = vectors.agg((F.max("term_id") + 1)).scalar()
    docs = vectors.select(doc).distinct()
    return docs.agg(F.count(F.lit(1)).alias("documents")).withColumn("features", features)


def weight_tf(tf: Column, df: Column, length: Column, n_docs: Column) -> Column:
    return tf.cast("double")


def weight_tfidf(tf: Column, df: Column, length: Column, n_docs: Column) -> Column:
    """sqrt(tf) * (ln(N / (df + 1)) + 1)."""
    return F.sqrt(tf) * (F.ln(n_docs / (df + 1)) + 1)


WEIGHTS: dict[str, Callable[..., Column]] = {"tf": weight_tf, "tfidf": weight_tfidf}


def weigh(
    vectors: DataFrame,
    doc: str,
    weight: str | Callable[..., Column] = "tfidf",
    min_df: int = 1,
    max_df_pct: float = 99.0,
) -> DataFrame:
    """Weighted vectors (doc, term_id, val).

    Terms in more than ``max_df_pct`` percent of the documents are dropped; a document
    frequency below ``min_df`` is raised to it, the term stays.  A formula gets (tf, df,
    number of features, number of documents).
    """
    n_docs = vector_count(vectors, doc)
    frequent = document_frequency(vectors).withColumn("_n", n_docs)
    kept = frequent.where(100.0 * F.col("df") / F.col("_n") <= max_df_pct)
    formula = WEIGHTS[weight] if isinstance(weight, str) else weight
    # as wide as the dictionary; a formula that does not use it costs nothing
    length = vectors.agg(F.max("term_id") + 1).scalar()
    val = formula(F.col("tf"), F.greatest(F.col("df"), F.lit(min_df)), length, F.col("_n"))
    return vectors.join(kept, "term_id").select(doc, "term_id", val.alias("val"))


def sigma_limit(vectors: DataFrame, doc: str, sigma: float) -> Column:
    """Largest document frequency, in whole percent, by deviations about zero."""
    frequent = document_frequency(vectors)
    squares = F.sum(F.col("df").cast("double") * F.col("df"))
    spread = frequent.agg(F.sqrt(squares / (F.count(F.lit(1)) - 1))).scalar()
    return F.floor(100.0 * sigma * spread / vector_count(vectors, doc))


def prune_by_sigma(vectors: DataFrame, doc: str, sigma: float) -> DataFrame:
    """Drop the terms whose document frequency is above the sigma limit (both in percent)."""
    limit, n_docs = sigma_limit(vectors, doc, sigma), vector_count(vectors, doc)
    kept = document_frequency(vectors).where(100.0 * F.col("df") / n_docs <= limit)
    return vectors.join(kept.select("term_id"), "term_id", "left_semi")


def norm(val: Column, power: float, over=None) -> Column:
    """p-norm as an aggregate or, with ``over``, as a window column."""
    if power == 0:
        total = F.sum((val != 0).cast("double"))
    elif math.isinf(power):
        total = F.max(F.abs(val))
    else:
        total = F.sum(F.pow(F.abs(val), F.lit(float(power))))
    total = total if over is None else total.over(over)
    return total if power == 0 or math.isinf(power) else F.pow(total, F.lit(1.0 / power))


def normalize(vectors: DataFrame, doc: str, power: float = 2.0, log: bool = False) -> DataFrame:
    """Divide each vector by its p-norm; ``log`` gives ln(1 + v) / (ln p * norm), for finite p above 1.

    The window is one document, whose text already fitted in one row.
    """
    if log and not (power > 1 and math.isfinite(power)):
        raise ValueError("log normalisation needs a finite power above 1")
    length = norm(F.col("val"), power, W.partitionBy(doc))
    val = F.log1p("val") / (math.log(power) * length) if log else F.col("val") / length
    return vectors.withColumn("val", val)


def merge_partial(parts: DataFrame, doc: str) -> DataFrame:
    """Sum partial vectors of the same document."""
    return parts.groupBy(doc, "term_id").agg(F.sum("val").alias("val"))


def sparse_vectors(
    docs: DataFrame,
    doc: str,
    text: str,
    weight: str = "tfidf",
    min_support: int = 2,
    min_df: int = 1,
    max_df_pct: float = 99.0,
    sigma: float | None = None,
    ngram: int = 1,
    min_llr: float = 1.0,
    power: float | None = None,
    log: bool = False,
    analyzer: Callable[[Column], Column] = standard_analyzer,
) -> tuple[DataFrame, DataFrame]:
    """Whole pipeline: (vectors, dictionary)."""
    vectors, ids = frequency_vectors(tokenize(gather(docs, doc), doc, text, analyzer), doc, min_support, ngram, min_llr)
    vectors = materialize(vectors, "term-vectors")
    if sigma is not None:
        vectors = prune_by_sigma(vectors, doc, sigma)
    weighted = weigh(vectors, doc, weight, min_df, max_df_pct)
    if power is not None:
        weighted = normalize(weighted, doc, power, log)
    return weighted, ids


def sliding_ngrams(tokens: DataFrame, doc: str, n: int, keep: list[str] | None = None) -> DataFrame:
    """For each token every prefix of the last n tokens: (doc, *keep, gram)."""
    keep = keep or []
    size = F.size("tokens")
    grams = F.transform(
        F.sequence(F.lit(1), size),
        lambda end: F.transform(
            F.sequence(F.greatest(end - n + 1, F.lit(1)), end),
            lambda last: F.array_join(
                F.slice("tokens", F.greatest(end - n + 1, F.lit(1)), last - F.greatest(end - n + 1, F.lit(1)) + 1), " "
            ),
        ),
    )
    # made inside the row: a token is no row that carries the whole text
    return tokens.where(size > 0).select(doc, *keep, F.explode(F.flatten(grams)).alias("gram"))


def labelled_ngrams(tokens: DataFrame, doc: str, n: int) -> DataFrame:
    """The same grams over all tokens but the first, which becomes ``label``."""
    rest = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    return sliding_ngrams(tokens.select(doc, F.get("tokens", 0).alias("label"), rest.alias("tokens")), doc, n, ["label"])
