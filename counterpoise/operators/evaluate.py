"""Evaluation of classifiers and regressors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .prefix import ordered_chunks, running_sums

UNKNOWN = "unknown"


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per (actual, predicted); a missing prediction is 'unknown'."""
    seen = F.coalesce(F.col(predicted).cast("string"), F.lit(UNKNOWN))
    pairs = df.select(F.col(actual).cast("string").alias("actual"), seen.alias("predicted"))
    return pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Full grid of labels by labels and 'unknown', zero counts included.

    The grid is labels squared: built from the set of labels, never from pairs of rows.
    """
    counts = confusion_counts(df, actual, predicted)
    names = counts.agg(
        F.array_distinct(F.concat(F.collect_set("actual"), F.collect_set("predicted"), F.array(F.lit(UNKNOWN)))).alias("l")
    )
    grid = names.select(F.explode("l").alias("actual"), "l").select("actual", F.explode("l").alias("predicted"))
    joined = grid.join(counts, ["actual", "predicted"], "left")
    return joined.select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def merge_confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of two matrices."""
    return a.unionByName(b).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def label_accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per true label: correct, total, percent correct."""
    counts = confusion_counts(df, actual, predicted)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    total = F.sum("n")
    return counts.groupBy("actual").agg(
        right.alias("correct"), total.alias("total"), (100.0 * right / total).alias("accuracy")
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: correct and incorrect counts with percentages."""
    counts = confusion_counts(df, actual, predicted)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    total = F.sum("n")
    return counts.agg(
        right.alias("correct"), (total - right).alias("incorrect"), total.alias("total"),
        (100.0 * right / total).alias("pct_correct"), (100.0 * (total - right) / total).alias("pct_incorrect"),
    )


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of interpolated quantiles, without holding all values in one task.

    Values are counted, sorted by range, and the ranks come from running sums.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(ordered_chunks(counts, "_v"), [], ["_pos"], {"_upto": F.col("_c")})
    total = counts.agg(F.sum("_c")).scalar()
    placed = ranked.withColumn("_n", total)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    parts = {n: (F.col("_n") - 1) * q for n, q in shares.items()}
    found = placed.agg(
        *[at(F.floor(p)).alias(f"_a_{n}") for n, p in parts.items()],
        *[at(F.ceil(p)).alias(f"_b_{n}") for n, p in parts.items()],
        *[F.max(p - F.floor(p)).alias(f"_g_{n}") for n, p in parts.items()],
    )
    return found.select(
        *[(F.col(f"_a_{n}") + F.col(f"_g_{n}") * (F.col(f"_b_{n}") - F.col(f"_a_{n}"))).alias(n) for n in shares]
    )


def log_likelihood_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean and quartiles of a log-likelihood column."""
    quartiles = exact_quantiles(df, value, {"p25": 0.25, "p75": 0.75})
    return quartiles.select(df.agg(F.avg(value)).scalar().alias("mean"), "p25", "p75")


def imbalance_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Two-class metrics with the rarer true class as positive; missing predictions are left out.

    One row: positive class, the four counts, true rates, AUC, geometric mean, precision,
    recall and F-measure.
    """
    counts = confusion_counts(df, actual, predicted).where(F.col("predicted") != UNKNOWN)
    sizes = counts.groupBy("actual").agg(F.sum("n").alias("n"))
    positive = sizes.agg(F.min(F.struct("n", "actual"))["actual"]).scalar()
    tagged = counts.withColumn("positive", positive)

    def cell(is_true: bool, said: bool) -> Column:
        a = F.col("actual") == F.col("positive")
        p = F.col("predicted") == F.col("positive")
        return F.sum(F.when((a if is_true else ~a) & (p if said else ~p), F.col("n")).otherwise(0))

    cells = tagged.groupBy("positive").agg(
        cell(True, True).alias("tp"), cell(True, False).alias("fn"),
        cell(False, True).alias("fp"), cell(False, False).alias("tn"),
    )
    ratio = F.try_divide
    rates = cells.withColumns(
        {
            "tpr": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "tnr": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )
    return rates.withColumns(
        {
            "auc": (1 + F.col("tpr") - (1 - F.col("tnr"))) / 2,
            "gm": F.sqrt(F.col("tpr") * F.col("tnr")),
            "f_measure": ratio(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr")),
        }
    )


def regression_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: correlation (0 without spread), absolute and squared error, predictable rows."""
    both = F.col(predicted).isNotNull() & ~F.isnan(F.col(predicted).cast("double"))
    a = F.when(both, F.col(actual).cast("double"))
    p = F.when(both, F.col(predicted).cast("double"))
    spread = (F.var_pop(a) > 0) & (F.var_pop(p) > 0)
    return df.agg(
        F.when(spread, F.corr(a, p)).otherwise(F.lit(0.0)).alias("correlation"),
        F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.count(p).alias("predictable"), (F.count(F.lit(1)) - F.count(p)).alias("unpredictable"),
        F.count(F.lit(1)).alias("total"),
    )


def error_rate(df: DataFrame, actual: str, predicted: str, missing=-1) -> DataFrame:
    """Share of wrong predictions among rows whose prediction is not ``missing``."""
    known = F.col(predicted) != missing
    wrong = F.when(known, (F.col(actual) != F.col(predicted)).cast("double"))
    return df.agg(F.avg(wrong).alias("error"), F.count(wrong).alias("n"))


def with_first_category(probabilities: Column) -> Column:
    """Full category vector from the probabilities of categories 1..n-1."""
    rest = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    return F.concat(F.array(1.0 - rest), probabilities)


def log_likelihood(probabilities: Column, category: Column) -> Column:
    """max(-100, ln p) of the true category; ``category`` counts from 0."""
    return F.greatest(F.lit(-100.0), F.ln(F.greatest(F.get(probabilities, category), F.lit(1e-300))))
