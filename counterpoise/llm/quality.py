"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of the whole text are column expressions.  Shallow trees are grown on labelled rows;
every path from a root is a rule, a conjunction of thresholds.  Lasso logistic regression on
the rules leaves few with a weight, and these become one column expression, so that scoring
is a scan without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, materialize
from .frames import without_ids

TRAIN_ROWS = 20_000
TREES = 24
DEPTH = 3
LASSO = 0.001
ACCEPT = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """What a rule may ask of a text; a null text counts as empty, shares of nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda w: w != "")
    chars, n, m = F.length(text), F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return (part / F.greatest(whole, F.lit(1))).cast("double")

    def found(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(chars, n),
        "new_words": share(F.size(F.array_distinct(words)), n),
        "new_lines": share(F.size(F.array_distinct(lines)), m),
        "line_words": F.log1p(share(n, m)),
        "stops": share(found(r"[.!?]"), n),
        "commas": share(found(r"[,;:]"), n),
        "symbols": share(found(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"), chars),
        "symbol_runs": share(found(r"[^\p{L}\p{N}\s.,;:!?'\"()-]{2}"), n),
        "digits": share(found(r"[0-9]"), chars),
        "capitals": share(found(r"\p{Lu}"), n),
        "gaps": share(found(r"[\x20\x09-\x0D]"), chars),
    }


STATISTICS = (
    "log_words", "word_length", "new_words", "new_lines", "line_words", "stops", "commas", "symbols", "symbol_runs",
    "digits", "capitals", "gaps",
)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; a rule is a tuple of (statistic, at most / above, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...] = field(default=())

    def score(self) -> Column:
        """Probability of label 1 from the statistic columns."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(conditions) -> Column:
    out = F.lit(True)
    for name, at_most, threshold in conditions:
        out = out & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
    return out


def tree_paths(description: str, names: list[str]) -> list[tuple]:
    """Conditions of every node below the root, from a tree's printed form."""
    paths, stack = [], []
    for line in description.splitlines():
        met = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if met:
            deep = len(met[1])
            stack = [s for s in stack if s[0] < deep]
            stack.append((deep, (names[int(met[3])], met[4] == "<=", float(met[5]))))
            paths.append(tuple(c for _, c in stack))
    return paths


def simplified(path: tuple) -> tuple:
    """One bound per statistic and side, in a fixed order."""
    bounds: dict = {}
    for name, at_most, t in path:
        old = bounds.get((name, at_most))
        bounds[name, at_most] = t if old is None else min(old, t) if at_most else max(old, t)
    return tuple(sorted((n, a, t) for (n, a), t in bounds.items()))


def fit(rows: DataFrame, label: str = "label", names=STATISTICS, trees: int = TREES, depth: int = DEPTH,
        lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Model from labelled rows of statistics; one class alone gives its share as constant score."""
    known = rows.where(F.col(label).isNotNull()).select(*names, F.col(label).cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        only = next(iter(counts), 0.5)
        return RuleModel(math.log((only + 0.01) / (1.01 - only)))
    seen = VectorAssembler(inputCols=list(names), outputCol="features").transform(known)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, bootstrap=False,
                                    featureSubsetStrategy="onethird", seed=seed).fit(seen)
    rules = sorted({simplified(p) for t in forest.trees for p in tree_paths(t.toDebugString, list(names))})
    flags = known.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    fired = materialize(fired.select("label", "features"), "rules")
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60).fit(fired)
    discard(fired)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w != 0.0]
    return RuleModel(float(model.intercept), tuple(weights))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(``id_col``, ``held_out``, ``score``, ``predicted``) of every document.

    Trained on at most about ``train_rows`` labelled rows, taken evenly by hash from those whose
    crc32 of the id modulo 4 is not 2.  Inputs of the score are ``STATISTICS`` alone.  Null and
    empty texts are scored as empty texts; null labels are left out; without labels every
    score is the same.  Statistics are written once, for training and for scoring.
    """
    stats = docs.select(F.col(id_col), *[c.alias(n) for n, c in statistics(F.col(text_col)).items()])
    stats = materialize(stats, "statistics")
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    share = train_rows / max(1, usable.count())
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    sample = materialize(stats.join(drawn, stats[id_col] == drawn["_id"]).drop("_id"), "train")
    model = fit(sample)
    discard(sample)
    scored = stats.select(id_col, held_out(F.col(id_col)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents that the classifier accepts; rows without an id stay."""
    bad = score_documents(docs, labels, id_col, **options).where(F.col("predicted") == 0)
    return without_ids(docs, id_col, bad, id_col)
