"""Hashed feature vectors (row, col, val) of fixed cardinality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draw import hash32
from ..sources.io import gather
from .prefix import ordered_chunks, running_sums

CARDINALITY = 5000
PROBES = 2
WORD_SEED = 100
WORD = r"(\w+)"


def slots(name: str, word: Column | None, cardinality: int, probes: int, base: int) -> Column:
    """Array of slots, one per probe, from the hash of (name, word, base + probe)."""
    parts = [F.lit(name)] if word is None else [F.lit(name), word]
    return F.array(*[F.pmod(hash32(*parts, F.lit(base + p)), F.lit(cardinality)) for p in range(probes)])


def word_slots(name: str, word: Column, cardinality: int = CARDINALITY, probes: int = PROBES) -> Column:
    return slots(name, word, cardinality, probes, WORD_SEED)


def name_slots(name: str, cardinality: int = CARDINALITY, probes: int = 1) -> Column:
    return slots(name, None, cardinality, probes, 0)


def _gather(rows: DataFrame, row: str, places: Column, weight: Column) -> DataFrame:
    spread = rows.select(F.col(row).alias("row"), F.explode(places).alias("col"), weight.alias("_w"))
    return spread.groupBy("row", "col").agg(F.sum("_w").alias("val"))


def with_weights(df: DataFrame, word: str, weights: DataFrame | None, out: str = "_weight") -> DataFrame:
    """Weight of each word; one the table (word, weight) lacks gets half the smallest weight."""
    if weights is None:
        return df.withColumn(out, F.lit(1.0))
    lookup = weights.select(F.col("word").alias("_word"), F.col("weight").cast("double").alias("_w"))
    missing = lookup.agg(F.min("_w") / 2).scalar()
    joined = df.join(lookup, F.col(word) == F.col("_word"), "left")
    return joined.withColumn(out, F.coalesce("_w", missing)).drop("_word", "_w")


def encode_word(
    df: DataFrame, row: str, word: str, name: str | None = None, weights: DataFrame | None = None,
    cardinality: int = CARDINALITY, probes: int = PROBES,
) -> DataFrame:
    weighted = with_weights(df, word, weights)
    return _gather(weighted, row, word_slots(name or word, F.col(word), cardinality, probes), F.col("_weight"))


def adaptive_weights(df: DataFrame, row: str, word: str, running: bool = True) -> DataFrame:
    """Weight -ln((count + 1/2) / (n + distinct/2 + 1/2)) of each row's word.

    ``running`` counts the rows up to this one in ``row`` order; otherwise whole-table
    totals are used, which needs no order.
    """
    if running:
        ordered = ordered_chunks(df, row)
        seen = running_sums(ordered, [word], ["_pos"], {"_count": F.lit(1)})
        first = (F.col("_count") == 1).cast("long")
        counts = running_sums(seen, [], ["_pos"], {"_n": F.lit(1), "_distinct": first}).drop("_pos", "_chunk")
    else:
        per_word = df.groupBy(word).agg(F.count(F.lit(1)).alias("_count"))
        counts = df.join(per_word, word).withColumns(
            {"_n": df.agg(F.count(F.lit(1))).scalar(), "_distinct": per_word.agg(F.count(F.lit(1))).scalar()}
        )
    weight = -F.ln((F.col("_count") + 0.5) / (F.col("_n") + 0.5 * F.col("_distinct") + 0.5))
    return counts.withColumn("_weight", weight).drop("_count", "_n", "_distinct")


def encode_adaptive(
    df: DataFrame, row: str, word: str, name: str | None = None, running: bool = True,
    cardinality: int = CARDINALITY, probes: int = PROBES,
) -> DataFrame:
    weighted = adaptive_weights(df, row, word, running)
    return _gather(weighted, row, word_slots(name or word, F.col(word), cardinality, probes), F.col("_weight"))


def encode_text(
    df: DataFrame, row: str, text: str, name: str | None = None, weight: float = 1.0,
    weights: DataFrame | None = None, tokens: Column | None = None,
    cardinality: int = CARDINALITY, probes: int = PROBES,
) -> DataFrame:
    """Distinct words of a text, each weighted by weight * log2(1 + count).

    ``tokens`` replaces the split at non-word characters, for example by an analyzer.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), 1) if tokens is None else tokens
    # words are counted and gathered where their whole text arrives
    counts = gather(df, row).select(row, F.explode(words).alias("_token")).groupBy(row, "_token").agg(F.count(F.lit(1)).alias("_c"))
    weighted = with_weights(counts, "_token", weights)
    value = weight * F.col("_weight") * F.log1p("_c") / math.log(2.0)
    return _gather(weighted, row, word_slots(name or text, F.col("_token"), cardinality, probes), value)


def encode_continuous(
    df: DataFrame, row: str, column: str, name: str | None = None, weight: float = 1.0,
    cardinality: int = CARDINALITY, probes: int = 1,
) -> DataFrame:
    """The slot comes from the name alone; the value is added."""
    places = name_slots(name or column, cardinality, probes)
    return _gather(df.where(F.col(column).isNotNull()), row, places, weight * F.col(column).cast("double"))


def encode_constant(
    df: DataFrame, row: str, name: str, weight: float = 1.0, cardinality: int = CARDINALITY, probes: int = 1
) -> DataFrame:
    return _gather(df, row, name_slots(name, cardinality, probes), F.lit(float(weight)))


def interaction_slots(name: str, a: Column, b: Column, cardinality: int, probes: int = PROBES) -> Column:
    """Slot (h1 + h2) mod n for each probe."""
    first, second = word_slots(name, a, cardinality, probes), word_slots(name, b, cardinality, probes)
    return F.zip_with(first, second, lambda x, y: F.pmod(x + y, F.lit(cardinality)))


def encode_interaction(
    df: DataFrame, row: str, a: str, b: str, name: str | None = None, weight: float = 1.0,
    cardinality: int = CARDINALITY, probes: int = PROBES,
    a_weights: DataFrame | None = None, b_weights: DataFrame | None = None,
) -> DataFrame:
    """Pairs of values; each counts ``weight`` times the weights of both its words."""
    places = interaction_slots(name or f"{a}:{b}", F.col(a), F.col(b), cardinality, probes)
    weighted = with_weights(with_weights(df, a, a_weights, "_a_weight"), b, b_weights, "_b_weight")
    return _gather(weighted, row, places, float(weight) * F.col("_a_weight") * F.col("_b_weight"))


def encode(df: DataFrame, row: str, parts: list[DataFrame]) -> DataFrame:
    """Sum of several encodings of the same rows."""
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("row", "col").agg(F.sum("val").alias("val"))


def trace(df: DataFrame, columns: list[str], cardinality: int = CARDINALITY, probes: int = PROBES) -> DataFrame:
    """(field, value, slot) used by word encoders of ``columns``."""
    def of(c: str) -> Column:
        return F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))

    pairs = df.select(F.explode(F.array(*[of(c) for c in columns])).alias("p")).select("p.*").distinct()
    places = F.lit(None).cast("array<bigint>")
    for c in columns:
        places = F.when(F.col("field") == c, word_slots(c, F.col("value"), cardinality, probes)).otherwise(places)
    return pairs.select("field", "value", F.explode(places).alias("slot")).distinct()


def intern(df: DataFrame, column: str, order: str) -> DataFrame:
    """(value, id) in order of first appearance."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    ranked = running_sums(ordered_chunks(first, "first", "value"), [], ["_pos"], {"id": F.lit(1)})
    return ranked.select("value", (F.col("id") - 1).alias("id"))
