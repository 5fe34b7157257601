"""Ranked lexical search by dense blocked matrix products.

The terms of the items are the only ones that count.  A first pass over the documents keeps, per
document, these terms with their occurrences.  In the second pass blocks of documents become dense
tiles of impacts (documents x terms) that meet tiles of weights (terms x items) in float64.  A tile
of terms is so narrow that a sum stays below 2^53, so products are exact and add up in 64-bit
integers.  Each task keeps its k best documents per item, ties included by id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import discard, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_BYTES = 16 << 20
TERM_TILE = 4096
ITEM_TILE = 256
DOC_TILE = 1024
SALTS = 64
MOST_IMPACT = 1_000_000


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of ASCII letters and digits and of code points beyond ASCII, A-Z lower-cased."""
    return re.findall(TERM, text.encode().lower().decode()) if text else []


def count_terms(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc, n, terms, tf) of (doc, text): all terms counted, those of the vocabulary as two packed arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.keys()
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                held = Counter(found)
                both = held.keys() & known
                sizes.append(len(found))
                terms.append(np.fromiter((vocabulary[t] for t in both), np.int32, len(both)).tobytes())
                counts.append(np.fromiter((held[t] for t in both), np.int32, len(both)).tobytes())
            yield pd.DataFrame({"doc": batch["doc"], "n": sizes, "terms": terms, "tf": counts})

    return docs.mapInPandas(run, "doc long, n long, terms binary, tf binary")


def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the packed arrays of a batch."""
    sizes = batch["terms"].map(len).to_numpy() // 4
    term = np.frombuffer(b"".join(batch["terms"]), np.int32)
    return np.repeat(np.arange(len(batch)), sizes), term, np.frombuffer(b"".join(batch["tf"]), np.int32).astype(np.int64)


def document_frequencies(counted: DataFrame, terms: int) -> DataFrame:
    """(term, df) over packed counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(batch)[1], minlength=terms)
        held = np.flatnonzero(df)
        yield pd.DataFrame({"term": held, "df": df[held]})

    return counted.select("terms", "tf").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class ItemTile:
    """Weights of some items over the terms that these items have, in tiles with exact sums."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.terms = np.unique(np.concatenate(items))
        self.place = np.full(len(weights), -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        dense = np.zeros((len(self.terms), len(items)))
        for j, held in enumerate(items):
            dense[self.place[held], j] = weights[held]
        most = max(1, int(dense.max(initial=0)) * MOST_IMPACT)
        width = max(1, min(TERM_TILE, (2**53 - 1) // most))
        self.tiles = [(lo, dense[lo : lo + width]) for lo in range(0, len(self.terms), width)]
        self.items = len(items)

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """Documents x items as 64-bit integers."""
        at = self.place[term]
        held = at >= 0
        row, at, impact = row[held], at[held], impact[held]
        total = np.zeros((rows, self.items), np.int64)
        for lo, weights in self.tiles:
            here = (at >= lo) & (at < lo + len(weights))
            tile = np.zeros((rows, len(weights)))
            tile[row[here], at[here] - lo] = impact[here]
            total += (tile @ weights).astype(np.int64)
        return total


class Best:
    """The k best (score, doc) of each item so far; equal scores keep the smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        doc = np.concatenate((self.doc, docs[row]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - first[item]
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def best_documents(counted: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task's documents."""
    ids = np.array([i for i, _ in items], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles = [(lo, ItemTile([t for _, t in items[lo : lo + ITEM_TILE]], weights)) for lo in range(0, len(items), ITEM_TILE)]
        best = [Best(t.items, k) for _, t in tiles]
        for batch in batches:
            for lo in range(0, len(batch), DOC_TILE):
                part = batch.iloc[lo : lo + DOC_TILE]
                row, term, tf = unpacked(part)
                length = 50 + (50 * part["n"].to_numpy(np.int64) * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 20 * length[row])
                docs = part["doc"].to_numpy(np.int64)
                for (_, tile), held in zip(tiles, best):
                    held.add(tile.scores(row, term, impact, len(part)), docs)
        for (lo, _), held in zip(tiles, best):
            yield pd.DataFrame({"item_id": ids[lo + held.item], "doc_id": held.doc, "score": held.score})

    return counted.mapInPandas(run, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct (item, term)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [set(terms_of(text)) for text in batch["text"]]
            if any(held):
                yield pd.DataFrame({"item": np.repeat(batch["item"].to_numpy(np.int64), [len(h) for h in held]), "term": [t for h in held for t in h]})

    given = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, "item long, term string").distinct()


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above zero for each item.

    Documents with equal scores come by ascending id; with fewer than ``k`` all are returned.  Rows
    with a null id are left out on both sides, rows of one item id are one item; null and empty texts
    have no terms.  Items' terms go through the driver in groups of about ``ITEM_BYTES``, and every
    group is a pass over all documents.  Scores are exact while 50 * n * N fits 63 bits.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    asked = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    size = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    groups = math.ceil(size / ITEM_BYTES)
    out = None
    for group in range(groups):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).groupBy("item").agg(F.collect_list("term")).collect()
        vocabulary: dict[str, int] = {}
        held = [(item, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in terms], np.int32)) for item, terms in sorted(part)]
        counted = materialize(count_terms(given, vocabulary).where(F.col("n") > 0), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary))
        rated = document_frequencies(counted, len(vocabulary)).select(
            "term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
        for term, w in rated.collect():
            weights[term] = w
        found = best_documents(counted.where(F.length("terms") > 0), held, weights, n_docs, max(n_terms, 1), k)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    discard(asked)
    # tasks' lists meet in two steps, so no item gathers all of them in one task
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_salt")
    best = [F.col("score").desc(), "doc_id"]
    salted = out.select("*", salt).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "_salt").orderBy(*best)))
    final = salted.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*best)))
    return final.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
