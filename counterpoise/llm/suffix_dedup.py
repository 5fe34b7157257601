"""Suffix-array dedup: bytes of long strings that occur more than once in the corpus are removed.

A string of ``length`` bytes is known by its anchor: of the short grams in it, the one with the
smallest hash.  Equal strings have equal anchors at equal places, so only starts that share
an anchor need to be compared, and a run of starts with one anchor is a segment of text.
Segments whose anchor occurs once are done.  Of equal segments one is kept with their count.
What is left is dealt to shards by anchor; each shard is written to disk and its suffixes are
brought into order by external induced sorting.  Starts whose neighbour in this order shares
``length`` bytes occur more than once.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize
from .induced_sort import suffix_order
from .wordhash import mixed

LENGTH = 400
GRAM = 200
CHUNK = 1 << 18
SHARD_BYTES = 1 << 20
BROADCAST_ROWS = 500_000
PLACE = np.uint64((1 << 24) - 1)
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rolling(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2^64, and the inverse powers that shift them."""
    n = len(data) + 1
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK + LENGTH + 1), b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = both[0], both[1]
    up, down = _powers[base]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1])))
    return sums, down


def hash_of(sums: np.ndarray, down: np.ndarray, first, last) -> np.ndarray:
    return mixed((sums[last] - sums[first]) * down[first])


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, number of starts, two segment hashes) of one stretch of bytes."""
    sums, down = rolling(data, BASES[0])
    more, less = rolling(data, BASES[1])
    grams, starts, wide = len(data) - gram + 1, len(data) - length + 1, length - gram + 1
    places = np.arange(grams)
    hashes = hash_of(sums, down, places, places + gram)
    # smallest hash, then leftmost; both follow from the string alone
    order = np.full(-(-grams // wide) * wide, ~np.uint64(0))
    order[:grams] = (hashes & ~PLACE) | places.astype(np.uint64)
    rows = order.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & PLACE).astype(np.int64)
    cuts = np.flatnonzero(np.diff(anchor)) + 1
    first, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [starts]))
    at, last = anchor[first], end - 1 + length
    offset = mixed((at - first).astype(np.uint64))
    one = hash_of(sums, down, first, last) ^ offset
    two = hash_of(more, less, first, last) + offset
    return hashes[at].view(np.int64), first, end - first, one.view(np.int64), two.view(np.int64)


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of (doc, text): (doc, key, first, starts, one, two), long texts in overlapping chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, n = [], 0
            for doc, text in zip(batch["doc"], batch["text"]):
                data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                for lo in range(0, len(data) - length + 1, CHUNK):
                    key, first, starts, one, two = segments(data[lo : lo + CHUNK + length - 1], length, gram)
                    held.append((np.full(len(key), doc), key, first + lo, starts, one, two))
                    n += len(key)
                if n > 1 << 16:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))
                    held, n = [], 0
            if held:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*held)))))

    names = ["doc", "key", "first", "starts", "one", "two"]
    return docs.mapInPandas(run, "doc long, key long, first long, starts long, one long, two long")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int, few: bool) -> DataFrame:
    """Bytes of the wanted segments, (key, one, two, many, bytes); ``few`` rows are sent to the texts."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "one", "two", "many", "first", "starts")).alias("asked"))
    joined = docs.join(F.broadcast(asked) if few else asked, "doc").select("text", "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, asked in zip(batch["text"], batch["asked"]):
                data = text.encode("utf-8", "replace")
                yield pd.DataFrame([
                    (a["key"], a["one"], a["two"], a["many"], data[a["first"] : a["first"] + a["starts"] + length - 1]) for a in asked
                ], columns=["key", "one", "two", "many", "bytes"])

    return joined.mapInPandas(run, "key long, one long, two long, many boolean, bytes binary")


def repeated_starts(length: int):
    """Sorts the suffixes of a shard and returns the runs of starts that occur more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            path, names, sizes = os.path.join(folder, "text"), [], []
            with open(path, "wb") as file:
                for batch in batches:
                    names.append(batch[["key", "one", "two", "many"]])
                    for b in batch["bytes"]:
                        # bytes move up by two: 1 ends a segment, 0 ends the text
                        (np.frombuffer(b, np.uint8).astype(np.uint16) + np.uint16(2)).tofile(file)
                        np.array([1], np.uint16).tofile(file)
                        sizes.append(len(b))
                np.array([0], np.uint16).tofile(file)
            if not sizes:
                return
            text = np.memmap(path, np.uint16, "r")
            order = suffix_order(text, folder, length)
            begin = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))[:-1]
            yield runs(text, order, begin, np.array(sizes), pd.concat(names, ignore_index=True))
            del text

    def runs(text: np.ndarray, order: np.ndarray, begin: np.ndarray, sizes: np.ndarray, names: pd.DataFrame) -> pd.DataFrame:
        n = len(text)
        # places from which a whole string lies inside its segment
        valid = np.zeros(n, bool)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + sizes - length + 1, -1)
        valid[:] = np.cumsum(mark[:n]) > 0
        prints = []
        for base in BASES:
            sums, down = long_rolling(text, base)
            ends = np.minimum(np.arange(n) + length, n)
            prints.append((sums[ends] - sums[:n]) * down[:n])
        a, b = order[:-1], order[1:]
        same = valid[a] & valid[b] & (prints[0][a] == prints[0][b]) & (prints[1][a] == prints[1][b])
        twice = np.zeros(n + 1, bool)
        twice[a[same]] = twice[b[same]] = True
        edge = np.diff(np.concatenate(([False], twice)).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(begin, first, side="right") - 1
        # segments that occur more than once are known as a whole
        single = ~names["many"].to_numpy(bool)[owner]
        first, end, owner = first[single], end[single], owner[single]
        out = names.iloc[owner][["key", "one", "two"]].reset_index(drop=True)
        out["from"], out["to"] = first - begin[owner], end - begin[owner]
        return out

    return run


def long_rolling(text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(len(text) + 1, base, np.uint64)
    down = np.full(len(text) + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(text.astype(np.uint64) * up[:-1]))), down


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal runs removed)."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edges = [0, *[x for run in runs for x in run], len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return kept, len(data) - len(kept), len(runs)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
) -> DataFrame:
    """(``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept``) of every document, ``kept`` as bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same document or another; strings are judged on the input and never cross documents.
    Null and empty texts have no bytes; texts shorter than ``length`` stay whole.  Ids must be
    unique integers; rows with a null id are left out.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    found = materialize(find_segments(given, length, gram), "segments")
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    again = materialize(found.join(materialize(keys, "keys"), "key", "left_semi"), "repeated")
    discard(found)
    kinds = again.groupBy("key", "one", "two").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "first", "starts")).alias("where")
    )
    # of each anchor: several different segments, some of them single?
    mixed_keys = kinds.groupBy("key").agg(((F.count(F.lit(1)) > 1) & (F.min("n") == 1)).alias("mixed"))
    kinds = materialize(kinds.join(mixed_keys, "key").select("key", "one", "two", (F.col("n") > 1).alias("many"), "mixed", "where"), "kinds")

    wanted = kinds.where("mixed").select("key", "one", "two", "many", "where.*")
    rows, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("starts") + length), F.lit(0))).first()
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SHARD_BYTES))
    shards = cut_out(given, wanted, length, rows <= BROADCAST_ROWS).repartition(parts, "key")
    single = materialize(shards.mapInPandas(repeated_starts(length), "key long, one long, two long, `from` long, `to` long"), "repeats")

    names = ["key", "one", "two"]
    whole = again.join(kinds.where("many").select(*names), names).select(
        "doc", F.col("first").alias("a"), (F.col("first") + F.col("starts") + length - 1).alias("b")
    )
    # a segment that occurs once belongs to one document, which its row names
    some = kinds.where(F.col("mixed") & ~F.col("many")).select(*names, "where.doc", "where.first").join(single, names).select(
        "doc", (F.col("first") + F.col("from")).alias("a"), (F.col("first") + F.col("to") + length - 1).alias("b")
    )
    spans = whole.union(some).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"]):
                data = (text or "").encode("utf-8", "replace")
                kept, removed, count = without(data, [(s["a"], s["b"]) for s in spans] if spans is not None else [])
                rows.append((doc, len(data), removed, count, kept))
            yield pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = given.join(spans, "doc", "left").mapInPandas(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc", id_col)
