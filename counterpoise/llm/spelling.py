"""Spelling variants: words one edit apart, found by a scan of the sorted vocabulary.

The vocabulary is sorted and cut into blocks.  Two blocks meet only if the prefixes that their
words share could be within one edit; ranges of blocks beyond that are skipped as a whole.
Where two blocks meet, the words of one are looked up in the sorted list of the other: the rows of
the edit matrix, three cells wide, are computed once for a prefix and reused by all adjacent words
that share it, and a range of words is left as soon as its row exceeds one edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.prefix import sorted_rank
from ..session import discard, materialize

RUN = "[a-zÀ-ÿ]"
BLOCK_WORDS = 1 << 16
MAX_BLOCKS = 1 << 16
PREFIX = 64
QUERIES = 4096
HELD_WORDS = 200_000
FAR = np.int8(9)
NONE = np.int64(1 << 21)


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int = 5, least_count: int = 3, dropout: int | None = None) -> DataFrame:
    """(word, n): maximal runs of ASCII and Latin-1 letters with their occurrences, A-Z lower-cased.

    With ``dropout`` a run whose crc32 of ``<id>:<run>`` it divides loses the code point at that
    number modulo the run's length, as a stand-in for typing errors.  Null texts have no words; rows
    with a null id are left out.  Tasks add up their words before the shuffle.
    """
    pattern = re.compile(f"{RUN}{{{least_length},}}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            kept = [w for w in held if len(w) >= least_length]
            return pd.DataFrame({"word": kept, "n": [held[w] for w in kept]})

        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                if not text:
                    continue
                found = Counter(pattern.findall(text.encode().lower().decode()))
                if dropout is None:
                    held.update(found)
                else:
                    start = zlib.crc32(b"%d:" % doc)
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % dropout == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    counted = given.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


class Words:
    """Words as one array of code points with their starts."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        self.letters, self.starts = letters, starts
        self.sizes = np.diff(starts)

    @classmethod
    def of(cls, words: list[str]) -> Words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return cls(letters, np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))))

    def __len__(self) -> int:
        return len(self.sizes)

    def word(self, i: int) -> str:
        return self.letters[self.starts[i] : self.starts[i + 1]].tobytes().decode("utf-32-le")

    def letter(self, which: np.ndarray, place: int) -> np.ndarray:
        """Letter at ``place`` of the given words; ``NONE`` outside of a word."""
        inside = place < self.sizes[which] if place >= 0 else np.zeros(len(which), bool)
        out = np.full(len(which), NONE)
        out[inside] = self.letters[self.starts[which[inside]] + place]
        return out


class SortedList:
    """Distinct sorted words as ranges: those that share ``d + 1`` letters, for every depth d."""

    def __init__(self, words: Words):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.empty = np.flatnonzero(words.sizes[:1] == 0)
        going, parent, d, parents = np.arange(len(words)), np.zeros(len(words), np.int64), 0, 1
        while len(inside := np.flatnonzero(words.sizes[going] > d)):
            going, parent = going[inside], parent[inside]
            key = parent * NONE + words.letters[words.starts[going] + d].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            # the shortest word of a range comes first
            whole = np.where(words.sizes[going[first]] == d + 1, going[first], -1)
            edges = np.searchsorted(key[first], np.arange(parents + 1) * NONE)
            self.levels.append((key[first], whole, edges))
            parent = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            parents, d = len(first), d + 1

    def near(self, queries: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in this list) at an edit distance of exactly one."""
        q, node = which, np.zeros(len(which), np.int64)
        # cells of the row at depth d: d - 1, d and d + 1 letters of the query used
        low, mid, high = np.full(len(q), FAR), np.zeros(len(q), np.int8), np.where(queries.sizes[q] > 0, np.int8(1), FAR)
        short = which[queries.sizes[which] == 1] if len(self.empty) else which[:0]
        found_q, found_v = [short], [np.zeros(len(short), np.int64)]
        for d, (keys, whole, edges) in enumerate(self.levels):
            if not len(q):
                break
            free = np.flatnonzero(mid == 0)
            first, size = edges[node[free]], edges[node[free] + 1] - edges[node[free]]
            src = [np.repeat(free, size)]
            child = [np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
            # after an edit only the letters that keep a cell at one can follow
            spent = np.flatnonzero(mid != 0)
            before = []
            for cell, place in ((low, d - 1), (mid, d), (high, d + 1)):
                letter = np.where(cell[spent] == 1, queries.letter(q[spent], place), NONE)
                for other in before:
                    letter[letter == other] = NONE
                before.append(letter)
                ask = np.flatnonzero(letter != NONE)
                key = node[spent[ask]] * NONE + letter[ask]
                at = np.searchsorted(keys, key)
                hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key))
                src.append(spent[ask[hit]])
                child.append(at[hit])
            src, child = np.concatenate(src), np.concatenate(child)
            letter, q = keys[child] % NONE, q[src]
            differs = [(queries.letter(q, place) != letter).astype(np.int8) for place in (d - 1, d, d + 1)]
            a, b, c = low[src], mid[src], high[src]
            low = np.minimum(a + differs[0], b + 1)
            mid = np.minimum(np.minimum(b + differs[1], c + 1), low + 1)
            high = np.minimum(c + differs[2], mid + 1)
            size = queries.sizes[q]
            mid[size < d + 1], high[size < d + 2], low[size < d] = FAR, FAR, FAR
            last = np.select([size == d, size == d + 1, size == d + 2], [low, mid, high], FAR)
            ends = np.flatnonzero((whole[child] >= 0) & (last == 1))
            found_q.append(q[ends])
            found_v.append(whole[child[ends]])
            alive = np.flatnonzero(np.minimum(np.minimum(low, mid), high) <= 1)
            q, node, low, mid, high = q[alive], child[alive], low[alive], mid[alive], high[alive]
        return np.concatenate(found_q), np.concatenate(found_v)


def shared(a: str, b: str) -> str:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[:k]


def within_one(low: str, high: str, other_low: str, other_high: str) -> bool:
    """Whether two ranges of sorted words, whose ends may be cut short, can hold words within one edit.

    The letters that all words of a range share leave one place at most where the ranges differ; the
    words behind that place are ranges again and must overlap.
    """
    def overlap(a: int, b: int) -> bool:
        x, y, u, v = low[a:], high[a:], other_low[b:], other_high[b:]
        return (x <= v or x.startswith(v)) and (u <= y or u.startswith(y))

    one, two = shared(low, high), shared(other_low, other_high)
    k = len(shared(one, two))
    if k == min(len(one), len(two)):
        return True
    return overlap(k + 1, k + 1) or overlap(k + 1, k) or overlap(k, k + 1)


def meeting(low: list[str], high: list[str], block: int) -> list[int]:
    """Blocks from ``block`` on whose words can be within one edit of a word of this block."""
    out, ranges = [], [(block, len(low))]
    while ranges:
        a, b = ranges.pop()
        if not within_one(low[block], high[block], low[a], high[b - 1]):
            continue
        if b - a == 1:
            out.append(a)
        else:
            ranges += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


def pack(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    words = Words.of(rows["word"].tolist())
    return pd.DataFrame({
        "block": [key[0]], "letters": [words.letters.tobytes()], "starts": [words.starts.tobytes()],
        "n": [rows["n"].to_numpy(np.int64).tobytes()],
    })


def summed(queries: Words, tile: Words, n: np.ndarray, q: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Per query its number of near words and the most frequent one of them."""
    order = np.lexsort((v, -n[v], q))
    q, v = q[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    return pd.DataFrame({
        "word": [queries.word(i) for i in q[first]], "n_near": np.diff(np.append(first, len(q))),
        "best_n": n[v[first]], "best": [tile.word(i) for i in v[first]],
    })


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of two blocks in either direction; of a block with itself once."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            one, two = (
                Words(np.frombuffer(letters, np.uint32), np.frombuffer(starts, np.int64))
                for letters, starts in ((row.letters, row.starts), (row.letters2, row.starts2))
            )
            n_one, n_two = np.frombuffer(row.n, np.int64), np.frombuffer(row.n2, np.int64)
            tile = SortedList(two)
            for lo in range(0, len(one), QUERIES):
                q, v = tile.near(one, np.arange(lo, min(lo + QUERIES, len(one))))
                if len(q):
                    yield summed(one, two, n_two, q, v)
                if len(q) and row.block != row.block2:
                    yield summed(two, one, n_one, v, q)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of every word of (word, n) that has words at edit distance one.

    ``form`` is the near word of largest n, of equal ones the first in code-point order.  Words are
    distinct and not null.  A block holds ``BLOCK_WORDS`` words, or more so that there are at most
    ``MAX_BLOCKS``; only the blocks' first and last words, cut at ``PREFIX`` letters, go
    through the driver.
    """
    placed = materialize(sorted_rank(vocabulary.select("word", "n"), ["word"], out="place"), "sorted-words")
    size = max(BLOCK_WORDS, -(-placed.count() // MAX_BLOCKS))
    placed = placed.withColumn("block", F.floor(F.col("place") / size))
    ends = placed.groupBy("block").agg(F.min("word").alias("low"), F.max("word").alias("high")).orderBy("block")
    bounds = ends.select(F.substring("low", 1, PREFIX), F.substring("high", 1, PREFIX)).collect()
    low, high = [r[0] for r in bounds], [r[1] for r in bounds]
    blocks = materialize(placed.groupBy("block").applyInPandas(pack, "block long, letters binary, starts binary, n binary"), "word-blocks")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["block"]:
                others = meeting(low, high, block)
                yield pd.DataFrame({"block": block, "block2": others})

    pairs = blocks.select("block").mapInPandas(meet, "block long, block2 long")
    second = blocks.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    met = pairs.join(blocks, "block").join(second, "block2")
    tasks = max(1, min(len(low) * 8, 1 << 17))
    found = met.repartition(tasks, "block", "block2").mapInPandas(scan, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("_best")
    ).select("word", "n_near", F.col("_best.best").alias("form"), (-F.col("_best.n")).alias("form_n"))


def group_variants(vocabulary: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n).

    A word's form is its near word of largest n if that is at least ``ratio`` (2 or more) times its
    own, so chains of forms end; ``root`` is the last word of the chain, the word itself without one.
    Roots are found by doubling the steps along the chains.
    """
    vocabulary = materialize(vocabulary, "vocabulary")
    near = near_words(vocabulary)
    fits = F.col("form_n") >= ratio * F.col("n")
    words = materialize(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"),
    ), "variants")
    discard(vocabulary)
    steps = materialize(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("at")), "steps")
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("at").alias("_next"))
        longer = materialize(steps.join(ahead, "at", "left").select(
            "word", F.coalesce("_next", "at").alias("at"), F.col("_next").isNotNull().alias("_moved")), "steps")
        discard(steps)
        moved = longer.where("_moved").limit(1).count()
        steps = longer.drop("_moved")
        steps._written_path = longer._written_path
        if not moved:
            break
    return words.join(steps, "word", "left").select(
        "word", "form", F.coalesce("at", "word").alias("root"), "n", "n_near", "form_n"
    )
