"""Benchmark decontamination by character grams, counts along diagonals and exact edit distance.

Candidates and decision look at the same thing, the characters of lower-case words joined by
single spaces.  Items are indexed by every run of a few bytes over their whole length, documents
look up the run at each of their places.  A run that an item and a document share lies on a
diagonal (place in the document less place in the item); edits move a leak's runs over a few
diagonals only.  Where a band of diagonals holds as many shared runs as a leak at the
threshold keeps, the edit distance to the text around it decides.

The length of the runs and the number asked for follow the item's length: both are measured
on copies with as many edits as the threshold allows, in words, in blocks, at the ends and as typos.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .frames import without_ids
from .wordhash import slices

SIMILARITY = 0.8
RECALL = 0.99
LONGEST_GRAM = 8
LEAST_SHARED = 3
BIN = 16
CELL = 4
TRIALS = 600
MEASURED_CHARS = 2_000
HITS_AT_ONCE = 4_000_000
BYTES_AT_ONCE = 1 << 21
PAIRS_AT_ONCE = 2_048
HASH_BITS = 21
BLOCK_WINDOWS = 200_000
END = b"\x01"

_kept = bytes(c if chr(c) in "0123456789_abcdefghijklmnopqrstuvwxyz" or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower-case words joined by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_kept).split())


def grams(blob: bytes, size: int) -> np.ndarray:
    """The ``size`` bytes from each place on, as one number."""
    n = max(0, len(blob) - size + 1)
    whole = np.ndarray((n,), np.uint64, blob + bytes(8), 0, (1,))
    return whole & np.uint64((1 << 8 * size) - 1)


def allowed(chars: int, similarity: float) -> int:
    """Edits within the threshold."""
    return math.floor((1 - similarity) * chars + 1e-9)


def edited(text: np.ndarray, edits: int, kind: str, draws: np.random.Generator) -> np.ndarray:
    """``text`` after ``edits`` edits of characters; new characters are not those of the text."""
    n = len(text)
    new = lambda k: draws.integers(1, 1 << 30, k).astype(np.uint64) << np.uint64(32)
    if kind == "typos":
        at, how = draws.choice(n, edits, replace=False), draws.integers(0, 3, edits)
        out, times = text.copy(), np.ones(n, int)
        out[at[how == 0]] = new((how == 0).sum())
        times[at[how == 1]], times[at[how == 2]] = 0, 2
        ends = np.cumsum(times)
        out = np.repeat(out, times)
        out[ends[at[how == 2]] - 2] = new((how == 2).sum())
        return out
    if kind == "words":
        out, left = text.copy(), edits
        while left > 0:
            size = min(left, int(draws.integers(2, 9)))
            at = int(draws.integers(max(1, n - size)))
            out[at : at + size] = new(len(out[at : at + size]))
            left -= size
        return out
    at = {"head": 0, "tail": n - edits}.get(kind, int(draws.integers(n - edits + 1)))
    if kind == "gap":
        return np.concatenate((text[:at], text[at + edits :]))
    middle = new(edits)
    return np.concatenate((text[:at], middle, text[at + (0 if kind == "filling" else edits) :]))


KINDS = ("typos", "words", "block", "gap", "filling", "head", "tail")


@functools.lru_cache(maxsize=None)
def measured(chars: int, edits: int, recall: float) -> tuple[int, int, int]:
    """(bytes of a gram, shared grams and cells to ask for) for items of ``chars`` characters.

    Each kind of edited copy of a text without repeats keeps at least so many grams in its
    best band with probability ``recall``; repeats only add to them.  Where no length leaves
    ``LEAST_SHARED``, grams are so short that some gram of the item is free of edits whatever they are.
    """
    draws = np.random.default_rng((chars, edits))
    text = np.arange(1, chars + 1, dtype=np.uint64)
    runs = []
    for kind in KINDS:
        for _ in range(TRIALS if kind == "typos" else TRIALS // 8):
            copy = edited(text, edits, kind, draws).astype(np.int64)
            place = np.arange(len(copy))
            # new characters break the row of diagonals; a gram survives where it is one run
            diagonal = np.where(copy <= chars, place - copy, -chars - 1 - place * 2 - chars)
            runs.append((kind, int(draws.integers(BIN)), place, diagonal))
    for size in range(min(LONGEST_GRAM, chars), 0, -1):
        shared = defaultdict(list)
        for kind, shift, place, diagonal in runs:
            n = len(diagonal) - size + 1
            if n <= 0:
                shared[kind].append((0, 0))
                continue
            same = (np.diff(diagonal) == 0).astype(int)
            whole = np.concatenate(([0], np.cumsum(same)))
            free = (whole[size - 1 :][:n] - whole[:n] == size - 1) & (diagonal[:n] > -chars - 1)
            bins, cells = (diagonal[:n][free] + chars + shift) // BIN, (place[:n] - diagonal[:n])[free] // CELL
            hits = np.bincount(bins, minlength=2)
            spread = np.bincount(np.unique(bins * chars + cells) // chars, minlength=2)
            hits, spread = hits[1:] + hits[:-1], spread[1:] + spread[:-1]
            best = int(spread.argmax())
            shared[kind].append((int(hits[best]), int(spread[best])))
        least = [min(int(np.quantile([x[k] for x in v], (1 - recall) / 2, method="lower")) for v in shared.values()) for k in (0, 1)]
        if least[1] >= LEAST_SHARED:
            return size, *least
    return max(1, min(LONGEST_GRAM, chars // (edits + 1))), 1, 1


def asked(chars: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """``measured`` for the next smaller length of a grid in steps of a tenth."""
    if allowed(chars, similarity) == 0:
        return min(LONGEST_GRAM, chars), 1 + max(0, chars - LONGEST_GRAM), 1
    if chars > 64:
        chars = min(MEASURED_CHARS, math.floor(1.1 ** math.floor(math.log(chars, 1.1) + 1e-9)))
    return measured(chars, allowed(chars, similarity), recall)


@dataclass(frozen=True)
class Grams:
    """Grams of one length of the items that use it."""

    size: int
    marks: np.ndarray  #: by hash of a gram, whether any item has it
    known: np.ndarray  #: distinct grams, sorted
    first: np.ndarray  #: where a gram's places start, and the end
    item: np.ndarray
    place: np.ndarray


@dataclass(frozen=True)
class Index:
    """One block of items."""

    ids: np.ndarray
    texts: list[str]
    sizes: np.ndarray  #: bytes of each item
    edits: np.ndarray
    least: np.ndarray  #: shared grams to ask for
    spread: np.ndarray  #: cells of the item that they start in
    classes: list[Grams]


def hashed(values: np.ndarray) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


def build_index(ids: list[int], texts: list[str], similarity: float, recall: float) -> Index:
    blobs = [normal(t) for t in texts]
    some = [i for i, b in enumerate(blobs) if b]
    ids, blobs = [ids[i] for i in some], [blobs[i] for i in some]
    plain = [b.decode("utf-8", "replace") for b in blobs]
    ask = [asked(len(t), similarity, recall) for t in plain]
    classes = []
    for size in sorted({a[0] for a in ask}):
        members = [i for i, a in enumerate(ask) if a[0] == size]
        own = [grams(blobs[i], size) for i in members]
        item = np.repeat(members, [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own])
        flat = np.concatenate(own)
        order = np.argsort(flat, kind="stable")
        known, first = np.unique(flat[order], return_index=True)
        marks = np.zeros(1 << HASH_BITS, bool)
        marks[hashed(known)] = True
        classes.append(Grams(size, marks, known, np.append(first, len(flat)), item[order], place[order]))
    edits = np.array([allowed(len(t), similarity) for t in plain], int)
    return Index(np.array(ids), plain, np.array([len(b) for b in blobs], int), edits, *(np.array([a[k] for a in ask], int) for k in (1, 2)), classes)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, from the counts of parts."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, int), np.zeros(0, int)
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(int)


def pairs_of_bins(key: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First of two neighbouring bins (sorted ``key``) that hold ``least`` together; the second may be empty."""
    after = np.zeros(len(key), int)
    after[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    return key[count + after >= least]


def bands(blob: bytes, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, first diagonal) of the bands of ``blob`` that share enough grams with an item."""
    lead = int(index.sizes.max(initial=0)) // BIN + 1
    many = len(blob) // BIN + lead + 3
    cells = int(index.sizes.max(initial=0)) // CELL + 1
    found = []
    for c in index.classes:
        places, rows = [np.zeros(0, int)], [np.zeros(0, int)]
        for start in range(0, len(blob), BYTES_AT_ONCE):
            values = grams(blob[start : start + BYTES_AT_ONCE + c.size - 1], c.size)
            near = np.flatnonzero(c.marks[hashed(values)])
            values = values[near]
            row = np.minimum(np.searchsorted(c.known, values), len(c.known) - 1)
            met = c.known[row] == values
            places.append(near[met] + start)
            rows.append(row[met])
        at, row = np.concatenate(places), np.concatenate(rows)
        times = c.first[row + 1] - c.first[row]
        ends = np.cumsum(times)

        def hits(keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(bin, cell) of every hit, or of those in the bins of ``keep``, some millions at once."""
            lo = 0
            while lo < len(at):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + HITS_AT_ONCE, "right")))
                n = times[lo:hi]
                hit = np.arange(n.sum()) + np.repeat(c.first[row[lo:hi]] - (ends[lo:hi] - n - done), n)
                key = c.item[hit] * many + (np.repeat(at[lo:hi], n) - c.place[hit]) // BIN + lead
                if keep is not None:
                    # a mark by the low bits spares most searches
                    near = np.flatnonzero(keep[0][key & (len(keep[0]) - 1)])
                    near = near[np.isin(key[near], keep[1])]
                    key, hit = key[near], hit[near]
                yield key, c.place[hit] // CELL
                lo = hi

        key, count = summed([np.unique(k, return_counts=True) for k, _ in hits()])
        key = pairs_of_bins(key, count, index.least[key // many])
        if not len(key):
            continue
        both = np.unique(np.concatenate((key, key + 1)))
        marks = np.zeros(1 << HASH_BITS, bool)
        marks[both & (len(marks) - 1)] = True
        spread = np.unique(np.concatenate([np.unique(k * cells + x) for k, x in hits((marks, both))]))
        key, count = np.unique(spread // cells, return_counts=True)
        found.append(pairs_of_bins(key, count, index.spread[key // many]))
    key = np.concatenate(found) if found else np.zeros(0, int)
    return key // many, (key % many - lead) * BIN


def edit_distances(pairs: list[tuple[str, str, int]]) -> list[int | None]:
    """Smallest edit distance between each item and any stretch of its text, None beyond the pair's third part.

    Bit-parallel columns (Myers), many pairs at once; an item takes a 64-bit word for 64 characters.
    """
    out: list[int | None] = [None] * len(pairs)
    by_words = defaultdict(list)
    for i, (item, _, _) in enumerate(pairs):
        by_words[-(-len(item) // 64)].append(i)
    for words, rows in by_words.items():
        rows.sort(key=lambda i: len(pairs[i][1]))
        step = max(1, min(PAIRS_AT_ONCE, PAIRS_AT_ONCE * 16 // words))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            for i, distance in zip(part, columns([pairs[i][:2] for i in part], words)):
                out[i] = int(distance) if distance <= pairs[i][2] else None
    return out


def columns(pairs: list[tuple[str, str]], words: int) -> np.ndarray:
    codes = [[np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32) for s in pair] for pair in pairs]
    own = [np.unique(a, return_inverse=True) for a, _ in codes]
    n, one = len(pairs), np.uint64(1)
    equal = np.zeros((n, 1 + max(len(u) for u, _ in own), words), np.uint64)
    text = np.zeros((max(1, max(len(b) for _, b in codes)), n), np.int64)
    for i, ((a, b), (letters, code)) in enumerate(zip(codes, own)):
        place = np.arange(len(a))
        np.bitwise_or.at(equal[i], (code + 1, place // 64), one << (place % 64).astype(np.uint64))
        k = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
        text[: len(b), i] = np.where(letters[k] == b, k + 1, 0)
    score = np.array([len(a) for a, _ in codes])
    last = ((score - 1) % 64).astype(np.uint64)
    top, best, pair = np.uint64(63), score.copy(), np.arange(n)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    for letter in text:
        now = equal[pair, letter]
        more = less = np.uint64(0)
        for w in range(words):
            eq, pv, mv = now[:, w], up[w], down[w]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            bit = last if w == words - 1 else top
            plus, minus = (ph >> bit) & one, (mh >> bit) & one
            ph, mh = (ph << one) | more, (mh << one) | less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            more, less = plus, minus
        score = score + more.astype(np.int64) - less.astype(np.int64)
        np.minimum(best, score, out=best)
    return best


def search(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, docs = batch["text"].tolist(), batch["doc"].to_numpy()
            # decided together: many short columns at once are cheaper
            yield decided(docs, [look for lo, hi in slices(texts) for look in candidates(lo, texts[lo:hi])])

    def around(blob: bytes, lo: int, hi: int, item: int, left: int, right: int) -> tuple[int, int]:
        """The bytes of a document in which a leak on these diagonals lies; characters of several bytes need more."""
        for wide in (1, 4):
            slack = wide * int(index.edits[item]) + 4
            a, b = max(lo, left - slack), min(hi, right + int(index.sizes[item]) + slack)
            if blob[a:b].isascii():
                break
        while a > lo and blob[a] & 0xC0 == 0x80:
            a -= 1
        while b < hi and blob[b] & 0xC0 == 0x80:
            b += 1
        return a, b

    def candidates(number: int, texts: list) -> list[tuple]:
        """(document's number, item, blob, start of the document, start and end of the bytes to compare)."""
        parts = [normal(t) for t in texts]
        blob = END.join(parts)
        first = np.cumsum([0, *[len(p) + 1 for p in parts]])
        items, lefts = bands(blob, index)
        if not len(items):
            return []
        # overlapping bands of an item are one look
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(items) != 0) | (np.diff(lefts) > BIN))))
        rights = lefts[np.append(opens[1:], len(items)) - 1] + 2 * BIN
        looks = set()
        for i, left, right in zip(items[opens].tolist(), lefts[opens].tolist(), rights.tolist()):
            # a band may reach over the end of a document
            d = max(0, int(np.searchsorted(first, left, "right")) - 1)
            while d < len(texts) and first[d] < right + index.sizes[i] + index.edits[i]:
                a, b = around(blob, int(first[d]), int(first[d + 1]) - 1, i, left, right)
                if b > a and b - a >= index.sizes[i] - 4 * index.edits[i]:
                    looks.add((d, i, a, b))
                d += 1
        return [(number + d, i, blob, int(first[d]), a, b) for d, i, a, b in sorted(looks)]

    def decided(docs: np.ndarray, looks: list[tuple]) -> pd.DataFrame:
        found: dict[tuple, tuple] = {}
        distances = edit_distances([(index.texts[i], blob[a:b].decode("utf-8", "replace"), int(index.edits[i])) for _, i, blob, _, a, b in looks])
        for (d, i, blob, start, a, b), distance in zip(looks, distances):
            if distance is not None:
                words = [blob.count(b" ", start, x) for x in (a, b)]
                row = (distance, docs[d], index.ids[i], 1 - distance / len(index.texts[i]), words[0], words[1] + 1)
                found[d, i] = min(found.get((d, i), row), row)
        names = ["distance", "doc", "item", "similarity", "first_word", "end_word"]
        return pd.DataFrame(list(found.values()), columns=names)[["doc", "item", *names[:1], *names[3:]]]

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per (document, item) found: ``distance``, ``similarity`` and the words it lies in.

    A document leaks an item if some stretch of it is within (1 - ``similarity``) times the
    item's length in edits, both as lower-case words joined by single spaces.  Leaks at the
    threshold whose edits are of the measured kinds (``KINDS``) are found with probability
    ``recall``, closer ones more often, and whatever is returned is exact.  Edits spread so
    evenly that no run of ``LONGEST_GRAM`` characters is left can hide a leak.  Null, empty
    and wordless texts or items match nothing.  Repeated items are each reported; rows without
    an id are left out.  ``first_word`` and ``end_word`` bound the stretch that was compared.

    Items travel to the tasks in blocks of about 12 x ``block_windows`` characters, a bounded size; a
    larger benchmark takes one pass over the documents for each block.
    """
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text")
    )
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 12 / block_windows))
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, item long, distance int, similarity double, first_word long, end_word long"
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().orderBy("id", "text").collect()
        index = build_index([r["id"] for r in rows], [r["text"] for r in rows], similarity, recall)
        found = given.mapInPandas(search(index), schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents that leak no item; rows without an id stay."""
    return without_ids(docs, id_col, find_leaks(docs, benchmark, id_col, **options), id_col)
