"""Words of many texts as 64-bit hashes, by numpy over the bytes of a batch.

A word is a run of digits, letters, underscores and characters beyond ASCII, in lower case.
A sequence of k words is a shingle.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

_word_byte = np.zeros(256, dtype=bool)
_word_byte[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, base in enumerate((BASE, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash of each word, first word of each text and the end, byte starts, byte ends, all bytes)."""
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    blob = b"\n".join(encoded) + b"\n"
    data = np.frombuffer(blob, np.uint8)
    inside = np.concatenate(([False], _word_byte[data])).view(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    limits = np.cumsum([0, *[len(e) + 1 for e in encoded]])
    return hashes, np.searchsorted(starts, limits), starts, ends, blob


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, first shingle of each text and the end), in order of the text.

    A text with fewer than ``size`` words, but not none, is one shingle of all its words.
    """
    n = len(hashes)
    rolled = np.zeros(max(n, 1), np.uint64)
    factor = np.uint64(1)
    for k in range(size):
        rolled[: max(0, n - k)] += hashes[k:] * factor
        factor = np.uint64(int(factor) * int(STEP) % (1 << 64))
    words = np.diff(first)
    counts = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(counts)))
    # the k-th shingle of a text starts at its k-th word
    place = np.arange(out[-1]) - np.repeat(out[:-1] - first[:-1], counts)
    values = rolled[place] if n else np.zeros(0, np.uint64)
    for t in np.flatnonzero((words > 0) & (words < size)):
        total, factor = 0, 1
        for h in hashes[first[t] : first[t + 1]]:
            total = (total + int(h) * factor) % (1 << 64)
            factor = factor * int(STEP) % (1 << 64)
        values[out[t]] = np.uint64((total + int(words[t])) % (1 << 64))
    return mixed(values), out
