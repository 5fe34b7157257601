"""Suffix order of a text by external induced sorting, in bulk steps of numpy.

Suffixes smaller than both neighbours (S*) are sorted first: their substrings are sorted by
induction and named, and if names repeat the string of names is sorted by recursion.  Two
more inductions give all suffixes: a queue keyed by first letter pops suffixes in order,
and each one popped pushes the suffix one place to its left.  The queue keeps its front in
memory and the rest in files once it outgrows its share; text and types may be memory maps.
"""

from __future__ import annotations

import os

import numpy as np

IN_MEMORY = 1 << 20
QUEUE_BYTES = 64 << 20
FRONT = 1 << 14
NEVER = np.int64(1 << 62)


class BulkQueue:
    """Priority queue of (key, item), first in first out within a key; pops whole key ranges."""

    def __init__(self, top: int, expected: int, folder: str, memory: int = QUEUE_BYTES):
        self.buckets = int(min(top + 1, max(512, expected // 2048)))
        self.width = top // self.buckets + 1
        self.folder, self.memory, self.held, self.front = folder, memory, 0, 0
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(self.buckets)]
        self.spilled: set[int] = set()

    def path(self, bucket: int) -> str:
        return os.path.join(self.folder, f"queue-{id(self)}-{bucket}")

    def push(self, keys: np.ndarray, items: np.ndarray) -> None:
        place = keys // self.width
        order = np.argsort(place.astype(np.uint16) if self.buckets < 1 << 16 else place, kind="stable")
        keys, items, place = keys[order], items[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        for k, i, b in zip(np.split(keys, cuts), np.split(items, cuts), place[np.concatenate(([0], cuts))] if len(place) else ()):
            self.parts[b].append((k, i))
        self.held += 16 * len(items)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Write the buckets farthest from the front until half of the memory is free."""
        for b in range(self.buckets - 1, self.front, -1):
            if self.held <= self.memory // 2:
                return
            if self.parts[b]:
                rows = np.stack([np.concatenate([p[j] for p in self.parts[b]]) for j in (0, 1)], axis=1)
                with open(self.path(b), "ab") as file:
                    rows.astype(np.int64).tofile(file)
                self.held -= 16 * len(rows)
                self.parts[b] = []
                self.spilled.add(b)

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        """All of the first bucket that holds anything, sorted by key."""
        while self.front < self.buckets and not self.parts[self.front] and self.front not in self.spilled:
            self.front += 1
        if self.front == self.buckets:
            return None
        parts, self.parts[self.front] = self.parts[self.front], []
        self.held -= 16 * sum(len(k) for k, _ in parts)
        if self.front in self.spilled:
            rows = np.fromfile(self.path(self.front), np.int64).reshape(-1, 2)
            parts.insert(0, (rows[:, 0], rows[:, 1]))
            os.remove(self.path(self.front))
            self.spilled.discard(self.front)
        keys, items = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        if self.width > 1:
            order = np.argsort(keys, kind="stable")
            keys, items = keys[order], items[order]
        return keys, items


def induce(text: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, down: bool, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, from ``seeds`` in order, and which of them were seeds.

    A popped suffix pushes its left neighbour if ``wanted`` there.  Upward, induced suffixes
    of a letter come before the seeds of this letter; downward likewise in reverse.
    """
    highest = int(text.max()) if len(text) else 0

    def keys_of(letters: np.ndarray) -> np.ndarray:
        letters = letters.astype(np.int64)
        return 2 * (highest - letters if down else letters)

    queue = BulkQueue(2 * highest + 1, len(text), folder, memory)
    step = 1 << 20
    for lo in range(0, len(seeds), step):
        part = np.asarray(seeds[lo : lo + step])
        queue.push(keys_of(text[part]) + 1, part)
    popped, seeded = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    while (found := queue.pop()) is not None:
        keys, items = found
        limit = (queue.front + 1) * queue.width
        while len(items):
            one = keys[0] == keys[-1]
            k, i = (keys, items) if one else (keys[:FRONT], items[:FRONT])
            left = np.maximum(i - 1, 0)
            grows = (i > 0) & wanted[left]
            new = np.where(grows, keys_of(text[left]), NEVER)
            # popped together only while nothing pushed belongs before what follows
            least = np.minimum.accumulate(new)
            late = np.flatnonzero(k[1:] > least[:-1])
            cut = int(late[0]) + 1 if len(late) else len(k)
            popped.append(i[:cut])
            seeded.append((k[:cut] & 1).astype(bool))
            grows = grows[:cut]
            fresh, moved = new[:cut][grows], left[:cut][grows]
            keys, items = keys[cut:], items[cut:]
            near = fresh < limit
            if near.any():
                keys, items = np.concatenate((keys, fresh[near])), np.concatenate((items, moved[near]))
                if queue.width > 1:
                    order = np.argsort(keys, kind="stable")
                    keys, items = keys[order], items[order]
                fresh, moved = fresh[~near], moved[~near]
            if len(moved):
                queue.push(fresh, moved)
    return np.concatenate(popped), np.concatenate(seeded)


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one counts as such."""
    step = np.zeros(len(text), np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1].astype(np.int64))
    step[-1] = 1
    # equal letters take the type of the first different one to their right
    at = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def doubled(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a text that fits memory, by doubling ranks of the groups still tied.

    Suffixes that agree in ``depth`` letters may come in any order.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    letters = text[order]
    first = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    sizes = np.bincount(rank, minlength=n)
    open_, width = np.flatnonzero(sizes[rank] > 1), 1
    while len(open_) and width < depth:
        following = np.full(len(open_), -1, np.int64)
        inside = open_ + width < n
        following[inside] = rank[open_[inside] + width]
        by = np.argsort(rank[open_] * (n + 1) + following + 1, kind="stable")
        open_, group, following = open_[by], rank[open_[by]], following[by]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new = new_group | np.concatenate(([True], following[1:] != following[:-1]))
        at = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = group + start - np.maximum.accumulate(np.where(new_group, at, 0))
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        width *= 2
    return np.argsort(rank, kind="stable")


def same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Pairwise equality of substrings, letter by letter over the pairs still equal."""
    same = size_a == size_b
    going, depth = np.flatnonzero(same), 0
    while len(going):
        equal = text[a[going] + depth] == text[b[going] + depth]
        same[going[~equal]] = False
        depth += 1
        going = going[equal]
        going = going[size_a[going] > depth]
    return same


def suffix_order(
    text: np.ndarray, folder: str, depth: int | None = None, memory: int = QUEUE_BYTES, in_memory: int = IN_MEMORY,
) -> np.ndarray:
    """Positions of all suffixes in order.  The last letter must be smaller than all others.

    Suffixes that agree in ``depth`` letters may come in any order among themselves.
    """
    n = len(text)
    depth = n if depth is None else depth
    if n <= in_memory:
        return doubled(np.asarray(text), depth)
    small = types(text)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    large = ~small

    def all_from(stars: np.ndarray) -> np.ndarray:
        up, seeded = induce(text, large, stars, False, folder, memory)
        down, _ = induce(text, small, up[~seeded][::-1], True, folder, memory)
        return np.concatenate((down, [n - 1]))[::-1]

    # substrings from one S* to the next are sorted by induction from any order within a letter
    is_star = np.zeros(n, bool)
    is_star[star] = True
    found = all_from(star)
    found = found[is_star[found]]
    size = np.empty(n, np.int64)
    size[star] = np.diff(np.append(star, n - 1)) + 1
    same = same_substrings(text, found[:-1], found[1:], size[found[:-1]], size[found[1:]])
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(star):
        reduced = np.empty(n, np.int64)
        reduced[found] = names
        # a name stands for two letters at least
        order = suffix_order(reduced[star], folder, depth // 2 + 1, memory, in_memory)
        found = star[order]
    return all_from(found)
