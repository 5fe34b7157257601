"""Odd inputs and plain-Python versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import re

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, row string, id long, _doc long, _kept string, "
        "gone long, shard string, size string, host string, `_source` string")
SHARED = "This line of boilerplate is shared by many documents."
LONG = "A very long text holds many words and so it goes on and on. " * 3000


def odd_rows():
    """Null, empty, long and repeated texts, ties, and extra columns with names that operators use."""
    texts = [
        (1, None), (2, ""), (3, "word"), (4, LONG), (5, LONG), (6, SHARED + "\nfirst tail"), (7, "  " + SHARED.upper() + "\t\nsecond tail"),
        (8, SHARED), (9, "two words"), (10, "two words"), (11, "\n\n\n"), (12, "ééé ßß\nünïcode 😀 text"), (13, " .,;!? "),
        (None, "no id at all"), (None, None),
    ]
    extra = ("r", 7, 8, "k", 9, "s", "z", "h", "q")
    return [(i, t, "en", [None, "b", "a", "c"][n % 4], len(t or ""), *extra) for n, (i, t) in enumerate(texts)]


def words(text):
    return re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_groups(docs, similarity=0.8):
    """{id: (smallest id reached, number of links)} from all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = collections.Counter()
    for group in holders.values():
        group.sort()
        for i, b in enumerate(group):
            for a in group[:i]:
                common[a, b] += 1
    up, links = {d: d for d in sets}, collections.Counter()

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in sets}


def removed_bytes(docs, length):
    """{id: (bytes, removed, runs, sha256 of the rest)} by looking every string up."""
    data = {d: (t or "").encode() for d, t in docs}
    seen = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, y in zip(b, gone) if not y)
        runs = len(bytes(gone).replace(b"\0", b" ").split())
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def personal_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out
