"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on.  Repeats of one symbol
become one symbol.  Deterministic coin tossing then shrinks symbols to labels: a label is the lowest
bit in which a symbol differs from the one before it, with its value; four rounds leave six labels.
A phrase begins where a label is smaller than both neighbours, so a cut depends on a few
symbols around it and equal substrings are cut alike except near their ends, whatever their offset.
A phrase's name is a hash of the names in it.  A fingerprint holds the smallest names of some levels.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .wordhash import mixed

LEVELS = 3
NAMES = 64
LEAST = 8
CHARS = 1 << 18
BUCKET_CHARS = 4 << 20
TASK_BUCKETS = 4
STEP = np.uint64(0x9E3779B97F4A7C15)

# of a byte: place of its lowest bit
LOW_BIT = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def toss(labels: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One round of coin tossing; the first symbol of a text has none before it and keeps its lowest bit."""
    differs = np.zeros_like(labels)
    differs[1:] = labels[1:] ^ labels[:-1]
    differs[begins] = 0
    if labels.dtype == np.uint8:
        place = LOW_BIT[differs]
    else:
        one = labels.dtype.type(1)
        place = np.where(differs == 0, 0, np.bitwise_count((differs & (~differs + one)) - one)).astype(np.uint8)
    bit = ((labels >> place.astype(labels.dtype)) & labels.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | bit


def parse(symbols: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names, and owners, of one level over texts laid end to end."""
    n = len(symbols)
    begins = np.concatenate(([True], owners[1:] != owners[:-1]))
    # repeats first, so that neighbours differ
    at = np.flatnonzero(begins | np.concatenate(([True], symbols[1:] != symbols[:-1])))
    size = np.diff(np.append(at, n))
    symbols, owners, begins = symbols[at], owners[at], begins[at]
    many = np.flatnonzero(size > 1)
    if len(many):
        symbols = symbols.astype(np.uint64)
        symbols[many] = mixed(symbols[many] + size[many].astype(np.uint64) * STEP)
    labels = symbols
    for _ in range(4):
        labels = toss(labels, begins)
    n = len(symbols)
    cut = begins.copy()
    inner = np.flatnonzero(~begins[1:-1] & ~begins[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
    cut[inner] |= (labels[inner] < labels[inner - 1]) & (labels[inner] < labels[inner + 1])
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    names = np.add.reduceat(mixed(symbols.astype(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * STEP), first)
    return mixed(names), owners[first]


def sketches(texts: list[str], levels: int = LEVELS, names: int = NAMES, least: int = LEAST) -> list[dict[int, np.ndarray]]:
    """Per text the smallest phrase names of each level kept, as sorted 32-bit numbers.

    A level is kept if it has ``least`` phrases or is the first; levels below one with twice
    as many are not.  An empty text has no level.
    """
    out: list[dict[int, np.ndarray]] = [{} for _ in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owners = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    found, counts = [], []
    for _ in range(levels):
        if len(symbols):
            symbols, owners = parse(symbols, owners)
        found.append((symbols, owners))
        counts.append(np.bincount(owners, minlength=len(texts)))
    enough = np.zeros(len(texts), bool)
    for level in range(levels - 1, -1, -1):
        symbols, owners = found[level]
        count = counts[level]
        kept = ~enough & ((count >= least) | ((level == 0) & (count > 0)))
        enough |= count >= 2 * least
        here = kept[owners]
        key = (owners[here].astype(np.uint64) << np.uint64(32)) | (symbols[here] >> np.uint64(32))
        key = np.unique(key)
        owner, value = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in np.flatnonzero(kept):
            out[i][level + 1] = value[edges[i] : min(edges[i] + names, edges[i + 1])]
    return out


def spelled(sketch: dict[int, np.ndarray]) -> str:
    """``level:names`` joined by commas, each name as eight hexadecimal digits."""
    return ",".join(f"{level}:{sketch[level].astype('>u4').tobytes().hex()}" for level in sorted(sketch))


def read(fingerprint: str) -> dict[int, np.ndarray]:
    parts = [p.split(":") for p in fingerprint.split(",")] if fingerprint else []
    return {int(level): np.frombuffer(bytes.fromhex(names), ">u4").astype(np.uint32) for level, names in parts}


def alike(a: dict[int, np.ndarray], b: dict[int, np.ndarray], names: int = NAMES) -> float:
    """Estimated share of common phrases, of all phrases of two texts, at the highest level both keep.

    1 for two empty texts; 0 without a common level.  Exact below ``names`` phrases a text.
    """
    if not a or not b:
        return float(a.keys() == b.keys())
    level = max(a.keys() & b.keys(), default=None)
    if level is None:
        return 0.0
    x, y = a[level], b[level]
    limit = min(v[-1] if len(v) == names else np.uint32(0xFFFFFFFF) for v in (x, y))
    x, y = x[x <= limit], y[y <= limit]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def likeness(a: Column, b: Column) -> Column:
    """Likeness, 0 to 1, of two fingerprint columns; null if one is null."""
    @pandas_udf("double")
    def compare(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else alike(read(x), read(y)) for x, y in zip(left, right)], dtype="float64")

    return compare(a, b)


def grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` code points."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``n_chars``, ``fingerprint``) of every row, in place.

    Null texts count as empty, and an empty text has an empty fingerprint.  Equal texts have equal
    fingerprints.  A task parses about ``CHARS`` code points at once, or one longer text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for lo, hi in grouped(texts):
                part = texts[lo:hi]
                yield pd.DataFrame({"id": batch["id"].iloc[lo:hi], "n_chars": [len(t) for t in part], "fingerprint": [spelled(s) for s in sketches(part)]})

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInPandas(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, border, doc, data): compressed texts of (doc, text), buckets of falling ids, rows sorted.

    Each bucket ends with a border row, the first document of the bucket after it (of the first
    bucket after the last).  Bucket limits are quantiles of the ids; each text is shuffled
    once, and the first one of a bucket twice.
    """
    shares = [i / buckets for i in range(1, buckets)]
    limits = docs.agg(F.percentile_approx("doc", F.array(*map(F.lit, shares)), 100 * buckets)).first()[0] if shares else []
    falling = np.array(sorted({-x for x in limits or []}), np.int64)

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = np.searchsorted(falling, -batch["doc"].to_numpy(np.int64), side="right")
            top = batch["doc"].groupby(place).max()
            yield pd.DataFrame({"place": top.index, "top": top.to_numpy()})

    found = docs.select("doc").mapInPandas(highest, "place long, top long").groupBy("place").agg(F.max("top").alias("top"))
    tops = sorted((r["top"] for r in found.collect()), reverse=True)
    before = {top: tops[i - 1] for i, top in enumerate(tops)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = -np.array(tops, np.int64)
        for batch in batches:
            doc = batch["doc"].to_numpy(np.int64)
            data = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch["text"]]
            yield pd.DataFrame({"bucket": -starts[np.searchsorted(starts, -doc, side="right") - 1], "border": False, "doc": doc, "data": data})
            extra = [i for i, d in enumerate(doc) if d in before]
            if extra:
                yield pd.DataFrame({
                    "bucket": [before[doc[i]] for i in extra], "border": True, "doc": doc[extra], "data": [data[i] for i in extra]})

    packed = docs.mapInPandas(run, "bucket long, border boolean, doc long, data binary")
    return packed.repartition(-(-buckets // TASK_BUCKETS), "bucket").sortWithinPartitions("bucket", "border", F.col("doc").desc(), "data")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of an edited form of it, and how alike they are.

    The edited text has its last third, rounded down, replaced by as many first code points (or
    all) of the next document by descending id; after the last comes the first.  Returns
    (``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``).  Null texts count as empty; rows with a null id are left out,
    and rows of one id follow each other in the order of their compressed texts.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    total = given.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(max(1, -(-total // BUCKET_CHARS)), 1 << 16)

    def compared(docs_: list[int], texts: list[str]) -> pd.DataFrame:
        """Rows of all documents but the last, which is next to the one before it."""
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
        both = sketches(texts + edited)
        own, new = both[: len(texts)], both[len(texts) :]
        return pd.DataFrame({
            "doc": docs_[:-1], "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "fingerprint": [spelled(s) for s in own[:-1]], "edited_fingerprint": [spelled(s) for s in new],
            "near_edited": [alike(a, b) for a, b in zip(own, new)], "near_next": [alike(a, b) for a, b in zip(own, own[1:])],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        texts: list[str] = []
        held, bucket, closed = 0, None, False
        for batch in batches:
            for b, border, doc, data in zip(batch["bucket"], batch["border"], batch["doc"], batch["data"]):
                if b != bucket:
                    ids, texts, held, bucket, closed = [], [], 0, b, False
                if closed:
                    continue
                text, closed = zlib.decompress(data).decode("utf-8", "surrogatepass"), border
                ids.append(doc)
                texts.append(text)
                held += len(text)
                if len(ids) > 1 and (border or held >= CHARS):
                    yield compared(ids, texts)
                    ids, texts, held = [doc], [text], len(text)

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(given, buckets).mapInPandas(run, schema).withColumnRenamed("doc", id_col)
