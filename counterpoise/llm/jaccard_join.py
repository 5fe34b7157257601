"""N-gram Jaccard join: MinHash banding, then exact Jaccard on the full n-gram sets.

Documents with the same n-gram set form a class and one of them stands for it.  Classes that
agree on a band meet in a bucket.  Buckets become tiles: a small bucket is one tile; a large
one is dealt to chunks and each pair of chunks is a tile, so no task holds a large group and
no pair of a group is ever a row.  A tile compares its members' full sets and returns per
member the number of documents it is linked to, plus enough links to connect it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize
from .frames import without_ids
from .graph import components
from .wordhash import mixed, shingles, slices, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
CHUNK_SHINGLES = 1 << 17
CHUNK_MEMBERS = 1 << 12
STRIPE_CELLS = 1 << 22
LIGHT = 32
TILE_BYTES = 8 << 20


def band_plan(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows) so that a pair of just this similarity meets in some band with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """(``_doc``, ``_n``, ``_set1``, ``_set2``, ``_bands``): set size, 128-bit name of the set, hash per band."""
    draws = np.random.default_rng(seed).integers(1, 2**63, size=(bands * rows, 2), dtype=np.uint64)
    factors, shifts = draws[:, 0] | np.uint64(1), draws[:, 1]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in slices(texts):
                values, doc = shingle_sets(texts[lo:hi], words)
                some = np.unique(doc)
                if not len(some):
                    continue
                starts = np.searchsorted(doc, some)
                low = np.empty((len(some), bands * rows), np.uint64)
                for j in range(bands * rows):
                    low[:, j] = np.minimum.reduceat(mixed_cheap(values, factors[j], shifts[j]), starts)
                keys = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    keys = mixed(keys * np.uint64(0x100000001B3) + low.reshape(len(some), bands, rows)[:, :, r])
                yield pd.DataFrame({
                    "_doc": batch["doc"].to_numpy()[lo:hi][some],
                    "_n": np.diff(np.append(starts, len(values))),
                    "_set1": np.add.reduceat(mixed(values), starts).view(np.int64),
                    "_set2": np.add.reduceat(mixed(values ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64),
                    "_bands": list(keys.view(np.int64)),
                })

    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return given.mapInPandas(sign, "_doc long, _n long, _set1 long, _set2 long, _bands array<long>")


def shingle_sets(texts: list, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text number) without repeats, by text and then by shingle."""
    parts, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(texts):
        hashes, first, *_ = word_hashes(texts[lo:hi])
        values, at = shingles(hashes, first, words)
        doc = np.repeat(np.arange(lo, hi), np.diff(at))
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        parts.append(values[fresh])
        owners.append(doc[fresh])
    return np.concatenate(parts), np.concatenate(owners)


def mixed_cheap(values: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    """One random order of already mixed values."""
    x = values * factor + shift
    return x ^ (x >> np.uint64(32))


class Common:
    """Numbers of shared shingles between the two sides of a tile, a stripe of the left side at a time.

    A shingle that few members hold adds its pairs one by one, which is at most ``LIGHT`` times
    the entries of the tile; the others are columns of 0/1 matrices and add up as products.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, column: np.ndarray, owner: np.ndarray):
        seat_l, seat_r = (np.full(int(max(left.max(), right.max(), owner.max(initial=0))) + 1, -1) for _ in range(2))
        seat_l[left], seat_r[right] = np.arange(len(left)), np.arange(len(right))
        self.width = len(right)
        sides = []
        for seat in (seat_l, seat_r):
            mine = seat[owner] >= 0
            sides.append((column[mine], seat[owner[mine]]))
        (col_l, row_l), (col_r, row_r) = sides
        degree = np.bincount(col_r, minlength=int(column.max(initial=-1)) + 1)
        start = np.concatenate(([0], np.cumsum(degree)))
        # entries of the left side by row, so that a stripe is a range of them
        order = np.argsort(row_l, kind="stable")
        col_l, row_l = col_l[order], row_l[order]
        light = degree[col_l] <= LIGHT
        self.light = row_l[light], start[col_l[light]], degree[col_l[light]]
        self.held = row_r
        heavy = np.flatnonzero(degree > LIGHT)
        name = np.full(len(degree), -1)
        name[heavy] = np.arange(len(heavy))
        self.heavy = row_l[~light], name[col_l[~light]]
        of_right = name[col_r] >= 0
        # right entries of heavy columns, by column
        self.right = name[col_r[of_right]], row_r[of_right]
        self.columns = len(heavy)

    def stripe(self, lo: int, hi: int) -> np.ndarray:
        """Shared shingles of left members ``lo`` to ``hi`` with every right member."""
        rows, start, many = self.light
        a, b = np.searchsorted(rows, (lo, hi))
        many = many[a:b]
        ahead = np.cumsum(many) - many
        at = np.arange(int(many.sum())) + np.repeat(start[a:b] - ahead, many)
        cells = np.repeat(rows[a:b] - lo, many) * self.width + self.held[at]
        common = np.bincount(cells, minlength=(hi - lo) * self.width).astype(np.float32).reshape(hi - lo, self.width)
        rows, names = self.heavy
        a, b = np.searchsorted(rows, (lo, hi))
        rows, names = rows[a:b] - lo, names[a:b]
        step = max(1, STRIPE_CELLS // max(self.width, hi - lo))
        for first in range(0, self.columns, step):
            mine = (names >= first) & (names < first + step)
            if not mine.any():
                continue
            c, d = np.searchsorted(self.right[0], (first, first + step))
            ours = np.zeros((hi - lo, min(step, self.columns - first)), np.float32)
            theirs = np.zeros((self.width, ours.shape[1]), np.float32)
            ours[rows[mine], names[mine] - first] = 1
            theirs[self.right[1][c:d], self.right[0][c:d] - first] = 1
            common += ours @ theirs.T
        return common


def merge_roots(root: np.ndarray, member: int, others: np.ndarray) -> None:
    """Gives ``member``, ``others`` and all that share a root with them the smallest of their roots."""
    met = root[others]
    if (met == root[member]).all():
        return
    met = np.unique(np.append(met, root[member]))
    root[np.isin(root, met)] = met[0]


def tile_links(words: int, similarity: float):
    """Compares the members of each tile; rows arrive grouped by tile, tiles may span batches."""
    share = similarity / (1 + similarity)

    def links_of(tile: pd.DataFrame) -> pd.DataFrame:
        docs, sizes = tile["_doc"].to_numpy(), tile["_size"].to_numpy()
        keys = np.array(tile["_bands"].tolist(), np.int64)
        band, one, other = (int(tile[c].iloc[0]) for c in ("_band", "_ci", "_cj"))
        value, owner = shingle_sets(tile["_text"].tolist(), words)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        n = np.bincount(owner, minlength=len(docs))
        chunk = tile["_chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == other)
        links, root = np.zeros(len(docs), np.int64), np.arange(len(docs))
        if not len(left) or not len(right):
            return pd.DataFrame({"_doc": docs[:0], "_links": links[:0], "_root": docs[:0]})
        # values found once in the tile are in no intersection
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column, minlength=1)[column] > 1 if len(value) else np.zeros(0, bool)
        common = Common(left, right, column[shared], owner[shared])
        height = max(1, STRIPE_CELLS // len(right))
        for lo in range(0, len(left), height):
            some = left[lo : lo + height]
            both = common.stripe(lo, lo + len(some))
            # J >= s is the same as common >= s / (1 + s) * (sum of the sizes); the right side is in doubles
            linked = both >= share * (n[some][:, None] + n[right][None, :]) - 1e-6
            if one == other:
                linked &= docs[some][:, None] < docs[right][None, :]
            # a pair counts in the first band on which it agrees, and only there
            for b in range(band if linked.any() else 0):
                linked &= keys[some, b][:, None] != keys[right, b][None, :]
            links[some] += linked @ sizes[right]
            links[right] += sizes[some] @ linked
            for i in np.flatnonzero(linked.any(axis=1)):
                merge_roots(root, some[i], right[linked[i]])
        kept = links > 0
        # roots are places in the tile; a group goes by its smallest document
        low = np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(low, root, docs)
        return pd.DataFrame({"_doc": docs[kept], "_links": links[kept], "_root": low[root[kept]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = ["_band", "_hash", "_ci", "_cj"], []
        for batch in batches:
            if not len(batch):
                continue
            groups = [g for _, g in batch.groupby(key, sort=False)]
            for g in groups:
                if held and (held[0][key].iloc[0] != g[key].iloc[0]).any():
                    yield links_of(pd.concat(held, ignore_index=True))
                    held = []
                held.append(g)
        if held:
            yield links_of(pd.concat(held, ignore_index=True))

    return run


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    chunk_shingles: int = CHUNK_SHINGLES,
    chunk_members: int = CHUNK_MEMBERS,
) -> DataFrame:
    """One row per id: ``class_id`` (its connected group), ``copy_id`` (its set class), ``n_links``.

    ``n_links`` counts the other documents of Jaccard similarity ``similarity`` or more on sets of
    ``words``-word shingles; ``class_id`` is the smallest id that links reach.  Texts with fewer
    words are one shingle of all their words; null, empty and wordless texts have no shingle,
    no link and are alone.  Rows with a null id are left out; ids must be unique and integer.
    Pairs at the threshold are found with probability ``recall``, more similar ones more often;
    what is found is exact.  Ties and repeated texts link to each other.
    """
    bands, rows = band_plan(similarity, recall)
    signed = materialize(signatures(docs, id_col, text_col, words, bands, rows), "signatures")
    classes = signed.groupBy("_set1", "_set2").agg(
        F.min("_doc").alias("_rep"), F.count(F.lit(1)).alias("_size"),
        F.first("_bands").alias("_bands"), F.first("_n").alias("_n"),
    )
    classes = materialize(classes, "classes")

    seats = classes.select("_rep", "_n", F.posexplode("_bands").alias("_band", "_hash"))
    buckets = seats.groupBy("_band", "_hash").agg(
        F.count(F.lit(1)).alias("_held"), F.sum(F.xxhash64("_rep").cast("decimal(38,0)")).alias("_who"),
        F.sum("_n").alias("_total"),
    ).where(F.col("_held") > 1)
    # buckets of the same members are compared once, in their first band
    buckets = buckets.groupBy("_who", "_held", "_total").agg(F.min(F.struct("_band", "_hash")).alias("_b"))
    # chunks are bounded by what they hold and, for short texts, by their members
    chunks = F.greatest(F.ceil(F.col("_total") / chunk_shingles), F.ceil(F.col("_held") / chunk_members))
    chunks = F.least(chunks, F.col("_held"))
    buckets = materialize(buckets.select("_b._band", "_b._hash", chunks.alias("_chunks")), "buckets")
    seated = seats.drop("_n").join(buckets, ["_band", "_hash"])
    own = F.pmod(F.xxhash64("_rep", "_band"), F.col("_chunks"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1), lambda c: F.struct(
        F.least(c, F.col("_chunk")).alias("_ci"), F.greatest(c, F.col("_chunk")).alias("_cj")
    ))
    seated = seated.withColumn("_chunk", own).select("_rep", "_band", "_hash", "_chunk", F.inline(tiles))
    known = classes.select("_rep", "_size", "_bands").join(seated, "_rep")
    texts = docs.select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).alias("_text"))
    full = known.join(texts, "_rep").withColumnRenamed("_rep", "_doc")
    parts = tile_partitions(seated.join(classes.select("_rep", "_n"), "_rep"))
    dealt = full.repartition(parts, "_band", "_hash", "_ci", "_cj").sortWithinPartitions("_band", "_hash", "_ci", "_cj")
    found = dealt.mapInPandas(tile_links(words, similarity), "_doc long, _links long, _root long")
    found = materialize(found, "links")

    joined = components(found.select(F.col("_doc").alias("a"), F.col("_root").alias("b")))
    linked = found.groupBy(F.col("_doc").alias("_rep")).agg(F.sum("_links").alias("_links"))
    members = signed.select("_doc", "_set1", "_set2").join(classes.select("_set1", "_set2", "_rep", "_size"), ["_set1", "_set2"])
    named = members.join(linked, "_rep", "left").join(joined.withColumnRenamed("node", "_rep"), "_rep", "left").select(
        "_doc", F.coalesce("component", "_rep").alias("class_id"), F.col("_rep").alias("copy_id"),
        (F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("n_links"),
    )
    every = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"))
    out = every.join(named, every["_id"] == named["_doc"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce("copy_id", "_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    discard(buckets)
    return out


def tile_partitions(tiles: DataFrame) -> int:
    """Tasks for the tiles: as many as keep a task near ``TILE_BYTES`` of text, two waves at least."""
    total = 7 * (tiles.agg(F.sum("_n")).first()[0] or 0)
    return max(2 * tiles.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TILE_BYTES))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents without near copies: of each group of linked documents the smallest id stays.

    Documents with a null id or without words stay.
    """
    groups = jaccard_join(docs, id_col, text_col, **options)
    return without_ids(docs, id_col, groups.where(F.col(id_col) != F.col("class_id")), id_col)
