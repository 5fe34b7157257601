"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors are dealt to shards.  In a shard every component is a term whose postings are cut
into segments of like values; a segment's impact for a query is the most that its values can
add to an inner product.  Segments are processed by descending impact.  What a vector may
still gain is bounded by the impact of the next segment, so after a round the k-th best lower
bound proves which vectors can be members at all.  Only then does the search stop, and these
vectors are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

LEVELS = 64
SHARD_ROWS = 16_384
BLOCK_QUERIES = 512
ROUNDS = (0.6, 0.85, 0.95, 1.0)
FEW = 128


def finite_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(``_id``, ``_x``): components as floor(scale * x); vectors with a null or non-finite component left out."""
    whole = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return vectors.where(whole).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("_x"),
    )


def pack(rows: pd.DataFrame) -> tuple[bytes, bytes, int]:
    """Ids and components, ordered by id."""
    rows = rows.sort_values("_id")
    return rows["_id"].to_numpy(np.int64).tobytes(), np.array(rows["_x"].tolist(), np.int64).tobytes(), len(rows)


def build_shard(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """Index of one shard: vectors, and per component postings by value with the limits of each level."""
    ids, flat, n = pack(rows)
    x = np.frombuffer(flat, np.int64).reshape(n, -1)
    order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
    values = np.take_along_axis(x, order, axis=0)
    low, span = values[:1], np.maximum(values[-1:] - values[:1], 1)
    level = np.minimum((values - low) * LEVELS // span, LEVELS - 1)
    starts = np.stack([np.searchsorted(level[:, j], np.arange(LEVELS)) for j in range(x.shape[1])])
    return pd.DataFrame({
        "shard": [key[0]], "dims": [x.shape[1]], "ids": [ids], "vectors": [flat],
        "postings": [np.ascontiguousarray(order.T).tobytes()], "starts": [starts.astype(np.int32).tobytes()],
    })


SHARD_SCHEMA = "shard long, dims int, ids binary, vectors binary, postings binary, starts binary"


class Shard:
    """One shard in memory."""

    def __init__(self, ids: bytes, vectors: bytes, postings: bytes, starts: bytes, dims: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.n, self.dims = len(self.ids), dims
        self.x = np.frombuffer(vectors, np.int64).reshape(self.n, dims)
        self.postings = np.frombuffer(postings, np.int32).reshape(dims, self.n)
        self.edges = np.concatenate((np.frombuffer(starts, np.int32).reshape(dims, LEVELS), np.full((dims, 1), self.n, np.int32)), axis=1)
        values = np.take_along_axis(self.x.T, self.postings.astype(np.int64), axis=1)
        rows = np.arange(dims)[:, None]
        self.low = values[rows, np.minimum(self.edges[:, :-1], self.n - 1)].astype(float)
        self.high = values[rows, np.maximum(self.edges[:, 1:] - 1, 0)].astype(float)
        counts = np.diff(self.edges, axis=1)
        self.counts = counts
        # what each posting adds at most for positive and for negative query components
        self.upper = [np.repeat(h, c) for h, c in zip(self.high, counts)]
        self.lower = [np.repeat(l, c) for l, c in zip(self.low, counts)]

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best of this shard, and how many postings were processed."""
        up = q >= 0
        most = np.where(up[:, None], q[:, None] * self.high, q[:, None] * self.low)
        least = np.where(up[:, None], q[:, None] * self.low, q[:, None] * self.high)
        held = self.counts > 0
        slack = float(np.where(held, most - least, 0).max(axis=1).sum())
        floor = float(np.where(held, least, np.inf).min())
        impacts, sizes = most[held], self.counts[held]
        by_impact = np.argsort(-impacts, kind="stable")
        reached = np.cumsum(sizes[by_impact])
        total, seen = np.zeros(self.n), np.zeros(self.n, np.int64)
        own = np.flatnonzero(self.ids == query_id)
        done = np.where(up, self.n, 0)
        processed = 0
        for part in ROUNDS:
            last = int(np.searchsorted(reached, part * reached[-1]))
            limit = impacts[by_impact[min(last, len(by_impact) - 1)]] if part < 1 else -np.inf
            # impacts fall along a component's levels, so a round is one stretch of its postings
            inside = ((most >= limit) & held).astype(np.int8)
            where, weights = [], []
            for j in range(self.dims):
                levels = np.flatnonzero(inside[j])
                if not len(levels):
                    continue
                a, b = (self.edges[j, levels[0]], done[j]) if up[j] else (done[j], self.edges[j, levels[-1] + 1])
                if a < b:
                    where.append(self.postings[j, a:b])
                    weights.append(q[j] * (self.upper if up[j] else self.lower)[j][a:b])
                    done[j] = a if up[j] else b
            if where:
                places = np.concatenate(where)
                processed += len(places)
                total += np.bincount(places, np.concatenate(weights), self.n)
                seen += np.bincount(places, minlength=self.n)
            missing = self.dims - seen
            ahead = impacts[impacts < limit].max(initial=floor) if part < 1 else 0.0
            best = total - slack + missing * min(floor, 0.0)
            worst = total + missing * ahead
            best[own], worst[own] = -np.inf, -np.inf
            mark = np.partition(best, -k)[-k] if self.n > k else -np.inf
            possible = np.flatnonzero((worst >= mark) & (worst > -np.inf))
            if len(possible) <= FEW:
                break
        exact = self.x[possible] @ q
        top = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][top], exact[top], processed


def search_tiles(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = Shard(row.ids, row.vectors, row.postings, row.starts, row.dims)
                queries = np.frombuffer(row.query_ids, np.int64)
                vectors = np.frombuffer(row.queries, np.int64).reshape(len(queries), -1)
                if vectors.shape[1] != shard.dims:
                    continue
                found = [shard.search(int(i), v, k) for i, v in zip(queries, vectors)]
                yield pd.DataFrame({
                    "query_id": np.repeat(queries, [len(f[0]) for f in found]),
                    "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found]),
                })

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product per query.

    A query never finds its own id; ties go to the smaller id; with fewer rows all are returned.
    Vectors that are null or hold null or non-finite components take no part; vectors of
    other lengths are indexed apart, and a query meets those of its own length.  Scores are exact
    while they fit 53 bits.  Shards hold about ``SHARD_ROWS`` rows and query blocks about
    ``BLOCK_QUERIES``; each block meets each shard in a task of its own.
    """
    given = materialize(finite_vectors(vectors.withColumn("_ask", is_query), id_col, vec_col, scale).withColumn("_dims", F.size("_x")), "vectors")
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("_id"))
    sizes = {r["_dims"]: r["n"] for r in given.groupBy("_dims").agg(F.count(F.lit(1)).alias("n")).where("_dims > 0").collect()}
    shards = max(1, math.ceil(max(sizes.values(), default=0) / SHARD_ROWS))
    spread = F.pmod(F.xxhash64(F.lit("shard"), "_id"), F.lit(shards))
    index = given.where(F.col("_dims") > 0).select("_id", "_x", (F.col("_dims") * shards + spread).alias("shard"))
    index = materialize(index.groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA), "impact-index")

    queries = given.where(F.col("_dims") > 0).join(asked, "_id", "left_semi")
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))

    def pack_block(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        ids, flat, _ = pack(rows)
        return pd.DataFrame({"qdims": [key[0]], "block": [key[1]], "query_ids": [ids], "queries": [flat]})

    block = F.pmod(F.xxhash64(F.lit("block"), "_id"), F.lit(blocks)).alias("_block")
    packed = queries.select("_id", "_x", "_dims", block).groupBy("_dims", "_block").applyInPandas(
        pack_block, "qdims int, block long, query_ids binary, queries binary"
    )
    tiles = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    paired = tiles.join(packed, (tiles["dims"] == packed["qdims"]) & (tiles["block"] == packed["block"]))
    paired = paired.drop("block").repartition(max(shards * blocks, 1))
    found = paired.mapInPandas(search_tiles(k), "query_id long, vec_id long, score long")
    ranked = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
