"""Prequential AUC over an ordered table, as a scan over parts of bounded size.

Each score is compared with the retained scores of the other class before it, and the running mean of
its class moves towards the share it beats.  Both steps compose: what a part of the rows leaves in the
retained slots is the last write to each slot, and what it does to a mean is an affine map.
So a group of any size is cut into parts; parts are summed up apart, the slots are carried over their
borders, and the maps are chained.  One row per group and part meets in the task that chains.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.draw import u_value
from ..session import materialize
from .prefix import ordered_chunks

HISTORY = 10
BLOCK = 65_536
STATE = "slots0 array<double>, slots1 array<double>, a0 double, a1 double, n0 long, n1 long"


def slot(policy: str, n: int, history: int, key: str, cls: int) -> int:
    """Place that score number ``n`` of a class takes among the retained ones, -1 for none.

    ``policy`` tells which score a new one replaces: the oldest ('fifo'), one of a fair reservoir
    ('fair'), or any ('random').
    """
    if n < history or policy == "fifo":
        return n % history
    place = int(u_value("auc", key, cls, n) * (n + 1 if policy == "fair" else history))
    return place if place < history else -1


class _Part:
    """Rows of one group inside one part, in order."""

    def __init__(self, cls: np.ndarray, score: np.ndarray, before: tuple[int, int], policy: str, history: int, key: str):
        self.cls, self.score, self.before, self.history = cls, score, before, history
        self.scores = [score[cls == c] for c in (0, 1)]
        if policy == "fifo":
            self.places = [(b + np.arange(len(s))) % history for b, s in zip(before, self.scores)]
        else:
            self.places = [np.array([slot(policy, b + i, history, key, c) for i in range(len(s))], np.int64) for c, (b, s) in enumerate(zip(before, self.scores))]

    def writes(self) -> list[np.ndarray]:
        """Last score written to each slot of each class, NaN for none."""
        out = []
        for place, score in zip(self.places, self.scores):
            slots = np.full(self.history, np.nan)
            slots[place[place >= 0]] = score[place >= 0]
            out.append(slots)
        return out

    def maps(self, carried: list[np.ndarray], window_size: int | None) -> list[tuple[float, float]]:
        """(factor, addend) that the part applies to the mean of each class."""
        out = []
        for c in (0, 1):
            mine, place, other = self.scores[c], self.places[1 - c], self.scores[1 - c]
            last = np.full((len(other) + 1, self.history), -1, np.int64)
            at = np.flatnonzero(place >= 0)
            last[at + 1, place[at]] = at
            last = np.maximum.accumulate(last, axis=0)
            held = np.where(last >= 0, other[np.maximum(last, 0)] if len(other) else np.nan, carried[1 - c])
            met = held[np.cumsum(self.cls != c)[self.cls == c]]
            known = (~np.isnan(met)).sum(axis=1)
            won = (mine[:, None] > met).sum(axis=1) + 0.5 * (mine[:, None] == met).sum(axis=1)
            span = self.before[c] + 1.0 + np.arange(len(mine))
            span = span if window_size is None else np.minimum(span, window_size)
            step = np.where(known > 0, 1 / span, 0.0)
            later = np.append(np.cumprod((1 - step)[::-1])[::-1][1:], 1.0)
            factor = float(np.prod(1 - step))
            out.append((factor, float((won / np.maximum(known, 1) * step * later).sum())))
        return out


def advance(
    df: DataFrame, order: list[str], cls: str, score: str, group: list[str] | None = None, history: int = HISTORY,
    window_size: int | None = None, policy: str = "fifo", state: DataFrame | None = None,
) -> DataFrame:
    """State (group, slots0, slots1, a0, a1, n0, n1) of every group after its rows, from ``state`` or from nothing.

    ``order`` must be unique inside a group.  Groups without new rows keep their state; a missing
    group value is a group of its own.  Rows without a class or score are left out.
    """
    group = group or []
    name = F.to_json(F.struct(*[F.col(g) for g in group]), {"ignoreNullFields": "false"}) if group else F.lit("")
    key = F.concat_ws("|", *[F.col(g).cast("string") for g in group]) if group else F.lit("")
    rows = df.select(
        *group, *order, F.col(cls).cast("int").alias("_cls"), F.col(score).cast("double").alias("_score"), name.alias("_g"), key.alias("_k")
    ).where(F.col("_cls").isNotNull() & F.col("_score").isNotNull())
    part = F.col("_chunk").cast("long") * (1 << 20) + F.floor((F.col("_pos") % (1 << 33)) / BLOCK)
    rows = ordered_chunks(rows, "_g", *order).withColumn("_part", part)
    old = None
    if state is not None:
        old = state.select(name.alias("_g"), *[F.col(c) for c in ("slots0", "slots1", "a0", "a1", "n0", "n1")])

    sizes = rows.groupBy("_g", "_part").agg(*[F.count_if(F.col("_cls") == c).alias(f"_c{c}") for c in (0, 1)])
    ahead = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_g", "_part", *[F.coalesce(F.sum(f"_c{c}").over(ahead), F.lit(0)).alias(f"_b{c}") for c in (0, 1)])
    if old is not None:
        before = before.join(old.select("_g", "n0", "n1"), "_g", "left").select(
            "_g", "_part", *[(F.col(f"_b{c}") + F.coalesce(f"n{c}", F.lit(0))).alias(f"_b{c}") for c in (0, 1)])
    before = materialize(before, "counts-before")
    kept = rows.select("_part", "_pos", "_g", "_k", "_cls", "_score")

    def parts_of(data: pd.DataFrame, extra: pd.DataFrame) -> Iterator[tuple[Any, _Part]]:
        data = data.sort_values("_pos")
        numbers = {r["_g"]: r for r in extra.to_dict("records")}
        for g, mine in data.groupby("_g", sort=False):
            r = numbers[g]
            yield r, _Part(mine["_cls"].to_numpy(), mine["_score"].to_numpy(), (int(r["_b0"]), int(r["_b1"])), policy, history, mine["_k"].iloc[0])

    def summarise(data: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        found = [(r["_g"], int(r["_part"]), *p.writes()) for r, p in parts_of(data, extra)]
        return pd.DataFrame(found, columns=["_g", "_part", "w0", "w1"])

    def carry(name: tuple[Any, ...], parts: pd.DataFrame) -> pd.DataFrame:
        held, out = [np.full(history, np.nan), np.full(history, np.nan)], []
        for r in parts.sort_values("_part").itertuples(index=False):
            writes = [np.array(w, dtype=float) for w in (r[2], r[3])]
            if r[1] >= 0:
                out.append((r[0], r[1], held[0], held[1]))
            held = [np.where(np.isnan(w), h, w) for w, h in zip(writes, held)]
        out.append((name[0], np.iinfo(np.int64).max, held[0], held[1]))
        return pd.DataFrame(out, columns=["_g", "_part", "w0", "w1"])

    def apply(data: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r, p in parts_of(data, extra):
            maps = p.maps([np.array(r["w0"], dtype=float), np.array(r["w1"], dtype=float)], window_size)
            found.append((r["_g"], int(r["_part"]), *maps[0], *maps[1], len(p.scores[0]), len(p.scores[1])))
        return pd.DataFrame(found, columns=["_g", "_part", "f0", "s0", "f1", "s1", "c0", "c1"])

    def chain(name: tuple[Any, ...], parts: pd.DataFrame) -> pd.DataFrame:
        means, counts = [0.5, 0.5], [0, 0]
        for r in parts.sort_values("_part").itertuples(index=False):
            means = [means[0] * r.f0 + r.s0, means[1] * r.f1 + r.s1]
            counts = [counts[0] + r.c0, counts[1] + r.c1]
        return pd.DataFrame([(name[0], *means, *counts)], columns=["_g", "a0", "a1", "n0", "n1"])

    slots = "_g string, _part long, w0 array<double>, w1 array<double>"
    written = kept.groupBy("_part").cogroup(before.groupBy("_part")).applyInPandas(summarise, slots)
    steps = "_g string, _part long, f0 double, s0 double, f1 double, s1 double, c0 long, c1 long"
    if old is not None:
        none = F.lit(-1).cast("long").alias("_part")
        written = written.union(old.select("_g", none, "slots0", "slots1"))
    carried = materialize(written.groupBy("_g").applyInPandas(carry, slots), "carried")
    asked = before.join(carried, ["_g", "_part"])
    moved = kept.groupBy("_part").cogroup(asked.groupBy("_part")).applyInPandas(apply, steps)
    if old is not None:
        moved = moved.union(old.select("_g", none, F.lit(0.0), "a0", F.lit(0.0), "a1", "n0", "n1"))
    ended = carried.where(F.col("_part") == (1 << 63) - 1).select("_g", F.col("w0").alias("slots0"), F.col("w1").alias("slots1"))
    final = ended.join(moved.groupBy("_g").applyInPandas(chain, "_g string, a0 double, a1 double, n0 long, n1 long"), "_g")
    columns = ["slots0", "slots1", "a0", "a1", "n0", "n1"]
    if not group:
        return final.select(*columns)
    groups = rows.select("_g", *group)
    if state is not None:
        groups = groups.union(state.select(name.alias("_g"), *group))
    return final.join(groups.dropDuplicates(["_g"]), "_g").select(*group, *columns)


def group_auc(
    df: DataFrame, order: list[str], cls: str, score: str, group: list[str] | None = None,
    history: int = HISTORY, window_size: int | None = None, policy: str = "fifo",
) -> DataFrame:
    """AUC per group: (group, a0, a1, n0, n1, auc); a missing group value is a group of its own."""
    found = advance(df, order, cls, score, group, history, window_size, policy)
    return found.drop("slots0", "slots1").withColumn("auc", (1 - F.col("a0") + F.col("a1")) / 2)


def online_auc(df: DataFrame, order: list[str], cls: str, score: str, **options) -> DataFrame:
    return group_auc(df, order, cls, score, **options)


def grouped_auc(df: DataFrame, order: list[str], cls: str, score: str, group: list[str], **options) -> DataFrame:
    """One row: mean of the groups' AUC."""
    per_group = group_auc(df, order, cls, score, group, **options)
    return per_group.agg(F.avg("auc").alias("auc"), F.count(F.lit(1)).alias("groups"))
