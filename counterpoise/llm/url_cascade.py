"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys.  Over the complete key universe of the corpus it also accepts
some keys that are not listed; level 2 encodes these.  Level 2 wrongly accepts some listed
keys, which level 3 encodes, and so on until a level errs nowhere.  A key of the universe is
listed if the first level that rejects it is an even one, so membership is exact, needs no
join, and a level has a few bits for each key it encodes.

Keys are dealt to shards by hash.  A shard's levels are built in one task from the listed keys
of the shard and the false positives of the level before, so no task holds the whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import discard, materialize
from .frames import packed, unpacked

SHARD_KEYS = 1 << 16
MAX_BROADCAST = 64 << 20
FIRST_BITS = 12.0
NEXT_BITS = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Cascade:
    """Levels of every shard: ``table`` holds (shard, level, hashes, bits as bytes)."""

    table: DataFrame
    shards: int
    size: int

    def levels(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """All levels in memory; refused above ``MAX_BROADCAST`` bytes, see ``listed``."""
        if self.size > MAX_BROADCAST:
            raise ValueError(f"cascade of {self.size} bytes; look keys up by shard")
        found: dict[int, list] = {}
        for row in self.table.orderBy("shard", "level").collect():
            found.setdefault(row["shard"], []).append((row["hashes"], np.frombuffer(row["bits"], np.uint8)))
        return found


def places(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys in one level, by double hashing."""
    a = (h1 ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    step = ((h2 + np.uint64(level)) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    for i in range(hashes):
        x = a + step * np.uint64(i)
        yield (x ^ (x >> np.uint64(29))) % np.uint64(size)


def accepted(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for place in places(h1, h2, level, hashes, 8 * len(bits)):
        ok &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def verdicts(levels: list[tuple[int, np.ndarray]] | None, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Listed or not: walk down the levels until one rejects."""
    out = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for level, (hashes, bits) in enumerate(levels or [], start=1):
        ok = accepted(h1[open_], h2[open_], level, hashes, bits)
        out[open_[~ok]] = level % 2 == 0
        open_ = open_[ok]
    out[open_] = bool(levels) and len(levels) % 2 == 1
    return out


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("url"), key).alias("h2")]


def build_level(keys: DataFrame, level: int, bits_per_key: float) -> DataFrame:
    """One filter per shard from (shard, h1, h2)."""
    hashes = max(1, round(bits_per_key * 0.693))

    def build(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        size = max(64, int(len(rows) * bits_per_key) + 7 & ~7)
        bits = np.zeros(size, bool)
        for place in places(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64), level, hashes, size):
            bits[place.astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pd.DataFrame({"shard": [key[0]], "level": [level], "hashes": [hashes], "bits": [packed]})

    return keys.groupBy("shard").applyInPandas(build, "shard long, level int, hashes int, bits binary")


def wrongly_accepted(keys: DataFrame, level: DataFrame, number: int) -> DataFrame:
    """Keys of (shard, h1, h2) that a level accepts; the filters meet the keys of their shard."""

    def test(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(filters):
            return rows.iloc[:0]
        bits = np.frombuffer(filters["bits"].iloc[0], np.uint8)
        h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return rows[accepted(h1, h2, number, int(filters["hashes"].iloc[0]), bits)]

    return keys.groupBy("shard").cogroup(level.groupBy("shard")).applyInPandas(test, "shard long, h1 long, h2 long")


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key") -> Cascade:
    """Exact filter for the keys of ``universe`` (which may hold the listed ones and repeats).

    Null keys are left out.  An empty list gives a filter that rejects everything.
    """
    spark = listed.sparkSession
    names = listed.where(F.col(key).isNotNull()).select(*hashed(F.col(key))).distinct()
    n = names.count()
    # shards follow the larger side, so that neither the list nor the universe fills a task
    others = universe.where(F.col(key).isNotNull()).select(*hashed(F.col(key))).distinct()
    others = materialize(others.join(names, ["h1", "h2"], "left_anti"), "universe")
    shards = max(1, -(-max(n, others.count() // 16) // SHARD_KEYS))

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(F.pmod(F.col("h1"), F.lit(shards)).alias("shard"), "h1", "h2")

    inside, outside = materialize(dealt(names), "listed"), dealt(others)
    tables, level, bits = [], 1, FIRST_BITS
    while inside.limit(1).count():
        built = materialize(build_level(inside, level, bits), "level")
        tables.append(built)
        following = materialize(wrongly_accepted(outside, built, level), "errors")
        # what this level encoded is what the next one must not accept
        inside, outside = following, inside
        level, bits = level + 1, NEXT_BITS
    discard(others)
    table = tables[0] if tables else spark.createDataFrame([], "shard long, level int, hashes int, bits binary")
    for t in tables[1:]:
        table = table.union(t)
    size = table.agg(F.sum(F.length("bits"))).first()[0] or 0
    return Cascade(table, shards, size)


def listed(cascade: Cascade, key: Column) -> Column:
    """Boolean column: is the key, a member of the universe, listed?  Null keys are not.

    The levels travel to the tasks as a broadcast variable, at most ``MAX_BROADCAST`` bytes.
    """
    spark = SparkSession.active()
    held = spark.sparkContext.broadcast(cascade.levels())
    shards = cascade.shards

    @F.pandas_udf("boolean")
    def probe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        shard, out = a % shards, np.zeros(len(a), bool)
        for s in np.unique(shard):
            mine = shard == s
            out[mine] = verdicts(held.value.get(int(s)), a[mine].view(np.uint64), b[mine].view(np.uint64))
        return pd.Series(out)

    h1, h2 = hashed(key)
    return F.when(key.isNull(), F.lit(False)).otherwise(probe(h1, h2))


def listed_by_shard(cascade: Cascade, keys: DataFrame, key: str) -> DataFrame:
    """Distinct (``key``, ``listed``) of a universe for cascades too large to broadcast.

    Distinct keys meet their shard's filters in the shard's task.
    """
    shards = cascade.shards
    rows = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().select("key", *hashed(F.col("key")))
    rows = rows.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))

    def test(group: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        filters = filters.sort_values("level")
        levels = [(int(k), np.frombuffer(b, np.uint8)) for k, b in zip(filters["hashes"], filters["bits"])]
        h1, h2 = (group[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"key": group["key"], "listed": verdicts(levels, h1, h2)})

    found = rows.groupBy("shard").cogroup(cascade.table.groupBy("shard")).applyInPandas(test, "key string, listed boolean")
    return found.withColumnRenamed("key", key)


def rule_candidates(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Every key that a rule could have for this url, longest first.

    A rule fits a host and its subdomains, so its host is the url's last so many labels; its
    path is a prefix.  Only label counts and prefix lengths that rules use are tried.
    """
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    tried = []
    for n in labels:
        tail = F.substring_index(host, ".", -n)
        enough = F.size(F.split(host, r"\.", -1)) >= n
        for m in lengths:
            tried.append(F.when(enough & (F.length(path) >= m), F.concat(tail, F.substring(path, 1, m))))
    found = F.filter(F.array(*tried), lambda k: k.isNotNull())
    return F.reverse(F.array_sort(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))))["key"]


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    blocked_hosts: DataFrame | None = None,
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains if the url's
    path starts with the rule's path; the longest rule wins, ties go to the later key.  Which of
    a url's possible keys are rules is asked of a cascade over all possible keys of the pages.
    A url without a rule is blocked if its host is in ``blocked_hosts`` (column ``key``), asked
    of a second cascade over all hosts, and else gets ``default``.  A url that is null or has
    no ``://`` has an empty host and path and so the default verdict.  Columns of ``pages`` that
    have one of the added names are replaced.
    """
    spark = pages.sparkSession
    parsed = packed(pages, host=url_host(F.col(url_col)), path=url_path(F.col(url_col)))
    keyed = [(h, p, v) for v, h, p in rules]
    names = spark.createDataFrame([(h + p,) for h, p, _ in keyed], "key string")
    candidates = rule_candidates(F.col("host"), F.col("path"), keyed) if keyed else F.array().cast("array<string>")
    universe = parsed.select(F.explode(candidates).alias("key"))
    is_rule = listed(build_cascade(names, universe), F.col("_key"))
    tried = parsed.withColumn("_tried", candidates)
    width = len({h.count(".") for h, _, _ in keyed}) * len({len(p) for _, p, _ in keyed})
    found = F.lit(None).cast("string")
    for i in range(width):
        key = F.get("_tried", F.lit(i))
        tried = tried.withColumn("_key", key).withColumn(f"_is{i}", is_rule)
        found = F.coalesce(found, F.when(F.col(f"_is{i}"), key))
    verdict_of = F.create_map(*[F.lit(x) for h, p, v in keyed for x in (h + p, v)]) if keyed else None
    ruled = tried.withColumn("rule", found)
    own = F.element_at(verdict_of, F.col("rule")) if keyed else F.lit(None).cast("string")
    method = F.lit(default)
    if blocked_hosts is not None:
        hosts = build_cascade(blocked_hosts, parsed.select(F.col("host").alias("key")))
        if hosts.size <= MAX_BROADCAST:
            blocked = listed(hosts, F.col("host"))
        else:
            found = listed_by_shard(hosts, parsed, "host").withColumnRenamed("listed", "_listed")
            ruled, blocked = ruled.join(found, "host"), F.col("_listed")
        method = F.when(blocked, F.lit("block")).otherwise(method)
    verdict = F.when(F.col("rule").isNotNull(), own).otherwise(F.col("_method"))
    found = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": verdict}
    return unpacked(ruled.withColumn("_method", method), pages.columns, **found)
