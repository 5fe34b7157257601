"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a quota of blocks.  A binary tree over the output shards splits the quotas:
at each node the left half receives a hypergeometric draw of every source's blocks, so each
shard ends with an exact number of blocks and no block is dealt twice.  Each shard then reads
its stretch of the source's permuted blocks and is shuffled locally.  All of it is DataFrame
code; sizes, targets and trees are tables of one row per source or (source, node).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import discard, materialize
from .frames import packed, unpacked

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SHARDS = 16
SHARD_WORDS = 4_000_000
BLOCK_DOCS = 64
MAX_BLOCKS = 1 << 16
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, *keys) -> Column:
    """Even draw in [0, 1) with 52 bits, fixed by seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, source_col: str, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to a table of one row per source with ``source_size``.

    Sources by code point, null last, take the weights in turn and share the total; a target
    stops at ``max_repeat`` times its source, and the excess is reshared by weight.  That is
    min(cap, level * weight) for one level; sources reach their cap in the order of cap / weight,
    so running sums in this order give the level.
    """
    by_name = W.orderBy(F.col(source_col).asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    weighed = weighed.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("_ratio", F.col(source_col).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranked = weighed.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("_total"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))).alias("_open"),
    )
    # the level if exactly the sources before this one stop at their caps; the first one it fits is right
    ranked = ranked.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))
    level = F.min_by(fits, F.when(fits.isNotNull(), F.col("_ratio"))).over(everything)
    target = F.coalesce(F.least("_cap", level * F.col("_weight")), F.col("_cap"))
    return ranked.select(*sizes.columns, target.alias("target"))


def hypergeometric(draw_: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """Number of marked ones among ``drawn`` of ``population``, by inversion outward from the mode.

    Weights follow from the ratio of neighbouring probabilities and stop 12 standard
    deviations away, where less than 1e-30 of the mass is left; that keeps the sum short.
    """
    low = F.greatest(F.lit(0), drawn - (population - marked))
    high = F.least(marked, drawn)
    n, k, d = (c.cast("double") for c in (population, marked, drawn))
    mode = F.least(F.greatest(F.floor((k + 1) * (d + 1) / (n + 2)), low), high)
    spread = F.ceil(12 * F.sqrt(d * k / n * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)) + 1))
    first, last = F.greatest(low, mode - spread), F.least(high, mode + spread)
    up = F.when(mode < last, F.sequence(mode + 1, last)).otherwise(F.array().cast("array<bigint>"))
    down = F.when(mode > first, F.sequence(mode - 1, first, F.lit(-1))).otherwise(F.array().cast("array<bigint>"))

    def chain(values: Column, step) -> Column:
        start = F.array(F.struct(F.lit(1.0).alias("p"), mode.cast("long").alias("x")))
        return F.aggregate(
            values,
            start,
            lambda acc, x: F.concat(acc, F.array(F.struct(
                (F.element_at(acc, -1)["p"] * step(x.cast("double"))).alias("p"), x.cast("long").alias("x")
            ))),
        )

    rising = chain(up, lambda x: (k - x + 1) * (d - x + 1) / (x * (n - k - d + x)))
    falling = chain(down, lambda x: (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x)))
    cells = F.concat(rising, F.slice(falling, 2, F.greatest(F.size(falling) - 1, F.lit(0))))
    total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["p"])
    picked = F.aggregate(
        cells,
        F.struct((draw_ * total).alias("left"), F.lit(None).cast("long").alias("x")),
        lambda acc, c: F.struct(
            (acc["left"] - c["p"]).alias("left"),
            F.when(acc["x"].isNull() & (acc["left"] < c["p"]), c["x"]).otherwise(acc["x"]).alias("x"),
        ),
    )["x"]
    inside = F.coalesce(picked, mode.cast("long"))
    return F.when(low >= high, low.cast("long")).otherwise(inside)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """(source, shard, blocks, offset): the leaves of the splitting tree.

    ``quotas`` holds (``_source``, ``_blocks``).  A node of ``n`` blocks gives its left child a
    share by number of shards below it.  Inside a node the sources are drawn one after the
    other, each from the blocks that the sources before it left open: the multivariate
    hypergeometric law.  ``offset`` is where the shard's stretch of the source's blocks begins.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("_source", "_blocks"))).alias("_quotas"))
    node = node.select(F.lit(0).cast("long").alias("_first"), F.lit(shards).cast("long").alias("_wide"), "_quotas")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level % 6 == 5:
            # small rows, costly draws: more nodes than a task should split alone
            node = node.repartition(1 << level, "_first")
        half = F.floor(F.col("_wide") / 2)
        total = F.aggregate("_quotas", F.lit(0).cast("long"), lambda acc, q: acc + q["_blocks"])
        goes = F.when(F.col("_wide") > 1, F.floor(total * half / F.col("_wide"))).otherwise(total)
        start = F.struct(
            total.alias("open"), goes.cast("long").alias("want"),
            F.array().cast("array<bigint>").alias("taken"),
        )

        def step(acc, q):
            u = draw(seed, F.col("_first"), F.col("_wide"), q["_source"])
            got = hypergeometric(u, acc["open"], q["_blocks"], acc["want"])
            # a one-element array names the drawn value, so that it is computed once
            return F.element_at(F.transform(F.array(got), lambda x: F.struct(
                (acc["open"] - q["_blocks"]).alias("open"), (acc["want"] - x).alias("want"),
                F.concat(acc["taken"], F.array(x)).alias("taken"),
            )), 1)

        drawn = node.withColumn("_left", F.aggregate("_quotas", start, step)["taken"])
        pairs = F.zip_with("_quotas", "_left", lambda q, x: F.struct(q["_source"].alias("_source"), x.alias("_blocks")))
        rest = F.zip_with(
            "_quotas", "_left",
            lambda q, x: F.struct(q["_source"].alias("_source"), (q["_blocks"] - x).alias("_blocks")),
        )
        leaf = F.array(F.struct(F.col("_first"), F.col("_wide"), F.col("_quotas")))
        children = F.array(
            F.struct(F.col("_first"), half.cast("long").alias("_wide"), pairs.alias("_quotas")),
            F.struct((F.col("_first") + half).alias("_first"), (F.col("_wide") - half).alias("_wide"), rest.alias("_quotas")),
        )
        node = drawn.select(F.inline(F.when(F.col("_wide") > 1, children).otherwise(leaf)))
    leaves = node.select(F.col("_first").alias("shard"), F.inline("_quotas"))
    ahead = W.partitionBy("_source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_blocks").over(ahead), F.lit(0))
    return leaves.select("_source", "shard", "_blocks", offset.alias("_offset"))


def cut_point(placed: DataFrame, state: DataFrame, max_repeat: int) -> DataFrame:
    """One pass of ``fill``: how far along the draws the documents of a source fit its room.

    A document's extra copies stand at its draw, its draw + 1 and so on.  ``state`` holds
    (``_source``, ``_n_blocks``, ``_extra``, ``_from``, ``_room``, ``_above``, ``_limit``): the
    first ``_extra`` copies from place ``_from`` on may be taken, of documents of more than
    ``_above`` and at most ``_limit`` words.  The place where their running words meet ``_room``
    is searched by histograms: the block that meets it, a slice of this block, a slice of that
    slice.  A group has at most ``max_repeat`` times ``MAX_BLOCKS`` rows whatever the
    source's size.  Returns (``_source``, ``_to``, ``_past``, ``_left``, ``_all``): taken up to
    ``_to``, looked at up to ``_past``; ``_all`` says that no copy was left over.
    """
    # powers of two keep the places of slices exact
    wide = 1 << max_repeat.bit_length()
    names = ["_source", "_extra", "_from", "_above", "_limit", "_fan", "_low", "_width", "_room"]
    cut = state.select(
        "_source", "_extra", "_from", "_above", "_limit", (F.col("_n_blocks") * wide).alias("_fan"), F.lit(0.0).alias("_low"),
        F.lit(float(wide)).alias("_width"), "_room",
    )
    few = state.count() <= BROADCAST_SOURCES
    for _ in range(3):
        # a hot source must not meet its one row in one task
        inside = placed.select("_source", "_u", "size").join(F.broadcast(cut) if few else cut, "_source").where(
            (F.col("size") > F.col("_above")) & (F.col("size") <= F.col("_limit"))
        )
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_extra") - 1))
        inside = inside.select(*names, "size", "_u", copy.alias("_copy")).withColumn("_u", F.col("_u") + F.col("_copy")).where(
            (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_low") + F.col("_width")) & (F.col("_u") >= F.col("_from"))
        )
        part = F.floor((F.col("_u") - F.col("_low")) / F.col("_width") * F.col("_fan"))
        parts = inside.groupBy(*names, part.alias("_part")).agg(F.sum("size").alias("_words"))
        ahead = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
        met = parts.where(F.col("_before") < F.col("_room")).groupBy("_source").agg(
            F.max_by(F.struct(*names[1:], "_part", "_before", "_words"), "_part").alias("_m")
        )
        step = F.col("_m._width") / F.col("_m._fan")
        cut = met.select(
            "_source", *[F.col(f"_m.{n}") for n in names[1:5]], F.lit(MAX_BLOCKS).cast("long").alias("_fan"),
            (F.col("_m._low") + F.col("_m._part") * step).alias("_low"), step.alias("_width"),
            (F.col("_m._room") - F.col("_m._before")).alias("_room"), F.col("_m._words").alias("_words"),
        )
    fits = F.col("_words") <= F.col("_room")
    past = F.col("_low") + F.col("_width")
    return cut.select(
        "_source", F.when(fits, past).otherwise(F.col("_low")).alias("_to"), past.alias("_past"),
        F.when(fits, F.col("_room") - F.col("_words")).otherwise(F.col("_room")).alias("_left"), fits.alias("_all"),
    )


SPANS = "array<struct<low:double,high:double,above:double,limit:double>>"


def fill(placed: DataFrame, goals: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``_spans`` and ``_cut`` to ``goals``: which extra copies make up the last, partial pass.

    The first span takes documents in permuted order until the next one would overshoot.  Each
    further pass takes copies behind it of at most half the gap, second and third copies after
    the first ones, again until one would overshoot; that one is larger than what is then left,
    so the gap halves and what was passed over no longer fits.  Where all such copies fit, one
    more pass takes the first of the larger ones that fits.  A source is done when its gap is
    below its smallest document, or nothing is left that fits; so at the end no copy that may
    still be taken is as small as the gap, and passes number at most the logarithm of the
    words.  Only sources that are not done are looked at again.
    """
    state = goals.select(
        "*", F.lit(0.0).alias("_from"), F.col("_rest").alias("_room"), F.lit(-1.0).alias("_above"),
        F.lit(float("inf")).alias("_limit"), F.lit(1).cast("long").alias("_extra"), F.lit(0.0).alias("_cut"),
        F.when(F.coalesce(F.col("_rest") >= F.col("_smallest"), F.lit(False)), "first").otherwise("done").alias("_phase"),
        F.array().cast(SPANS).alias("_spans"),
    )
    names = state.columns
    state = materialize(state, "mix-fill")
    while state.where("_phase != 'done'").limit(1).count():
        found = state.join(cut_point(placed, state.where("_phase != 'done'"), max_repeat), "_source", "left")
        left, to = F.coalesce("_left", "_room"), F.coalesce("_to", "_from")
        every = F.coalesce("_all", F.lit(True))
        span = F.struct(F.col("_from").alias("low"), to.alias("high"), F.col("_above").alias("above"), F.col("_limit").alias("limit"))
        larger = (F.col("_phase") == "halves") & every
        over = (left < F.col("_smallest")) | (F.col("_phase") == "larger") | (larger & (left <= F.col("_limit")))
        changed = {
            "_from": F.when(larger, F.col("_from")).otherwise(F.coalesce("_past", "_from")),
            "_room": left,
            "_above": F.when(larger, F.col("_limit")).otherwise(F.lit(0.0)),
            "_limit": F.when(larger, left).otherwise(left / 2),
            "_extra": F.lit(max_repeat).cast("long") - F.col("_passes"),
            "_cut": F.greatest("_cut", to),
            "_phase": F.when(over, "done").when(larger, "larger").otherwise("halves"),
            "_spans": F.concat("_spans", F.array(span)),
        }
        following = materialize(found.select(*[
            F.when(F.col("_phase") == "done", F.col(n)).otherwise(changed[n]).alias(n) if n in changed else F.col(n) for n in names
        ]), "mix-fill")
        discard(state)
        state = following
    cuts = materialize(state.select(*goals.columns, "_spans", "_cut"), "mix-cuts")
    discard(state)
    return cuts


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    shards: int | None = None,
    block_docs: int = BLOCK_DOCS,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: its sizes, its source's target and the shards that read it.

    Columns: ``id_col``, ``size``, ``source_size``, ``target``, ``taken`` and ``places``, an
    array of (shard, position) with one entry per copy.  Documents of a source are permuted
    by hash and cut into blocks of about ``block_docs``, at most ``MAX_BLOCKS``.  The target
    takes whole passes over the source, then a last pass over its leading blocks that ends
    where the target is met (see ``fill``).  So a source misses its target by less than the
    smallest of its documents that may be taken once more, and no document is taken more than
    ``max_repeat`` times.  A document longer than its source's last pass stays out of it, and
    others come a second or third time in its place.  A null source is a
    source of its own; null or empty texts have size 0; rows that share an id are placed
    alike.  An empty table gives an empty mix.  Sizes are written once; texts are read once.
    Unless given, there is a shard for every ``SHARD_WORDS`` words, ``SHARDS`` at least.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    sized = materialize(docs.select(
        F.col(id_col).alias("_doc"), F.col(source_col).alias("_name"), key.alias("_source"),
        words(F.col(text_col)).alias("size"), draw(seed, F.lit("order"), F.col(id_col)).alias("_u"),
    ), "mix-sizes")
    if shards is None:
        shards = max(SHARDS, math.ceil((sized.agg(F.sum("size")).first()[0] or 0) / SHARD_WORDS))
    totals = sized.groupBy("_source", "_name").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"),
                                                     F.min(F.when(F.col("size") > 0, F.col("size"))).alias("_smallest"))
    goals = targets(totals, "_name", weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks_wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("_docs") / block_docs, F.lit(1.0)))))
    goals = goals.select(
        "_source", "source_size", "target", F.least(whole, F.lit(max_repeat)).cast("long").alias("_passes"),
        F.least(blocks_wanted.cast("long"), F.lit(MAX_BLOCKS)).alias("_n_blocks"), "_smallest",
    ).withColumn("_rest", F.round(F.col("target") - F.col("_passes") * F.col("source_size"), 6))
    given = materialize(goals, "mix-goals")
    goals = fill(sized, given, max_repeat).select(
        "_source", "source_size", "target", "_n_blocks", "_spans", F.col("_passes").alias("_whole"),
        (F.col("_passes") + F.floor("_cut")).alias("_passes"), (F.col("_cut") - F.floor("_cut")).alias("_cut"),
    )
    discard(given)
    block = F.floor(F.col("_u") * F.col("_n_blocks"))
    few = goals.count() <= BROADCAST_SOURCES
    placed = sized.drop("_name").join(F.broadcast(goals) if few else goals, "_source").withColumn("_block", block)

    # every copy of a block is one of the source's quota: numbered pass by pass, then by block
    blocks = placed.groupBy("_source", "_block", "_n_blocks", "_passes", "_cut").agg(F.lit(1).alias("_one"))
    last = (F.col("_block") < F.col("_cut") * F.col("_n_blocks")).cast("long")
    quotas = blocks.groupBy("_source").agg(F.sum(F.col("_passes") + last).alias("_blocks"), F.count("_one").alias("_held"))
    stretches = split_quotas(quotas.select("_source", "_blocks"), shards, seed).groupBy("_source").agg(
        F.array_sort(F.collect_list(F.struct("_offset", "_blocks", "shard"))).alias("_stretches")
    )
    nth = W.partitionBy("_source").orderBy(draw(seed, F.lit("block"), "_source", "_block"), "_block")
    last_nth = W.partitionBy("_source", last).orderBy(draw(seed, F.lit("block"), "_source", "_block"), "_block")
    numbered = blocks.select("_source", "_block", "_passes", last.alias("_last"), (F.row_number().over(nth) - 1).alias("_nth"),
                             (F.row_number().over(last_nth) - 1).alias("_last_nth"))
    numbered = numbered.join(quotas.select("_source", "_held").join(stretches, "_source"), "_source")
    copies = F.sequence(F.lit(0).cast("long"), F.col("_passes") + F.col("_last") - 1)
    none = F.array().cast("array<bigint>")

    def shard_of(c: Column) -> Column:
        slot = c * F.col("_held") + F.when(c < F.col("_passes"), F.col("_nth")).otherwise(F.col("_last_nth"))
        mine = F.filter("_stretches", lambda s: (s["_offset"] <= slot) & (slot < s["_offset"] + s["_blocks"]))
        return F.struct(c.alias("_copy"), F.element_at(mine, 1)["shard"].alias("shard"))

    dealt = numbered.select(
        "_source", "_block",
        F.transform(F.when(F.col("_passes") + F.col("_last") > 0, copies).otherwise(none), shard_of).alias("_copies"),
    )

    joined = placed.join(dealt, ["_source", "_block"])

    def in_last(copy: Column) -> Column:
        at = F.col("_u") + (copy - F.col("_whole"))
        return F.exists("_spans", lambda s: (s["low"] <= at) & (at < s["high"])
                        & (s["above"] < F.col("size")) & (F.col("size") <= s["limit"]))

    own = F.filter("_copies", lambda c: (c["_copy"] < F.col("_whole")) | in_last(c["_copy"]))
    places = F.transform(own, lambda c: F.struct(
        c["shard"].alias("shard"), draw(seed, F.lit("place"), F.col("_doc"), c["_copy"]).alias("position")
    ))
    return joined.select(
        F.col("_doc").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.size(own)).cast("long").alias("taken"), places.alias("places"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: ``docs`` once per copy, dealt to shards and shuffled inside each.

    Adds ``shard`` and ``position``; rows lie in files by shard, in order of position.
    """
    places = plan_mix(docs, id_col, **options).select(
        F.col(id_col).alias("_doc"), F.inline("places")
    ).distinct()
    rows = packed(docs, id=F.col(id_col)).join(places, F.col("id").eqNullSafe(F.col("_doc")))
    mixed = unpacked(rows, docs.columns, shard=F.col("shard"), position=F.col("position"))
    return mixed.repartition("shard").sortWithinPartitions("shard", "position")
