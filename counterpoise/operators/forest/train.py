"""Level-wise training of all trees of a forest together.

The rows of open nodes are a written table, one row per tree that drew it, with the node it is at.
A level is one pass: a histogram over every open node of every tree, the best split of each
node as one row of a table, and a join that moves the rows to their children.  Rows of closed nodes
drop out.  Categories are codes of a table of values, so neither they nor the nodes of the model
go through the driver, and a level's tables have a known size: Spark broadcasts the small ones.
Levels end where the rows of all open nodes fit a block of ``LAST_CELLS``: what is below is grown
from arrays in one task (``block``), since a level of few rows costs its jobs, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ...functions.draw import below, bucket, u
from ...session import discard, materialize
from ..prefix import running_sums, shuffled_rank, sorted_rank
from .block import KINDS, Rules, grown
from .nodes import ForestTable
from .split import WINDOW_VALUES, Target, categorical_gains, class_target, default_attributes, numeric_splits

EPSILON = 1e-6
# one window numbers the open nodes of a tree up to here, chunks of node numbers beyond
WINDOW_NODES = 1 << 20
NODE_CHUNK = 1 << 20
# rows, times classes and attributes, of the block that is grown to its end in one task
LAST_CELLS = 1 << 18


def _draws(df: DataFrame, ids: list[str], n_trees: int, partitions: int | None, seed) -> tuple[DataFrame, DataFrame]:
    """(rows with ``grp`` and ``_row``, one row (grp, _row, tree) per draw).

    Every tree draws as many rows with replacement as its partition holds; without
    ``partitions`` there is one partition.  Trees are dealt evenly, the remainder to the
    first partition.
    """
    if partitions is None:
        split = df.withColumn("grp", F.lit(0))
        first, last = F.lit(0), F.lit(n_trees - 1)
    else:
        each, extra = divmod(n_trees, partitions)
        split = df.withColumn("grp", bucket(f"{seed}-part", partitions, *ids))
        first = F.when(F.col("grp") == 0, 0).otherwise(F.col("grp") * each + extra)
        last = F.when(F.col("grp") == 0, each + extra - 1).otherwise(F.col("grp") * each + extra + each - 1)
    ranked = materialize(shuffled_rank(split, ids, ["grp"], seed=f"{seed}-rank", out="_row"), "ranked-rows")
    sizes = ranked.groupBy("grp").agg(F.count(F.lit(1)).alias("_size"))
    trees = F.filter(F.sequence(first, last, F.lit(1)) if partitions is None else F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda t: t >= 0)
    draws = ranked.join(sizes, "grp").select("grp", "_row", "_size", F.explode(trees).alias("tree"))
    return ranked, draws.select("grp", below(u(seed, "tree", "_row"), F.col("_size")).alias("_row"), "tree")


def bag_rows(df: DataFrame, ids: list[str], n_trees: int, partitions: int | None, seed="bag") -> DataFrame:
    """Adds ``grp`` and ``bag``: the trees that drew each row, with multiplicity."""
    ranked, hits = _draws(df, ids, n_trees, partitions, seed)
    bags = hits.groupBy("grp", "_row").agg(F.collect_list("tree").alias("bag"))
    return ranked.join(bags, ["grp", "_row"]).drop("_row")


def weighted_rows(df: DataFrame, ids: list[str], n_trees: int, partitions: int | None, seed="bag") -> DataFrame:
    """Each row once per tree that drew it, with ``tree`` and ``w``, how often it did."""
    ranked, hits = _draws(df, ids, n_trees, partitions, seed)
    # the same deal of rows serves the count and the join
    counted = hits.repartition("grp", "_row").groupBy("grp", "_row", "tree").agg(F.count(F.lit(1)).alias("w"))
    return ranked.join(counted, ["grp", "_row"]).drop("_row", "grp")


def bin_edges(df: DataFrame, numeric: list[str], max_bins: int, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Split candidates of each numeric column: at most ``max_bins`` of its quantiles."""
    shares = [i / max_bins for i in range(max_bins)]
    row = df.agg(*[F.percentile_approx(c, shares, accuracy).alias(c) for c in numeric]).first()
    return {c: sorted(set(row[c] or [])) for c in numeric}


def _binned(value: Column, edges: list[float]) -> Column:
    """Largest edge not above the value, so ``x < edge`` means the same before and after."""
    below_value = F.filter(F.lit(edges).cast("array<double>"), lambda e: e <= value)
    return F.coalesce(F.array_max(below_value), F.lit(edges[0]))


class _Grower:
    """Growth rules as column expressions; attributes are numbers, numeric ones first."""

    def __init__(self, target: Target, names: list[str], n_numeric: int, m, min_split, min_var_prop, min_gain, max_depth, retry, seed):
        self.target, self.names, self.n_numeric = target, names, n_numeric
        self.m, self.min_split, self.min_var_prop, self.min_gain = m, min_split, min_var_prop, min_gain
        self.max_depth, self.retry, self.seed = max_depth, retry, seed
        self.numbers = [f"x{i}" for i in range(n_numeric)]
        self.words = [f"x{i}" for i in range(n_numeric, len(names))]

    def stats(self, prefix: str = "") -> list[Column]:
        return [F.col(prefix + n) for n in self.target.names]

    def attributes(self) -> Column:
        """The random attributes of a node, in drawn order."""
        named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(self.names)])
        free = F.filter(named, lambda a: ~F.array_contains("used", a["i"]))
        drawn = F.array_sort(F.transform(free, lambda a: F.struct(u(self.seed, "tree", "node", a["name"]).alias("u"), a["name"].alias("name"), a["i"].alias("i"))))
        return F.transform(F.slice(drawn, 1, self.m), lambda a: a["i"])

    def finished(self, stats: list[Column], used: Column) -> Column:
        done = self.target.pure(stats, F.col("least")) | (F.size(used) >= len(self.names))
        return done if self.max_depth is None else done | (F.col("depth") >= self.max_depth)

    def answer(self, stats: list[Column]) -> Column:
        return self.target.answer(stats, self.seed, F.lit("label"), F.col("tree"), F.col("node"))

    def histogram(self, rows: DataFrame) -> DataFrame:
        """Statistics of every value of the attributes that the open nodes drew."""
        cells = rows.select("tree", "node", "w", "y", F.posexplode("attrs").alias("rank", "attr"), *self.numbers, *self.words)
        number, word = F.lit(None).cast("double"), F.lit(None).cast("long")
        for i in range(len(self.names)):
            if i < self.n_numeric:
                number = F.when(F.col("attr") == i, F.col(f"x{i}")).otherwise(number)
            else:
                word = F.when(F.col("attr") == i, F.col(f"x{i}")).otherwise(word)
        keys = ["tree", "node", "rank", "attr", number.alias("value"), word.alias("word")]
        return materialize(cells.groupBy(*keys).agg(*self.target.aggregates(F.col("w"))), "histogram")

    def decide(self, open_: DataFrame, hist: DataFrame, values: DataFrame | None, base: int, n_open: int, chunked: bool) -> DataFrame:
        """One row per open node: leaf, retry, or its split, with the first id of its children."""
        target, names = self.target, self.target.names
        types = dict(hist.dtypes)
        keys, parts = ["tree", "node", "rank"], []
        if self.numbers:
            splits = numeric_splits(hist.where(F.col("value").isNotNull()).drop("word"), keys, target, 9 if target.classes is not None else 6, chunked)
            parts.append(splits.select(*keys, "attr", "split", "gain", *[f"l_{n}" for n in names], F.lit(None).cast("long").alias("big")))
        if self.words:
            words = hist.where(F.col("word").isNotNull())
            big = words.groupBy(*keys, "attr").agg(F.count_if(target.size(self.stats()) >= self.min_split).alias("big"))
            gains = categorical_gains(words, keys, target).join(big, [*keys, "attr"])
            parts.append(gains.select(
                *keys, "attr", F.lit(None).cast("double").alias("split"), "gain", *[F.lit(None).cast(types[n]).alias(f"l_{n}") for n in names], "big"))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        columns = ["split", "gain", "attr", *[f"l_{n}" for n in names], "big"]
        best = found.groupBy("tree", "node").agg(F.min_by(F.struct(*columns), F.struct(-F.round("gain", 9), F.col("rank"))).alias("b"))
        whole = hist.where(F.col("rank") == 0).groupBy("tree", "node").agg(*[F.sum(n).alias(f"t_{n}") for n in names])
        met = open_.join(whole, ["tree", "node"], "left").join(best.select("tree", "node", "b.*"), ["tree", "node"], "left")
        total, low = self.stats("t_"), self.stats("l_")
        first = (F.col("node") == 0) & F.lit(target.classes is None)
        met = met.withColumn("least", F.when(first, target.spread(total) * self.min_var_prop).otherwise(F.col("least")))
        tried = F.concat("used", F.array("attr"))
        poor = F.col("gain").isNull() | (F.col("gain") < self.min_gain)
        halves = [target.size(low), target.size(total) - target.size(low)]
        kind = F.when(F.col("attr").isNull() | F.col(f"t_{names[0]}").isNull() | self.finished(total, F.col("used")), "leaf")
        if self.retry:
            kind = kind.when(poor & ~self.finished(total, tried), "retry")
        kind = kind.when(poor, "leaf").when(F.col("attr") < self.n_numeric, F.when((halves[0] >= self.min_split) & (halves[1] >= self.min_split), "numeric"))
        kind = kind.when(F.col("big") >= 2, "categorical")
        decided = met.withColumns({"kind": F.coalesce(kind, F.lit("leaf")), "label": self.answer(total), "span": F.lit(0).cast("long")})
        if values is not None:
            widths = values.groupBy(F.col("attr").alias("_attr")).agg(F.count(F.lit(1)).alias("_width"))
            decided = decided.join(widths, F.col("attr") == F.col("_attr"), "left")
            decided = decided.withColumn("span", F.when(F.col("kind") == "categorical", F.col("_width")).otherwise(0)).drop("_attr", "_width")
        decided = decided.withColumns({
            "span": F.when(F.col("kind") == "numeric", 2).otherwise(F.col("span")).cast("long"),
            "used": F.when(F.col("kind") == "numeric", F.filter("used", lambda a: a >= self.n_numeric)).when(
                F.col("kind").isin("categorical", "retry"), tried).otherwise(F.col("used")),
        })
        if n_open <= WINDOW_NODES:
            upto = W.partitionBy("tree").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)
            placed = decided.withColumn("child", F.sum("span").over(upto))
        else:
            chunk = F.floor(F.col("node") / NODE_CHUNK).cast("long")
            written = materialize(decided.withColumn("_chunk", chunk), "decided")
            placed = running_sums(written, ["tree"], ["node"], {"child": F.col("span")}).drop("_chunk")
        return materialize(placed.withColumn("child", F.col("child") - F.col("span") + base), "nodes")

    def children(self, nodes: DataFrame, hist: DataFrame) -> DataFrame:
        """Children of the split nodes, with ``closed`` for leaves, and the value they are reached by."""
        target, names = self.target, self.target.names
        keep = ["tree", "used", "least", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")]
        low = F.struct(F.col("child").alias("node"), *[F.col(f"l_{n}").alias(n) for n in names])
        high = F.struct((F.col("child") + 1).alias("node"), *[(F.col(f"t_{n}") - F.col(f"l_{n}")).alias(n) for n in names])
        halves = nodes.where(F.col("kind") == "numeric").select(*keep, F.explode(F.array(low, high)).alias("c"))
        out = halves.select("tree", "used", "least", "depth", "parent", "c.*", F.lit(None).cast("int").alias("attr"), F.lit(None).cast("long").alias("word"))
        if self.words:
            cells = hist.where(F.col("word").isNotNull()).drop("rank", "value")
            wide = nodes.where(F.col("kind") == "categorical").select(*keep, "attr", "child")
            met = wide.join(cells.withColumnRenamed("node", "parent"), ["tree", "parent", "attr"])
            out = out.unionByName(met.select(
                "tree", "used", "least", "depth", "parent", (F.col("child") + F.col("word")).alias("node"), *names, "attr", "word"))
        stats = self.stats()
        return materialize(out.withColumns({
            "size": target.size(stats), "label": self.answer(stats), "closed": F.coalesce((target.size(stats) == 0) | self.finished(stats, F.col("used")), F.lit(True)),
        }).drop(*names), "children")

    def move(self, rows: DataFrame, nodes: DataFrame, open_: DataFrame) -> DataFrame:
        """Rows of the nodes still open, at their new node."""
        splits = nodes.where(F.col("kind") != "leaf").select(
            "tree", "node", F.col("kind").alias("_kind"), F.col("attr").alias("_attr"), F.col("split").alias("_split"), F.col("child").alias("_child"))
        value = F.lit(None).cast("double")
        for i in range(len(self.names)):
            value = F.when(F.col("_attr") == i, F.col(f"x{i}").cast("double")).otherwise(value)
        place = F.when(F.col("_kind") == "numeric", F.col("_child") + F.when(value < F.col("_split"), 0).otherwise(1))
        place = place.when(F.col("_kind") == "categorical", F.col("_child") + value.cast("long")).otherwise(F.col("node"))
        moved = rows.drop("attrs").join(splits, ["tree", "node"]).withColumn("node", place).drop("_kind", "_attr", "_split", "_child")
        return materialize(moved.join(open_.select("tree", "node", self.attributes().alias("attrs")), ["tree", "node"]), "open-rows")


def coded(rows: DataFrame, columns: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Rows with each category as a code, and the table of values (attr, value, code) per attribute number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("attr"), F.col(c).alias("value")) for i, c in columns.items()]))
    seen = rows.select(pairs.alias("p")).select("p.*").distinct()
    values = materialize(sorted_rank(seen, ["value"], ["attr"], out="code"), "values")
    for i, c in columns.items():
        mine = values.where(F.col("attr") == i).select(F.col("value").alias(c), F.col("code").alias(f"_c{i}"))
        rows = rows.join(mine, c).drop(c).withColumnRenamed(f"_c{i}", c)
    return rows, values


def train_forest(
    df: DataFrame,
    label: str,
    ids: list[str],
    numeric: list[str],
    categorical: list[str],
    n_trees: int = 10,
    mode: str = "global",
    partitions: int | None = None,
    m: int | None = None,
    min_split: int = 2,
    min_var_prop: float = 1e-3,
    min_gain: float = EPSILON,
    complemented: bool = True,
    max_depth: int | None = None,
    max_bins: int | None = None,
    regression: bool = False,
    bootstrap: bool = True,
    retry: bool = False,
    criterion: type[Target] = Target,
    seed="forest",
) -> ForestTable:
    """Train a forest on bootstraps of all rows ('global') or of each partition ('partitioned').

    Every distinct value is a split candidate; ``max_bins`` limits candidates to that many
    quantiles, which keeps histograms small on columns with many values.  ``criterion`` is the split
    criterion of classes.
    """
    used = [label, *numeric, *categorical]
    rows = materialize(df.select(*dict.fromkeys([*ids, *used])).na.drop(subset=used), "training-rows")
    if max_bins is not None and numeric:
        edges = bin_edges(rows, numeric, max_bins)
        rows = rows.withColumns({c: _binned(F.col(c).cast("double"), edges[c]) for c in numeric})
    if bootstrap:
        bagged = weighted_rows(rows, ids, n_trees, partitions if mode == "partitioned" else None, f"{seed}-bag")
    else:
        bagged = rows.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))), "w": F.lit(1).cast("long")})
    target = Target(label) if regression else class_target(rows, label, criterion)
    target = type(target)("y", target.classes)
    names, n_numeric = [*numeric, *categorical], len(numeric)
    kinds = ["double"] * n_numeric + ["string"] * len(categorical)
    named = bagged.select("tree", "w", F.col(label).alias("y"), *[F.col(c).cast(k).alias(f"x{i}") for i, (c, k) in enumerate(zip(names, kinds))])
    values = None
    if categorical:
        named, values = coded(named, {i: f"x{i}" for i in range(n_numeric, len(names))})
    tried = m or default_attributes(len(names), regression)
    grower = _Grower(target, names, n_numeric, tried, min_split, min_var_prop, min_gain, max_depth, retry, seed)

    start = F.array().cast("array<int>")
    open_ = df.sparkSession.range(n_trees).select(
        F.col("id").cast("int").alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("depth"), start.alias("used"),
        F.lit(None).cast("double").alias("least"))
    roots = open_.select("tree", "node", grower.attributes().alias("attrs"))
    table = materialize(named.join(F.broadcast(roots), "tree"), "open-rows")
    discard(rows)

    name_of = F.element_at(F.array(*map(F.lit, names)), F.col("attr") + 1)
    shown = ["tree", "node", "depth", "kind", name_of.alias("attr"), "split", "child", "label"]
    no_value = F.lit(None).cast("string")
    rounds, steps, base, n_open, chunked, last = [], [], 1, n_trees, None, None
    few = LAST_CELLS // (len(target.classes) + len(names)) if target.in_arrays else 0
    n_rows = table.limit(few + 1).count()
    while True:
        if 0 < n_rows <= few:
            last = _grow_last(table, open_, grower, values, base, name_of, not rounds)
            break
        hist = grower.histogram(table)
        if chunked is None:
            # nodes below have no more values than their root
            widest = hist.groupBy("tree", "attr").count().agg(F.max("count")).first()[0] or 0
            chunked = widest > WINDOW_VALUES
        nodes = grower.decide(open_, hist, values, base, n_open, chunked)
        reached = grower.children(nodes, hist)
        discard(hist)
        rounds.append(nodes.where(F.col("kind") != "retry").select(*shown))
        rounds.append(reached.where("closed").select(
            "tree", "node", "depth", F.lit("leaf").alias("kind"), F.lit(None).cast("string").alias("attr"), F.lit(None).cast("double").alias("split"),
            F.lit(None).cast("long").alias("child"), "label"))
        steps.append(reached.where(F.col("word").isNotNull()).select(
            "tree", F.col("parent").alias("node"), name_of.alias("attr"), F.col("word").alias("code"), F.col("node").alias("child")))
        steps.append(steps[-1].where(F.lit(False)))
        columns = ["tree", "node", "depth", "used", "least"]
        # weights are at least 1, so sizes bound the rows
        still = F.coalesce(F.sum(F.when(~F.col("closed"), F.col("size"))), F.lit(0))
        n_open, top, n_rows = reached.agg(F.count_if(~F.col("closed")), F.max("node"), still).first()
        base = max(base, (top or 0) + 1)
        open_ = reached.where(~F.col("closed")).select(*columns)
        if retry:
            again = nodes.where(F.col("kind") == "retry").select(*columns)
            sizes = F.coalesce(F.sum(target.size(grower.stats("t_"))), F.lit(0))
            more, rows_more = nodes.where(F.col("kind") == "retry").agg(F.count(F.lit(1)), sizes).first()
            n_open, n_rows, open_ = n_open + more, n_rows + rows_more, open_.union(again)
        if not n_open:
            break
        before, table = table, grower.move(table, nodes, open_)
        discard(before)
    discard(table)
    if values is None:
        values = df.sparkSession.createDataFrame([], "attr string, value string, code long")
    else:
        values = values.select(name_of.alias("attr"), "value", "code")
    return ForestTable(numeric, categorical, n_trees, rounds, steps, values, complemented, regression, last)


def _grow_last(
    table: DataFrame, open_: DataFrame, grower: _Grower, values: DataFrame | None, base: int, name_of: Column, roots: bool,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and steps of all levels below the open nodes, whose rows fit one block.  Only roots can be without rows."""
    target = grower.target
    widths = {r["attr"]: r["n"] for r in values.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).collect()} if values is not None else {}
    rules = Rules(
        target, grower.names, grower.n_numeric, grower.m, grower.min_split, grower.min_gain, grower.max_depth, grower.retry, str(grower.seed), widths)
    number = F.lit(None).cast("int")
    for i, c in enumerate(target.classes):
        number = F.when(F.col("y") == c, i).otherwise(number)
    rows = table.join(open_.select("tree", "node", "depth", "used"), ["tree", "node"]).select(
        "tree", "node", "depth", "used", number.alias("y"), "w", *grower.numbers, *grower.words)
    found = grown(rows, rules, base)
    labelled = materialize(found.withColumns(
        {n: F.col("stats")[i] for i, n in enumerate(target.names)} | {"name": F.when(F.col("attr").isNotNull(), name_of)}).withColumn("label", grower.answer(grower.stats())).drop(
        "stats", *target.names), "last-levels")
    nodes = labelled.where(F.col("kind").isin(*KINDS)).drop("attr").withColumnRenamed("name", "attr").select("tree", "node", "depth", "kind", "attr", "split", "child", "label")
    if roots:
        # levels show such a root with the last attribute
        bare = open_.join(table.select("tree").distinct(), "tree", "left_anti")
        none = F.lit(None)
        nodes = nodes.union(materialize(bare.select(
            "tree", "node", "depth", F.lit("leaf").alias("kind"), F.lit(grower.names[-1]).alias("attr"), none.cast("double").alias("split"),
            none.cast("long").alias("child"), none.cast("string").alias("label")), "bare-roots"))
    steps = labelled.where(F.col("kind") == "branch").select("tree", "node", F.col("name").alias("attr"), "code", "child")
    return nodes, steps


def grow_tree(df: DataFrame, label: str, ids: list[str], numeric: list[str], categorical: list[str], **options) -> ForestTable:
    """One tree on all rows, no bootstrap."""
    return train_forest(df, label, ids, numeric, categorical, n_trees=1, bootstrap=False, **options)


def grow_simple_tree(df: DataFrame, label: str, ids: list[str], numeric: list[str], categorical: list[str], m: int = 1, **options) -> ForestTable:
    """Plain variant: no least gain or child size, no added branches, one attribute per node.

    An attribute that does not change the rows is set aside and another one is drawn.
    """
    return grow_tree(df, label, ids, numeric, categorical, m=m, min_split=1, min_gain=1e-12,
                     complemented=False, retry=True, **options)


def partition_class_counts(df: DataFrame, label: str, ids: list[str], partitions: int, seed="forest-bag") -> DataFrame:
    """Rows of each class in each training partition."""
    split = df.withColumn("grp", bucket(f"{seed}-part", partitions, *ids))
    return split.groupBy("grp", label).agg(F.count(F.lit(1)).alias("n"))
