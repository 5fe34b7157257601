"""Decision forest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluate
from ..operators.forest.nodes import ForestTable
from ..operators.forest import model, nodes, split, train
from ..operators.forest.model import Forest, Node
from .base import LAB_SQL, LI_SQL, Tables, query, r6, r6_sql, u_sql

_LINE = f"(select *, cast(l_linenumber as varchar) as l_line from {LI_SQL})"
NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _line(t: Tables) -> DataFrame:
    return t.li.withColumn("l_line", F.col("l_linenumber").cast("string"))


def _x(n: str) -> str:
    return f"(case when ({n}) > 0 then ({n}) * ln({n}) else 0::DOUBLE end)"


def _imp(a: str, b: str) -> str:
    return f"(({_x(f'({a}) + ({b})')} - {_x(a)} - {_x(b)}) / ln(2))"


def _unpivot(attrs: list[str], kind: str, keep: str, source: str) -> str:
    return " union all ".join(f"select {keep}, '{a}' as attr, {a}::{kind} as value from {source}" for a in attrs)


@query("cat_gain", f"""with b as (select * from {_LINE}), v as ({_unpivot(['l_linestatus', 'l_line'], 'varchar', 'cls', 'b')}),
h as (select attr, value, count(*) filter (cls = 'pos') as p, count(*) filter (cls = 'neg') as n from v group by all)
select attr, {r6_sql(f"({_imp('sum(p)', 'sum(n)')} - sum({_imp('p', 'n')})) / sum(p + n)", 9)} as gain from h group by attr""")
def cat_gain(t: Tables) -> DataFrame:
    return split.categorical_gain(_line(t), ["l_linestatus", "l_line"], "cls").withColumn("gain", r6("gain", 9))


def _num_sql(keys: str, extra: str = "") -> str:
    by = f"{keys}, " if keys else ""
    return f"""h as (select {by}attr, value, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from v group by all),
c as (select *, sum(p) over w - p as lp, sum(n) over w - n as ln_, sum(p) over g as tp, sum(n) over g as tn from h
 window w as (partition by {by}attr order by value), g as (partition by {by}attr)),
gains as (select *, ({_imp('tp', 'tn')} - {_imp('lp', 'ln_')} - {_imp('tp - lp', 'tn - ln_')}) / (tp + tn) as gain from c),
best as (select {by}attr, value as split, gain from (select *, row_number() over (partition by {by}attr order by round(gain, 9) desc, value) as k from gains) where k = 1{extra})"""


@query("num_split", f"""with b as (select *, case when cls = 'pos' then 1 else 0 end as y from {LI_SQL}), v as ({_unpivot(NUMBERS, 'double', 'y', 'b')}),
{_num_sql('')} select attr, split, {r6_sql('gain', 9)} as gain from best""")
def num_split(t: Tables) -> DataFrame:
    return split.numeric_split(t.li, NUMBERS, "cls").withColumn("gain", r6("gain", 9))


@query("num_split_chunked", f"""with b as (select *, case when cls = 'pos' then 1 else 0 end as y from {LI_SQL}), v as ({_unpivot(NUMBERS, 'double', 'y', 'b')}),
{_num_sql('')} select attr, split, {r6_sql('gain', 9)} as gain from best""")
def num_split_chunked(t: Tables) -> DataFrame:
    target = split.class_target(t.li, "cls")
    hist = split.histogram(t.li, [], NUMBERS, "double", target)
    found = split.numeric_splits(hist, [], target, chunked=True)
    return found.select("attr", "split", r6("gain", 9).alias("gain"))


@query("random_attrs", f"""with b as (select l_suppkey as node, *, case when l_linestatus = 'O' then 1 else 0 end as y from lineitem),
v0 as ({_unpivot(NUMBERS, 'double', 'y, node', 'b')}),
a as (select * from (select *, row_number() over (partition by node order by {u_sql('attributes', 'node', 'attr')}, attr) as k
 from (select distinct node, attr from v0)) where k <= 3),
v as (select v0.* from v0 join a using (node, attr)),
{_num_sql('node')} select node, attr, split, {r6_sql('gain', 9)} as gain from best""")
def random_attrs(t: Tables) -> DataFrame:
    target = split.class_target(t.lineitem, "l_linestatus")
    hist = split.histogram(t.lineitem.withColumn("node", F.col("l_suppkey")), ["node"], NUMBERS, "double", target)
    drawn = split.random_attributes(hist.select("node", "attr").distinct(), ["node"], split.default_attributes(4, False))
    kept = hist.join(drawn, ["node", "attr"], "left_semi")
    return split.numeric_splits(kept, ["node"], target).select("node", "attr", "split", r6("gain", 9).alias("gain"))


@query("reg_cat_gain", f"""with v as ({_unpivot(['p_brand', 'p_type'], 'varchar', 'p_retailprice as y', 'part')}),
h as (select attr, value, count(*) as n, sum(y) as s, sum(y * y) as q from v group by all)
select attr, {r6_sql('(sum(q) - sum(s) * sum(s) / sum(n)) - sum(q - s * s / n)', 1)} as gain from h group by attr""")
def reg_cat_gain(t: Tables) -> DataFrame:
    found = split.regression_categorical_gain(t.part, ["p_brand", "p_type"], "p_retailprice")
    return found.withColumn("gain", r6("gain", 1))


@query("reg_num_split", f"""with v as ({_unpivot(['p_size', 'p_partkey'], 'double', 'p_retailprice as y', 'part')}),
h as (select attr, value, count(*) as n, sum(y) as s, sum(y * y) as q from v group by all),
c as (select *, lag(value) over w as prev, sum(n) over w - n as ln_, sum(s) over w - s as ls, sum(q) over w - q as lq,
 sum(n) over g as tn, sum(s) over g as ts, sum(q) over g as tq from h window w as (partition by attr order by value), g as (partition by attr)),
gains as (select *, (tq - ts * ts / tn) - (lq - ls * ls / ln_) - ((tq - lq) - (ts - ls) * (ts - ls) / (tn - ln_)) as gain from c where prev is not null)
select attr, (prev + value) / 2 as split, {r6_sql('gain', 1)} as gain from (
 select *, row_number() over (partition by attr order by round(gain, 3) desc, value) as k from gains) where k = 1""")
def reg_num_split(t: Tables) -> DataFrame:
    found = split.regression_numeric_split(t.part, ["p_size", "p_partkey"], "p_retailprice")
    return found.withColumn("gain", r6("gain", 1))


# scoring: a fixed model over all line items

def fixed_forest() -> Forest:
    leaf = lambda d, label: Node("leaf", d, label=label)
    one = [
        Node("numeric", 0, "l_quantity", 25.0, 1, 2), Node("numeric", 1, "l_discount", 0.05, 3, 4),
        Node("categorical", 1, "l_linestatus", branches={"F": 5, "O": 6}), leaf(2, "A"), leaf(2, "N"), leaf(2, "R"),
        Node("numeric", 2, "l_tax", 0.04, 7, 8), leaf(3, "N"), leaf(3, "A"),
    ]
    two = [
        Node("categorical", 0, "l_line", branches={"1": 1, "2": 2, "3": 3, "4": 4, "5": 5}),
        leaf(1, "A"), leaf(1, "N"), leaf(1, "R"), leaf(1, "A"), leaf(1, "N"),
    ]
    three = [Node("numeric", 0, "l_extendedprice", 40000.0, 1, 2), leaf(1, "R"), leaf(1, "A")]
    return Forest(NUMBERS, ["l_linestatus", "l_line"], [one, two, three])


_TREES = [
    """case when l_quantity < 25 then case when l_discount < 0.05::DOUBLE then 'A' else 'N' end
 when l_linestatus = 'F' then 'R' when l_linestatus = 'O' then case when l_tax < 0.04::DOUBLE then 'N' else 'A' end end""",
    "case l_line when '1' then 'A' when '2' then 'N' when '3' then 'R' when '4' then 'A' when '5' then 'N' end",
    "case when l_extendedprice < 40000 then 'R' else 'A' end",
]
_VOTES = f"""votes as materialized (select id, l_returnflag, {_TREES[0]} as p0, {_TREES[1]} as p1, {_TREES[2]} as p2 from {_LINE}),
long as (select id, p0 as p from votes union all select id, p1 from votes where p1 is not null union all select id, p2 from votes),
best as materialized (select id, arg_max(p, (n, {u_sql('vote', 'id', 'p')})) as prediction from (select id, p, count(*) as n from long group by all) group by id)"""


def _loaded(t: Tables) -> Forest:
    """The model written to its node table and read again."""
    made = fixed_forest()
    return Forest.from_table(made.table(t.spark), made.numeric, made.categorical)


@query("tree_predict", f"select id, {_TREES[0]} as prediction from {_LINE}")
def tree_predict(t: Tables) -> DataFrame:
    forest = _loaded(t)
    single = Forest(forest.numeric, forest.categorical, forest.trees[:1])
    return model.predict(_line(t), single, ["id"]).select("id", "prediction")


@query("forest_votes", f"with {_VOTES} select id, 0 as tree, p0 as prediction from votes union all select id, 1, p1 from votes union all select id, 2, p2 from votes")
def forest_votes(t: Tables) -> DataFrame:
    return model.tree_predictions(_line(t), _loaded(t), ["id"])


@query("forest_predict", f"with {_VOTES} select id, prediction from best")
def forest_predict(t: Tables) -> DataFrame:
    return model.predict(_line(t), _loaded(t), ["id"]).select("id", "prediction")


@query("forest_score", f"""with {_VOTES} select l_returnflag as actual, prediction as predicted, count(*) as n
 from votes join best using (id) group by all""")
def forest_score(t: Tables) -> DataFrame:
    scored = model.score(_line(t), _loaded(t), ["id"], "l_returnflag")
    return evaluate.confusion_counts(scored, "l_returnflag", "prediction")


@query("forest_predict_mean", f"""with v as (select id, case when l_quantity < 25 then 1.5::DOUBLE else 4::DOUBLE end as a,
 case l_line when '1' then 2::DOUBLE when '2' then 6::DOUBLE end as b from {_LINE})
select id, case when b is null then a else (a + b) / 2 end as prediction from v""")
def forest_predict_mean(t: Tables) -> DataFrame:
    trees = [
        [Node("numeric", 0, "l_quantity", 25.0, 1, 2), Node("leaf", 1, label="1.5"), Node("leaf", 1, label="4.0")],
        [Node("categorical", 0, "l_line", branches={"1": 1, "2": 2}), Node("leaf", 1, label="2.0"), Node("leaf", 1, label="6.0")],
    ]
    forest = Forest(["l_quantity"], ["l_line"], trees, regression=True)
    return model.predict(_line(t), forest, ["id"]).select("id", "prediction")


@query("decision_path", f"""select id, case when l_quantity < 25 then 'l_quantity < 25 -> ' ||
  case when l_discount < 0.05::DOUBLE then 'l_discount < 0.05 -> A' else 'l_discount >= 0.05 -> N' end
 else 'l_quantity >= 25 -> ' || case when l_linestatus = 'F' then 'l_linestatus = F -> R'
  else 'l_linestatus = O -> ' || case when l_tax < 0.04::DOUBLE then 'l_tax < 0.04 -> N' else 'l_tax >= 0.04 -> A' end end end as path from {_LINE}""")
def decision_path(t: Tables) -> DataFrame:
    return model.decision_paths(_line(t), _loaded(t), ["id"])


# training: the same growth written as SQL, two levels deep, one CTE per level

ATTRS = ["l_quantity", "l_discount", "l_tax"]


def _level_sql(k: int, m: int, seed: str) -> str:
    cells = " union all ".join(f"select tree, node, w, y, '{a}' as attr, {a} as value from rows{k}" for a in ATTRS)
    names = ", ".join(f"'{a}'" for a in ATTRS)
    value = "case b.attr " + " ".join(f"when '{a}' then r.{a}" for a in ATTRS) + " end"
    return f"""att{k} as (select * from (select tree, node, attr, row_number() over (partition by tree, node order by {u_sql(seed, 'tree', 'node', 'attr')}, attr) as rank
 from (select distinct tree, node from rows{k}), (select unnest([{names}]) as attr)) where rank <= {m}),
h{k} as (select tree, node, rank, attr, value, sum(w * y) as p, sum(w * (1 - y)) as n from ({cells}) join att{k} using (tree, node, attr) group by all),
c{k} as (select *, sum(p) over w - p as lp, sum(n) over w - n as ln_, sum(p) over g as tp, sum(n) over g as tn from h{k}
 window w as (partition by tree, node, attr order by value), g as (partition by tree, node, attr)),
g{k} as (select *, ({_imp('tp', 'tn')} - {_imp('lp', 'ln_')} - {_imp('tp - lp', 'tn - ln_')}) / (tp + tn) as gain from c{k}),
b{k} as materialized (select * from (select *, row_number() over (partition by tree, node order by round(gain, 9) desc, rank, value) as best from g{k}) where best = 1),
rows{k + 1} as materialized (select r.* exclude (node), 2 * r.node + case when {value} < b.value then 1 else 2 end as node from rows{k} r join b{k} b using (tree, node))"""


def _train_sql(rows0: str, m: int, seed: str) -> str:
    return f"""with recursive {rows0}, {_level_sql(0, m, seed)}, {_level_sql(1, m, seed)},
leaf as (select tree, node, sum(w * y) as p, sum(w * (1 - y)) as n from rows2 group by all)
select tree::INTEGER as tree, node::INTEGER as node, 'numeric' as kind, attr, value as split, null::VARCHAR as label from b0
union all select tree::INTEGER, node::INTEGER, 'numeric', attr, value, null from b1
union all select tree::INTEGER, node::INTEGER, 'leaf', null, null, case when p > n then 'pos' else 'neg' end from leaf"""


_PLAIN = f"rows0 as materialized (select 0 as tree, 0 as node, 1 as w, case when cls = 'pos' then 1 else 0 end as y, l_quantity, l_discount, l_tax from {LI_SQL})"


def _node_rows(t: Tables, forest: ForestTable) -> DataFrame:
    return forest.table(t.spark).select("tree", F.col("node").cast("int").alias("node"), "kind", "attr", "split", "label")


@query("tree_train", _train_sql(_PLAIN, 3, "forest"))
def tree_train(t: Tables) -> DataFrame:
    return _node_rows(t, train.grow_tree(t.li, "cls", ["id"], ATTRS, [], m=3, max_depth=2))


_BAGGED = f"""ranked as materialized (select id, cls, l_quantity, l_discount, l_tax, row_number() over (order by {u_sql('forest-bag-rank', 'id')}, id) - 1 as r from {LI_SQL}),
hits as (select tree, cast(floor({u_sql('forest-bag', 'tree', 'r')} * (select count(*) from ranked)) as bigint) as r, count(*) as w
 from ranked, (select unnest(range(0, 5)) as tree) group by 1, 2),
rows0 as materialized (select tree, 0 as node, w, case when cls = 'pos' then 1 else 0 end as y, l_quantity, l_discount, l_tax from ranked join hits using (r))"""


@query("forest_train_global", _train_sql(_BAGGED, 2, "forest"))
def forest_train_global(t: Tables) -> DataFrame:
    return _node_rows(t, train.train_forest(t.li, "cls", ["id"], ATTRS, [], n_trees=5, max_depth=2))


_PARTS = f"""split as (select id, cls, l_quantity, l_discount, l_tax, cast(floor({u_sql('forest-bag-part', 'id')} * 2) as integer) as grp from {LI_SQL}),
ranked as materialized (select *, row_number() over (partition by grp order by {u_sql('forest-bag-rank', 'id')}, id) - 1 as r, count(*) over (partition by grp) as size from split),
hits as (select grp, tree, cast(floor({u_sql('forest-bag', 'tree', 'r')} * size) as bigint) as r, count(*) as w
 from ranked join (select unnest([0, 0, 0, 1, 1]) as grp, unnest(range(0, 5)) as tree) using (grp) group by 1, 2, 3),
rows0 as materialized (select tree, 0 as node, w, case when cls = 'pos' then 1 else 0 end as y, l_quantity, l_discount, l_tax from ranked join hits using (grp, r))"""


@query("forest_train_partitioned", _train_sql(_PARTS, 2, "forest"))
def forest_train_partitioned(t: Tables) -> DataFrame:
    return _node_rows(t, train.train_forest(t.li, "cls", ["id"], ATTRS, [], n_trees=5, mode="partitioned", partitions=2, max_depth=2))


@query("forest_partition_counts", f"""select cast(floor({u_sql('forest-bag-part', 'id')} * 2) as integer) as grp, cls, count(*) as n from {LI_SQL} group by all""")
def forest_partition_counts(t: Tables) -> DataFrame:
    return train.partition_class_counts(t.li, "cls", ["id"], 2)


@query("forest_balanced_metrics")
def forest_balanced_metrics(t: Tables) -> DataFrame:
    """Balance, train with binned numbers and categories, score the original rows, evaluate."""
    from ..operators import balance

    rows = t.lab
    balanced = balance.random_oversample(rows, "toxic", ["doc_id"])
    forest = train.train_forest(
        balanced, "toxic", ["doc_id", "copy_key"], ["n_chars"], ["lang", "source"], n_trees=10, max_depth=4, max_bins=64
    )
    scored = model.score(rows, forest, ["doc_id"], "toxic")
    return evaluate.imbalance_metrics(scored, "toxic", "prediction")


@query("forest_stats", f"""with nodes as ({_train_sql(_BAGGED, 2, "forest")}),
per_tree as (select tree, count(*) as nodes, max(floor(log2(node + 1))) as depth from nodes group by tree)
select count(*) as trees, sum(nodes)::BIGINT as nodes, avg(nodes)::DOUBLE as mean_nodes, avg(depth)::DOUBLE as mean_depth from per_tree""")
def forest_stats(t: Tables) -> DataFrame:
    forest = train.train_forest(t.li, "cls", ["id"], ATTRS, [], n_trees=5, max_depth=2)
    return model.statistics(forest.table(t.spark))


@query("forest_train_regression")
def forest_train_regression(t: Tables) -> DataFrame:
    forest = train.train_forest(
        t.part, "p_retailprice", ["p_partkey"], ["p_size", "p_partkey"], ["p_brand"], n_trees=3, max_depth=3,
        max_bins=128, regression=True,
    )
    scored = model.predict(t.part, forest, ["p_partkey"])
    return evaluate.regression_report(scored, "p_retailprice", "prediction")


def _gini(a: str, b: str) -> str:
    return f"(case when ({a}) + ({b}) > 0 then ({a}) + ({b}) - (({a})::DOUBLE * ({a}) + ({b})::DOUBLE * ({b})) / (({a}) + ({b})) else 0 end)"


@query("num_split_gini", f"""with b as (select *, case when cls = 'pos' then 1 else 0 end as y from {LI_SQL}), v as ({_unpivot(NUMBERS, 'double', 'y', 'b')}),
{_num_sql('').replace(_imp('tp', 'tn'), _gini('tp', 'tn')).replace(_imp('lp', 'ln_'), _gini('lp', 'ln_')).replace(_imp('tp - lp', 'tn - ln_'), _gini('tp - lp', 'tn - ln_'))}
select attr, split, {r6_sql('gain', 9)} as gain from best""")
def num_split_gini(t: Tables) -> DataFrame:
    return split.numeric_split(t.li, NUMBERS, "cls", criterion=split.GiniTarget).withColumn("gain", r6("gain", 9))


def _grown_sql(m: int, min_split: int, min_gain: float, retry: bool, imp=_imp) -> str:
    """A whole tree over labelled documents: every round moves the rows of the open nodes one level down."""
    label = f"""case when p > n then '1' when n > p then '0' when {u_sql('forest', "'label'", '0', 'node', "'1'")} > {u_sql('forest', "'label'", '0', 'node', "'0'")} then '1' else '0' end"""
    again = f"when gain < {min_gain!r} and len(used) < 2 then 'retry'" if retry else ""
    return f"""with recursive lab as materialized {LAB_SQL},
codes as materialized (select attr, value, row_number() over (partition by attr order by value) - 1 as code
 from (select distinct 'lang' as attr, lang as value from lab union all select distinct 'source', source from lab)),
g as (
 select 0 as round, doc_id, 0::BIGINT as node, 0 as depth, (toxic = '1')::INTEGER as y, n_chars, lang, source, []::VARCHAR[] as used,
  '' as path, '0' as label, true as open, 1::BIGINT as base from lab
 union all (with o as (select * from g where open), b as (select greatest(max(base), max(node) + 1) as base, max(round) + 1 as round from g),
 att as (select * from (select node, attr, row_number() over (partition by node order by {u_sql('forest', '0', 'node', 'attr')}, attr) as rank
  from (select distinct node, used from o), (select unnest(['n_chars', 'lang', 'source']) as attr) where not list_contains(used, attr)) where rank <= {m}),
 nh as (select node, n_chars as value, sum(y) as p, sum(1 - y) as n from o group by node, n_chars),
 nc as (select *, sum(p) over w - p as lp, sum(n) over w - n as ln_, sum(p) over t as tp, sum(n) over t as tn from nh
  window w as (partition by node order by value), t as (partition by node)),
 nb as (select node, 'n_chars' as attr, value as split, gain, lp + ln_ as low, tp + tn - lp - ln_ as high, 0 as big from (
  select *, ({imp('tp', 'tn')} - {imp('lp', 'ln_')} - {imp('tp - lp', 'tn - ln_')}) / (tp + tn) as gain from nc)
  qualify row_number() over (partition by node order by round(gain, 9) desc, value) = 1),
 ch as (select node, 'lang' as attr, lang as value, sum(y) as p, sum(1 - y) as n from o group by node, lang
  union all select node, 'source', source, sum(y), sum(1 - y) from o group by node, source),
 cb as (select node, attr, null::DOUBLE, ({imp('sum(p)', 'sum(n)')} - sum({imp('p', 'n')})) / sum(p + n), 0, 0, count(*) filter (p + n >= {min_split}) from ch group by node, attr),
 best as (select * from (select * from nb union all select * from cb) join att using (node, attr)
  qualify row_number() over (partition by node order by round(gain, 9) desc, rank) = 1),
 whole as (select node, any_value(used) as used, sum(y) as tp, sum(1 - y) as tn from o group by node),
 kinds as (select *, case when tp = 0 or tn = 0 or len(used) >= 3 then 'leaf' {again} when gain < {min_gain!r} then 'leaf'
  when attr = 'n_chars' then case when low >= {min_split} and high >= {min_split} then 'numeric' else 'leaf' end
  when big >= 2 then 'categorical' else 'leaf' end as kind from best join whole using (node)),
 spans as (select *, case kind when 'numeric' then 2 when 'categorical' then (select count(*) from codes c where c.attr = kinds.attr) else 0 end as span from kinds),
 placed as (select *, (sum(span) over (order by node) - span)::BIGINT as place from spans),
 moved as (select b.round, o.doc_id, o.depth + (kind <> 'retry')::INTEGER as depth, o.y, o.n_chars, o.lang, o.source, b.base, kind, k.attr,
  case kind when 'numeric' then b.base + place + (case when o.n_chars < k.split then 0 else 1 end) when 'categorical' then b.base + place + c.code else o.node end as node,
  case kind when 'numeric' then list_filter(o.used, lambda a: a <> 'n_chars') else list_append(o.used, k.attr) end as used,
  o.path || case kind when 'numeric' then k.attr || (case when o.n_chars < k.split then ' < ' else ' >= ' end) || k.split::VARCHAR || ' -> '
   when 'categorical' then k.attr || ' = ' || c.value || ' -> ' else '' end as path
  from o join placed k on o.node = k.node join b on true
  left join codes c on c.attr = k.attr and c.value = case k.attr when 'lang' then o.lang else o.source end and kind = 'categorical' where kind <> 'leaf'),
 counted as (select *, sum(y) over (partition by node) as p, sum(1 - y) over (partition by node) as n from moved)
 select round, doc_id, node, depth, y, n_chars, lang, source, used, path, {label} as label, kind = 'retry' or (p > 0 and n > 0 and len(used) < 3) as open, base from counted))
select doc_id, label as prediction, depth, path from g qualify row_number() over (partition by doc_id order by round desc) = 1"""


def _grown(t: Tables, forest: nodes.ForestTable) -> DataFrame:
    found = nodes.leaves(t.lab, forest, ["doc_id"])
    return found.select("doc_id", F.col("label").alias("prediction"), "depth", "path")


@query("tree_unbounded", _grown_sql(3, 2, 1e-6, False))
def tree_unbounded(t: Tables) -> DataFrame:
    """A tree with categories, grown to its own stop rules, its leaves found by joins with the node tables."""
    return _grown(t, train.grow_tree(t.lab, "toxic", ["doc_id"], ["n_chars"], ["lang", "source"], m=3))


@query("tree_simple", _grown_sql(1, 1, 1e-12, True))
def tree_simple(t: Tables) -> DataFrame:
    """The plain builder: one attribute a node, others drawn when it changes nothing."""
    return _grown(t, train.grow_simple_tree(t.lab, "toxic", ["doc_id"], ["n_chars"], ["lang", "source"]))


@query("tree_gini", _grown_sql(2, 2, 1e-6, False, _gini))
def tree_gini(t: Tables) -> DataFrame:
    """The same builder under another split criterion."""
    return _grown(t, train.grow_tree(t.lab, "toxic", ["doc_id"], ["n_chars"], ["lang", "source"], m=2, criterion=split.GiniTarget))
