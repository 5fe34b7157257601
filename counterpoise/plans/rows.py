"""Queries on scans, schema, filters, samples, aggregates, entropy and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import draw
from ..functions.info import llr, llr_sql
from ..operators import aggregate, entropy, evaluate, sample, schema
from ..operators.schema import Roles
from ..session import new_path
from ..sources import io
from .base import CP_SQL, LI_SQL, Tables, query, r6, r6_sql, u_sql

LINE_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _lines(t: Tables) -> DataFrame:
    """Customers as text lines; a negative balance is written as missing."""
    balance = F.when(F.col("c_acctbal") < 0, F.lit("?")).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return t.customer.select(F.concat_ws(",", "c_custkey", "c_nationkey", balance, "c_mktsegment").alias("value"))


@query("parse_delimited", """select c_custkey::VARCHAR as c_custkey, c_acctbal, c_mktsegment
 from customer where c_acctbal >= 0""")
def parse_delimited(t: Tables) -> DataFrame:
    roles = Roles("c_mktsegment", numeric=["c_acctbal"], categorical=["c_custkey"], ignored=["c_nationkey"])
    return io.parse_delimited(_lines(t), LINE_COLUMNS, roles).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("text_round_trip", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal, c_mktsegment from customer where c_acctbal >= 0")
def text_round_trip(t: Tables) -> DataFrame:
    """Rows written as delimited text, read again with their types; rows with a missing value stay behind."""
    path = new_path(t.spark, "text-rows")
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    io.write_text_rows(rows, path, rows.columns)
    roles = Roles("c_mktsegment", numeric=["c_acctbal"], categorical=["c_custkey"])
    read = io.read_delimited(t.spark, path, rows.columns, roles)
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal", "c_mktsegment")


@query("lines_without_header", """select n_regionkey::BIGINT as n_regionkey, count(*) as n from nation group by 1""")
def lines_without_header(t: Tables) -> DataFrame:
    """Lines of files that each start with a header, which is dropped in every file."""
    path = new_path(t.spark, "headed-rows")
    io.write(t.nation.select("n_nationkey", "n_regionkey").repartition(3), path, fmt="csv", header=True)
    lines = io.read_lines(t.spark, path, skip_header=True)
    region = F.split("value", ",")[1].cast("long")
    return lines.groupBy(region.alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@query("inverse_dictionary", """with d as (select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part))
select p_partkey, (p_partkey % 30)::INTEGER as code, b as value from part left join (select code as c, p_brand as b from d) on p_partkey % 30 = c""")
def inverse_dictionary(t: Tables) -> DataFrame:
    """Values of given codes; codes beyond the dictionary have none."""
    terms = schema.dictionary(t.part, ["p_brand"]).select("code", "value")
    asked = t.part.select("p_partkey", (F.col("p_partkey") % 30).cast("int").alias("code"))
    return io.inverse_dictionary(terms, asked, "code").select("p_partkey", "code", "value")


@query("split_records", """select c_custkey::VARCHAR as first, 4::BIGINT as items, 1::BIGINT as n from customer""")
def split_records(t: Tables) -> DataFrame:
    rows = io.split_records(_lines(t), "[, ]")
    return rows.select(F.col("items")[0].alias("first"), F.size("items").cast("long").alias("items"), "n")


@query("record_scan", "select o_orderkey, o_custkey, o_orderstatus from orders")
def record_scan(t: Tables) -> DataFrame:
    return io.read_records(t.spark, t.path, glob="orders.parquet", columns=["o_orderkey", "o_custkey", "o_orderstatus"])


@query("count_records", "select count(*) as n from lineitem")
def count_records(t: Tables) -> DataFrame:
    return io.count_records(t.lineitem)


@query("vector_dimension", "select max(len(embedding)) as dimension from embeddings")
def vector_dimension(t: Tables) -> DataFrame:
    return io.vector_dimension(t.embeddings, "embedding")


@query("matrix_entries", f"""select vec_id as "row", i - 1 as col, {r6_sql('embedding[i]')} as val
 from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) where embedding[i] <> 0""")
def matrix_entries(t: Tables) -> DataFrame:
    return io.dense_to_entries(t.emb, "vec_id", "vec").withColumn("val", r6("val"))


LI_ROLES = Roles("cls", numeric=["l_quantity"], categorical=["l_returnflag", "l_linestatus"])


@query("describe", f"""with b as (select * from {LI_SQL})
select attr, value, (select count(*) from b) as n_rows from (
 select distinct 'l_returnflag' as attr, l_returnflag as value from b
 union all select distinct 'l_linestatus', l_linestatus from b union all select distinct 'cls', cls from b)""")
def describe(t: Tables) -> DataFrame:
    return schema.describe(t.li, LI_ROLES)


@query("describe_text_rows", """with b as (select * from customer where c_acctbal >= 0)
select 'c_mktsegment' as attr, c_mktsegment as value, (select count(*) from b) as n_rows from (select distinct c_mktsegment from b)""")
def describe_text_rows(t: Tables) -> DataFrame:
    rows = _lines(t).select(F.split("value", ",").alias("t"))
    rows = rows.select(*[F.col("t")[i].alias(c) for i, c in enumerate(LINE_COLUMNS)])
    return schema.describe(rows, Roles("c_mktsegment", numeric=["c_acctbal"]))


@query("encode", """with d as (select p_brand, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part where p_size > 1))
select p_partkey, coalesce(code, -1)::INTEGER as p_brand from part left join d using (p_brand)""")
def encode(t: Tables) -> DataFrame:
    codes = schema.dictionary(t.part.where(F.col("p_size") > 1), ["p_brand"])
    return schema.encode_categories(t.part.select("p_partkey", "p_brand"), ["p_brand"], codes)


@query("decode", """with d as (select p_type, row_number() over (order by p_type) - 1 as code from (select distinct p_type from part))
select p_partkey, coalesce(p_type, 'unknown') as kind from (select p_partkey, p_size % 8 as code from part) left join d using (code)""")
def decode(t: Tables) -> DataFrame:
    codes = schema.dictionary(t.part.select(F.col("p_type").alias("kind")), ["kind"])
    return schema.decode_categories(t.part.select("p_partkey", (F.col("p_size") % 8).alias("kind")), ["kind"], codes)


@query("missing_filter", """select l_orderkey, l_linenumber, l_quantity from lineitem where l_discount <> 0""")
def missing_filter(t: Tables) -> DataFrame:
    holes = t.lineitem.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    rows = schema.valid_rows(holes, Roles("l_returnflag", ["l_quantity", "l_discount"], ignored=["l_tax"]))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


for _op, _sign in (("eq", "="), ("lt", "<"), ("ge", ">=")):

    @query(f"subset_{_op}", f"select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity {_sign} 25")
    def subset(t: Tables, op: str = _op) -> DataFrame:
        return schema.subset(t.lineitem, "l_quantity", op, 25).select("l_orderkey", "l_linenumber", "l_quantity")


@query("membership", """select c_custkey, c_nationkey from customer c where exists (
 select 1 from supplier s where s.s_nationkey = c.c_nationkey and s.s_suppkey = c.c_custkey)""")
def membership(t: Tables) -> DataFrame:
    other = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return schema.contained(t.customer.select("c_custkey", "c_nationkey"), other, ["c_custkey", "c_nationkey"])


@query("labels_and_features", f"select l_quantity, l_returnflag, l_linestatus from {LI_SQL}")
def labels_and_features(t: Tables) -> DataFrame:
    return schema.features(t.li, LI_ROLES)


# samples

BOOT = f"""ranked as materialized (select *, row_number() over (order by {u_sql('bootstrap-rank', 'o_orderkey')}, o_orderkey) - 1 as r from orders),
drawn as (select cast(floor({u_sql('bootstrap', '0', 'r')} * (select count(*) from orders)) as bigint) as r, count(*) as copies from ranked group by 1)"""


@query("bootstrap", f"with {BOOT} select o_orderkey, o_totalprice, copies from ranked join drawn using (r)")
def bootstrap(t: Tables) -> DataFrame:
    return sample.bootstrap(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("out_of_bag", f"with {BOOT} select o_orderkey from ranked where r not in (select r from drawn)")
def out_of_bag(t: Tables) -> DataFrame:
    return sample.out_of_bag(t.orders.select("o_orderkey"), ["o_orderkey"])


SPLIT = f"select o_orderkey, row_number() over (order by {u_sql('split', 'o_orderkey')}, o_orderkey) <= 5000 as taken from orders"


@query("random_split", f"select o_orderkey from ({SPLIT}) where taken")
def random_split(t: Tables) -> DataFrame:
    return sample.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], 5000)[0]


@query("random_split_rest", f"select o_orderkey from ({SPLIT}) where not taken")
def random_split_rest(t: Tables) -> DataFrame:
    return sample.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], 5000)[1]


@query("bernoulli_sample", f"select o_orderkey, o_totalprice from orders where {u_sql('bernoulli', 'o_orderkey')} < 0.1")
def bernoulli_sample(t: Tables) -> DataFrame:
    return sample.bernoulli_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.1)


@query("reservoir", f"select o_orderkey, o_totalprice from orders order by {u_sql('reservoir', 'o_orderkey')}, o_orderkey limit 1000")
def reservoir(t: Tables) -> DataFrame:
    return sample.fixed_size_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


@query("reservoir_stable", f"""select o_orderkey, row_number() over (order by o_orderkey) as place from (
 select o_orderkey from orders order by {u_sql('reservoir', 'o_orderkey')}, o_orderkey limit 1000)""")
def reservoir_stable(t: Tables) -> DataFrame:
    picked = sample.fixed_size_sample(t.orders.select("o_orderkey"), ["o_orderkey"], 1000, stable=True)
    ranked = sample.row_numbers(picked, ["o_orderkey"])
    return ranked.select("o_orderkey", (F.col("rank") + 1).alias("place"))


@query("row_entry_sample", f"""select "row", col, val from (select *, row_number() over (
 partition by "row" order by {u_sql('entries', '"row"', 'col')}, col) as k from {CP_SQL}) where k <= 10""")
def row_entry_sample(t: Tables) -> DataFrame:
    return sample.sample_row_entries(t.cp, 10)


@query("stratified_partition", f"""select id, cls, (row_number() over (partition by cls order by {u_sql('stratify', 'id')}, id) - 1
  + cast(floor({u_sql('stratify-start', 'cls')} * 7) as bigint)) % 7 as part from {LI_SQL}""")
def stratified_partition(t: Tables) -> DataFrame:
    return sample.stratified_partition(t.li.select("id", "cls"), "cls", ["id"], 7)


@query("multinomial", f"""with w as (select p_partkey, p_retailprice as w from part), t as (select sum(w) as s from w),
units as (select p_partkey, round(w / s * 1e15::DOUBLE)::BIGINT as n from w, t),
run as (select p_partkey, sum(n) over (order by p_partkey) as hi, n from units), tot as (select sum(n)::BIGINT as s from units),
cells as (select p_partkey, (hi - n)::BIGINT::DOUBLE / s as lo, hi::BIGINT::DOUBLE / s as hi from run, tot)
select o_orderkey, p_partkey from (select o_orderkey, {u_sql('multi', 'o_orderkey')} as d from orders) o
 join cells on o.d >= cells.lo and o.d < cells.hi""")
def multinomial(t: Tables) -> DataFrame:
    draws = t.orders.select("o_orderkey", draw.u("multi", "o_orderkey").alias("d"))
    return sample.multinomial_sample(draws, "d", t.part, "p_partkey", "p_retailprice").select("o_orderkey", "p_partkey")


@query("interleave", f"""with r as (select id, cls, row_number() over (partition by cls order by {u_sql('interleave', 'id')}, id) - 1 as k from {LI_SQL}),
s as (select min(n) as short from (select count(*) as n from r group by cls))
select id, cls, case when k < short then 2 * k + case when cls = 'pos' then 0 else 1 end else k + short end as place from r, s""")
def interleave(t: Tables) -> DataFrame:
    return sample.interleave_classes(t.li.select("id", "cls"), "cls", ["id"], "pos")


_G = f"sqrt(-2 * ln((({u_sql('gr', 'o_orderkey')} * 4503599627370496 + 0.5) / 4503599627370496::DOUBLE))) * cos(2 * pi() * {u_sql('ga', 'o_orderkey')})"


@query("random_columns", f"""select o_orderkey, {u_sql('a', 'o_orderkey')} as half_open,
 ({u_sql('b', 'o_orderkey')} * 4503599627370496 + 0.5::DOUBLE) / 4503599627370496::DOUBLE as open,
 ({u_sql('c', 'o_orderkey')} * 4503599627370496) / 4503599627370495::DOUBLE as closed,
 cast(floor({u_sql('i', 'o_orderkey')} * 10) as bigint) + 1 as whole, {r6_sql(_G)} as normal,
 {r6_sql(f"case when {u_sql('ts', 'o_orderkey')} <= 0.25::DOUBLE then sqrt({u_sql('th', 'o_orderkey')}) else 4 - 3 * sqrt({u_sql('th', 'o_orderkey')}) end")} as triangle
from orders""")
def random_columns(t: Tables) -> DataFrame:
    k = "o_orderkey"
    return t.orders.select(
        k, draw.u("a", k).alias("half_open"), draw.u_open("b", k).alias("open"), draw.u_closed("c", k).alias("closed"),
        draw.integer("i", 0, 11, k, closed_low=False).alias("whole"), r6(draw.gaussian("g", k)).alias("normal"),
        r6(draw.triangular("t", 0.0, 1.0, 4.0, k)).alias("triangle"),
    )


# aggregates

@query("count_keys", "select l_returnflag, count(*) as n from lineitem group by all")
def count_keys(t: Tables) -> DataFrame:
    return aggregate.count_by(t.lineitem, "l_returnflag")


@query("count_pairs", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def count_pairs(t: Tables) -> DataFrame:
    return aggregate.count_by(t.lineitem, "l_returnflag", "l_linestatus")


@query("sum_doubles", "select o_custkey, round(sum(o_totalprice), 2) as total from orders group by all")
def sum_doubles(t: Tables) -> DataFrame:
    return aggregate.sum_by(t.orders, "o_custkey", "o_totalprice").withColumn("total", F.round("total", 2))


@query("vector_sum", f"""select label, i - 1 as col, {r6_sql('sum(embedding[i]::DOUBLE)')} as val from (
 select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all""")
def vector_sum(t: Tables) -> DataFrame:
    cells = t.emb.select("label", F.posexplode("vec").alias("col", "val")).withColumn("col", F.col("col").cast("long"))
    return aggregate.vector_sum(cells, "label").withColumn("val", r6("val"))


@query("merge_vectors", """select o_custkey, l_partkey as col, arg_max(l_quantity, (l_orderkey, l_linenumber, l_suppkey)) as val
 from lineitem join orders on l_orderkey = o_orderkey group by all""")
def merge_vectors(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", F.col("l_partkey").alias("col"), F.col("l_quantity").alias("val"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("version"),
    )
    parts = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    packed = aggregate.pack_vectors(aggregate.merge_vectors(parts, "o_custkey", "version"), "o_custkey")
    return aggregate.unpack_vectors(packed, "o_custkey")


@query("partition_frequencies", f"""with b as (select *, cast(floor({u_sql('p', 'id')} * 5) as integer) as part from {LI_SQL}),
g as (select * from (select distinct part from b), (select distinct l_returnflag from b))
select g.part, g.l_returnflag, count(b.id) as n from g left join b using (part, l_returnflag) group by all""")
def partition_frequencies(t: Tables) -> DataFrame:
    dealt = t.li.withColumn("part", draw.bucket("p", F.lit(5), "id"))
    return aggregate.partition_frequencies(dealt, "part", "l_returnflag")


@query("majority_label", f"""with c as (select l_suppkey, l_returnflag, count(*) as n from lineitem group by all)
select l_suppkey, arg_max(l_returnflag, (n, {u_sql('majority', 'l_suppkey', 'l_returnflag')})) as majority,
 max(n) as n, sum(n)::BIGINT as total from c group by l_suppkey""")
def majority_label(t: Tables) -> DataFrame:
    return aggregate.majority_label(t.lineitem, ["l_suppkey"], "l_returnflag")


@query("label_uniformity", """select l_orderkey, case when count(distinct l_returnflag) = 1 then 1 else 0 end as same_label,
 case when count(distinct (l_quantity, l_tax)) = 1 then 1 else 0 end as same_rows from lineitem group by l_orderkey""")
def label_uniformity(t: Tables) -> DataFrame:
    return aggregate.label_uniformity(t.lineitem, ["l_orderkey"], "l_returnflag", ["l_quantity", "l_tax"])


@query("distinct_values", "select distinct l_quantity from lineitem")
def distinct_values(t: Tables) -> DataFrame:
    return aggregate.distinct_values(t.lineitem, "l_quantity")


@query("variance", f"""select l_returnflag, count(*) as n, {r6_sql('avg(l_extendedprice)', 3)} as mean,
 {r6_sql('var_samp(l_extendedprice)', 2)} as variance, {r6_sql('stddev_samp(l_extendedprice)', 3)} as stddev
 from lineitem where l_linenumber <> -1 group by all""")
def variance(t: Tables) -> DataFrame:
    found = aggregate.variance(aggregate.ignore_marker(t.lineitem, "l_linenumber"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "n", r6("mean", 3).alias("mean"), r6("variance", 2).alias("variance"), r6("stddev", 3).alias("stddev"))


@query("variance_given_mean", f"""select l_returnflag, count(*) as n, {r6_sql('(sum(l_quantity * l_quantity) - count(*) * 625.0) / (count(*) - 1)')} as variance,
 {r6_sql('sqrt((sum(l_quantity * l_quantity) - count(*) * 625.0) / (count(*) - 1))')} as stddev from lineitem group by all""")
def variance_given_mean(t: Tables) -> DataFrame:
    found = aggregate.variance_given_mean(t.lineitem, ["l_returnflag"], "l_quantity", 25.0)
    return found.withColumns({c: r6(c) for c in ("variance", "stddev")})


@query("column_means", f"""with m as (select * from {CP_SQL})
select col, {r6_sql('sum(val) / (select count(distinct "row") from m)')} as mean from m group by col""")
def column_means(t: Tables) -> DataFrame:
    return aggregate.column_means(t.cp).withColumn("mean", r6("mean"))


# entropy

def _h(counts: str) -> str:
    return f"(select (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(2) from ({counts}))"


_PAIRS = "pairs as (select l_returnflag as k, l_linenumber as v, count(*) as n from lineitem group by all)"
_HV = _h("select v, sum(n) as n from pairs group by v")
_HK = _h("select k, sum(n) as n from pairs group by k")
_COND = "(select sum(s * ln(s) - c) / (sum(s) * ln(2)) from (select k, sum(n) as s, sum(n * ln(n)) as c from pairs group by k))"


@query("entropy_key", f"select {r6_sql(_h('select count(*) as n from lineitem group by l_returnflag'))} as entropy")
def entropy_key(t: Tables) -> DataFrame:
    return entropy.entropy(t.lineitem, "l_returnflag").withColumn("entropy", r6("entropy"))


@query("entropy_value", f"select {r6_sql(_h('select count(*) as n from lineitem group by l_partkey'))} as entropy")
def entropy_value(t: Tables) -> DataFrame:
    return entropy.entropy(t.lineitem, "l_partkey").withColumn("entropy", r6("entropy"))


@query("specific_cond_entropy", f"""with {_PAIRS} select k as l_returnflag,
 {r6_sql('(s * ln(s) - c) / ((select sum(n) from pairs) * ln(2))')} as entropy
 from (select k, sum(n) as s, sum(n * ln(n)) as c from pairs group by k)""")
def specific_cond_entropy(t: Tables) -> DataFrame:
    found = entropy.specific_conditional_entropy(t.lineitem, "l_returnflag", "l_linenumber")
    return found.withColumn("entropy", r6("entropy"))


@query("cond_entropy", f"with {_PAIRS} select {r6_sql(_COND)} as entropy")
def cond_entropy(t: Tables) -> DataFrame:
    return entropy.conditional_entropy(t.lineitem, "l_returnflag", "l_linenumber").withColumn("entropy", r6("entropy"))


_EV = "pairs as (select user_id as k, event_type as v, count(*) as n from events group by all)"


@query("info_gain", f"with {_EV} select {r6_sql(_HV)} as entropy, {r6_sql(_COND)} as conditional, {r6_sql(f'{_HV} - {_COND}')} as gain")
def info_gain(t: Tables) -> DataFrame:
    found = entropy.information_gain(t.events, "user_id", "event_type")
    return found.select(*[r6(c).alias(c) for c in ("entropy", "conditional", "gain")])


@query("info_gain_ratio", f"with {_EV} select {r6_sql(f'({_HV} - {_COND}) / {_HV}')} as ratio, {r6_sql(f'({_HV} - {_COND}) / {_HK}')} as ratio_key")
def info_gain_ratio(t: Tables) -> DataFrame:
    by_key = entropy.information_gain(t.events, "user_id", "event_type", split_info="key").select("ratio").scalar()
    found = entropy.information_gain(t.events, "user_id", "event_type")
    return found.select(r6("ratio").alias("ratio"), r6(by_key).alias("ratio_key"))


_T = "a::DOUBLE", "b::DOUBLE", "c::DOUBLE", "d::DOUBLE"


@query("llr_2x2", f"""with s as (select l_suppkey, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag <> 'R') as b from lineitem group by 1),
w as (select l_suppkey, a, b, (select sum(a) from s) - a as c, (select sum(b) from s) - b as d from s)
select l_suppkey, {r6_sql(llr_sql(*_T), 4)} as llr from w""")
def llr_2x2(t: Tables) -> DataFrame:
    r = F.col("l_returnflag") == "R"
    s = t.lineitem.groupBy("l_suppkey").agg(F.count_if(r).alias("a"), F.count_if(~r).alias("b"))
    c, d = s.agg(F.sum("a")).scalar() - F.col("a"), s.agg(F.sum("b")).scalar() - F.col("b")
    return s.select("l_suppkey", r6(llr(F.col("a"), F.col("b"), c, d), 4).alias("llr"))


# evaluation

PRED_SQL = f"""(select *, case when l_discount = 0 then null when l_quantity > 25 then 'pos' else 'neg' end as predicted from {LI_SQL})"""


def _pred(t: Tables) -> DataFrame:
    said = F.when(F.col("l_discount") != 0, F.when(F.col("l_quantity") > 25, "pos").otherwise("neg"))
    return t.li.withColumn("predicted", said)


_COUNTS = f"c as (select cls as actual, coalesce(predicted, 'unknown') as predicted, count(*) as n from {PRED_SQL} group by all)"
_NAMES = "(select actual as l from c union select predicted from c union select 'unknown')"


@query("confusion", f"""with {_COUNTS} select a.l as actual, p.l as predicted, coalesce(n, 0) as n from {_NAMES} a, {_NAMES} p
 left join c on c.actual = a.l and c.predicted = p.l""")
def confusion(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(_pred(t), "cls", "predicted")


@query("confusion_merged", f"""with {_COUNTS} select actual, predicted, 2 * n as n from c""")
def confusion_merged(t: Tables) -> DataFrame:
    counts = evaluate.confusion_counts(_pred(t), "cls", "predicted")
    return evaluate.merge_confusion(counts, counts)


@query("label_accuracy", f"""with {_COUNTS} select actual, coalesce(sum(n) filter (actual = predicted), 0)::BIGINT as correct, sum(n)::BIGINT as total,
 {r6_sql('100.0 * sum(n) filter (actual = predicted) / sum(n)')} as accuracy from c group by actual""")
def label_accuracy(t: Tables) -> DataFrame:
    return evaluate.label_accuracy(_pred(t), "cls", "predicted").withColumn("accuracy", r6("accuracy"))


@query("accuracy", f"""with {_COUNTS}, s as (select sum(n) filter (actual = predicted)::BIGINT as r, sum(n)::BIGINT as t from c)
select r as correct, t - r as incorrect, t as total, {r6_sql('100.0 * r / t')} as pct_correct, {r6_sql('100.0 * (t - r) / t')} as pct_incorrect from s""")
def accuracy(t: Tables) -> DataFrame:
    return evaluate.accuracy(_pred(t), "cls", "predicted").withColumns({c: r6(c) for c in ("pct_correct", "pct_incorrect")})


@query("imbalance_metrics", f"""with {_COUNTS}, k as (select * from c where predicted <> 'unknown'),
p as (select actual as positive from k group by actual order by sum(n), actual limit 1),
m as (select positive, coalesce(sum(n) filter (actual = positive and predicted = positive), 0)::BIGINT as tp,
 coalesce(sum(n) filter (actual = positive and predicted <> positive), 0)::BIGINT as fn,
 coalesce(sum(n) filter (actual <> positive and predicted = positive), 0)::BIGINT as fp,
 coalesce(sum(n) filter (actual <> positive and predicted <> positive), 0)::BIGINT as tn from k, p group by positive),
r as (select *, tp / (tp + fn) as tpr, tn / (tn + fp) as tnr, tp / (tp + fp) as pr from m)
select positive, tp, fn, fp, tn, {r6_sql('tpr')} as tpr, {r6_sql('tnr')} as tnr, {r6_sql('pr')} as "precision",
 {r6_sql('(1 + tpr - (1 - tnr)) / 2')} as auc, {r6_sql('sqrt(tpr * tnr)')} as gm, {r6_sql('2 * pr * tpr / (pr + tpr)')} as f_measure from r""")
def imbalance_metrics(t: Tables) -> DataFrame:
    found = evaluate.imbalance_metrics(_pred(t), "cls", "predicted")
    return found.withColumns({c: r6(c) for c in ("tpr", "tnr", "precision", "auc", "gm", "f_measure")})


@query("regression_report", f"""with b as (select l_extendedprice as a, case when l_discount <> 0 then l_quantity * 2000 end as p from lineitem)
select {r6_sql('corr(a, p)')} as correlation, {r6_sql('avg(abs(a - p))', 3)} as mae, {r6_sql('sqrt(avg((a - p) * (a - p)))', 3)} as rmse,
 count(p) as predictable, count(*) - count(p) as unpredictable, count(*) as total from b""")
def regression_report(t: Tables) -> DataFrame:
    said = F.when(F.col("l_discount") != 0, F.col("l_quantity") * 2000)
    found = evaluate.regression_report(t.lineitem.withColumn("p", said), "l_extendedprice", "p")
    return found.withColumns({"correlation": r6("correlation"), "mae": r6("mae", 3), "rmse": r6("rmse", 3)})


@query("error_rate", f"""with b as (select case when l_returnflag = 'R' then 1 else 0 end as a,
 case when l_discount = 0 then -1 when l_quantity > 25 then 1 else 0 end as p from lineitem)
select {r6_sql('avg(case when a <> p then 1.0 else 0.0 end)')} as error, count(*) as n from b where p <> -1""")
def error_rate(t: Tables) -> DataFrame:
    a = (F.col("l_returnflag") == "R").cast("int").alias("a")
    p = F.when(F.col("l_discount") == 0, -1).otherwise((F.col("l_quantity") > 25).cast("int")).alias("p")
    return evaluate.error_rate(t.lineitem.select(a, p), "a", "p").withColumn("error", r6("error"))


_P1, _P2 = "(l_quantity / 200)", "(l_discount * 5)"
_LL = f"""(select l_orderkey, l_linenumber, l_suppkey, greatest(-100::DOUBLE, ln(greatest(case l_returnflag when 'A' then 1 - ({_P1} + {_P2}) when 'N' then {_P1}
 else {_P2} end, 1e-300::DOUBLE))) as ll from lineitem)"""


def _ll(t: Tables) -> DataFrame:
    full = evaluate.with_first_category(F.array(F.col("l_quantity") / 200, F.col("l_discount") * 5))
    category = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", evaluate.log_likelihood(full, category).alias("ll"))


@query("log_likelihood", f"select l_orderkey, l_linenumber, l_suppkey, {r6_sql('ll')} as ll from {_LL}")
def log_likelihood(t: Tables) -> DataFrame:
    return _ll(t).withColumn("ll", r6("ll"))


@query("ll_summary", f"""select {r6_sql('avg(ll)')} as mean, {r6_sql('quantile_cont(ll, 0.25)')} as p25,
 {r6_sql('quantile_cont(ll, 0.75)')} as p75 from {_LL}""")
def ll_summary(t: Tables) -> DataFrame:
    return evaluate.log_likelihood_summary(_ll(t), "ll").select(*[r6(c).alias(c) for c in ("mean", "p25", "p75")])
