"""Class balancing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import balance, knn, schema, smote
from .base import LAB_SQL, LI_SQL, Tables, query, r6, r6_sql, u_sql

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]
CATEGORICAL = ["l_linestatus", "l_line"]


@query("class_distribution", f"""
with c as (select toxic, count(*) as n from {LAB_SQL} group by toxic)
select toxic, n,
 case when toxic = (select toxic from c order by n desc, toxic limit 1) then 1 else 0 end as is_majority,
 case when toxic = (select toxic from c order by n, toxic limit 1) then 1 else 0 end as is_minority,
 (select max(n) from c) - n as lack from c""")
def class_distribution(t: Tables) -> DataFrame:
    return balance.class_distribution(t.lab, "toxic")


def _oversample_sql(view: str, label: str, key: str) -> str:
    return f"""
with b as (select * from {view}), c as (select {label} as l, count(*) as n from b group by 1),
f as (select max(n) // min(n) as r from c),
m as (select l from c order by n desc, l limit 1),
k as (select b.{key}, b.{label}, case when lower(b.{label}) = lower(m.l)
  then [floor({u_sql('0-copy', key)} * f.r)::BIGINT] else range(0, f.r::BIGINT) end as ks from b, f, m)
select {key}, {label}, unnest(ks) as copy_key from k"""


@query("oversample_documents", _oversample_sql(LAB_SQL, "toxic", "doc_id"))
def oversample_documents(t: Tables) -> DataFrame:
    return balance.random_oversample(t.lab, "toxic", ["doc_id"]).select("doc_id", "toxic", "copy_key")


@query("oversample", _oversample_sql(LI_SQL, "cls", "id"))
def oversample(t: Tables) -> DataFrame:
    return balance.random_oversample(t.li, "cls", ["id"], negclass="NEG").select("id", "cls", "copy_key")


@query("oversample_fractional", f"""
with b as (select * from {LI_SQL}), c as (select cls as l, count(*) as n from b group by 1),
f as (select max(n) / min(n)::DOUBLE as f, max(n) // min(n) as w from c),
k as (select id, cls, case when cls = 'neg' then 1
  else f.w + case when {u_sql('0-extra', 'id')} < f.f - f.w then 1 else 0 end end as n from b, f)
select id, cls, unnest(range(0, n::BIGINT)) as copy_key from k""")
def oversample_fractional(t: Tables) -> DataFrame:
    return balance.random_oversample(t.li, "cls", ["id"], fractional=True).select("id", "cls", "copy_key")


@query("undersample", f"""
with b as (select * from {LI_SQL}), c as (select cls as l, count(*) as n from b group by 1)
select id, cls, l_quantity from b where cls = 'pos'
 or {u_sql('0-keep', 'id')} < (select min(n) / max(n)::DOUBLE from c)""")
def undersample(t: Tables) -> DataFrame:
    return balance.random_undersample(t.li, "cls", ["id"], posclass="Pos").select("id", "cls", "l_quantity")


# SMOTE on line items: class R against the rest, three numbers and two categories.

BUCKET_SQL = f"""base as materialized (
 select id, cls, l_quantity, l_extendedprice, l_discount, l_linestatus, cast(l_linenumber as varchar) as l_line
 from {LI_SQL}),
mino as materialized (select cls as minority, n as npos, (select max(m) - min(m) from (select count(*) as m from base group by cls)) as lack,
 greatest(1, n // 128) as buckets from (select cls, count(*) as n from base group by cls) order by n, cls limit 1),
split as materialized (select b.*, ((row_number() over (partition by cls order by {u_sql('p', 'id')}, id) - 1) % buckets)::INTEGER as grp
 from base b, mino)"""

VDM_SQL = """cats as (select grp, cls, 'l_linestatus' as attr, l_linestatus as value from split
 union all select grp, cls, 'l_line', l_line from split),
shares as materialized (select grp, attr, value, count(*) filter (cls = 'pos') / count(*)::DOUBLE as pp,
 count(*) filter (cls = 'neg') / count(*)::DOUBLE as pn from cats group by all),
vdm as materialized (select a.grp, a.attr, a.value as a, b.value as b,
 sqrt((a.pn - b.pn) * (a.pn - b.pn) + (a.pp - b.pp) * (a.pp - b.pp)) as distance
 from shares a join shares b on a.grp = b.grp and a.attr = b.attr)"""

CLASS_SQL = """sizes as materialized (select grp, minority, count(*) filter (cls = minority) as npos,
 lack // buckets + case when grp < lack % buckets then 1 else 0 end as lack from split, mino group by grp, minority, lack, buckets)"""

NEAR_SQL = """sigma as materialized (select grp, stddev_pop(l_quantity) as s1, stddev_pop(l_extendedprice) as s2, stddev_pop(l_discount) as s3
 from split group by grp),
asked as (select s.* from split s join sizes z on s.grp = z.grp and s.cls = z.minority and z.lack > 0),
dists as (select q.grp, q.id as qid, d.id as nid, round(sqrt(
   abs(q.l_quantity * s1 / 4 - d.l_quantity * s1 / 4) + abs(q.l_extendedprice * s2 / 4 - d.l_extendedprice * s2 / 4)
   + abs(q.l_discount * s3 / 4 - d.l_discount * s3 / 4) + v.distance + w.distance), 9) as dist
 from asked q join split d on q.grp = d.grp join sigma on sigma.grp = q.grp
 join vdm v on v.grp = q.grp and v.attr = 'l_linestatus' and v.a = q.l_linestatus and v.b = d.l_linestatus
 join vdm w on w.grp = q.grp and w.attr = 'l_line' and w.a = q.l_line and w.b = d.l_line),
near as materialized (select * from (select *, row_number() over (partition by grp, qid order by dist, nid) as rank
  from dists where dist > 0) where rank <= 5)"""

MADE_SQL = f"""ranked as (select a.*, z.npos, z.lack, row_number() over (partition by a.grp order by {u_sql('smote-order', 'id')}, id) - 1 as r
 from asked a join sizes z on a.grp = z.grp),
starts as (select *, unnest(range(r, lack, npos)) as i from ranked where r < lack),
found as (select grp, qid, count(*) as n from near group by all),
chosen as (select s.*, coalesce(n.nid, s.id) as nid from starts s
 left join found f on f.grp = s.grp and f.qid = s.id
 left join near n on n.grp = s.grp and n.qid = s.id
  and n.rank = 1 + floor({u_sql('smote-nn', 's.grp', 's.i')} * f.n)),
made as (select c.grp, c.i, c.id as parent, c.nid as neighbor, c.cls,
 c.l_quantity + {u_sql('smote-gap', 'c.grp', 'c.i')} * (d.l_quantity - c.l_quantity) as l_quantity,
 c.l_extendedprice + {u_sql('smote-gap', 'c.grp', 'c.i')} * (d.l_extendedprice - c.l_extendedprice) as l_extendedprice,
 c.l_discount + {u_sql('smote-gap', 'c.grp', 'c.i')} * (d.l_discount - c.l_discount) as l_discount,
 case when {u_sql('smote-cat-l_linestatus', 'c.grp', 'c.i')} < 0.5 then c.l_linestatus else d.l_linestatus end as l_linestatus,
 case when {u_sql('smote-cat-l_line', 'c.grp', 'c.i')} < 0.5 then c.l_line else d.l_line end as l_line
 from chosen c join split d on d.grp = c.grp and d.id = c.nid)"""


def _rows(t: Tables) -> DataFrame:
    return t.li.select("id", "cls", *NUMERIC, "l_linestatus", F.col("l_linenumber").cast("string").alias("l_line"))


def _split(t: Tables) -> DataFrame:
    return smote.deal_buckets(_rows(t), "cls", "id")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in NUMERIC})


@query("smote_scaled", f"""with {BUCKET_SQL}, b as (select grp, min(l_quantity) a1, max(l_quantity) b1,
 min(l_extendedprice) a2, max(l_extendedprice) b2, min(l_discount) a3, max(l_discount) b3 from split group by grp)
select s.grp, id, {r6_sql('coalesce((l_quantity - a1) / nullif(b1 - a1, 0), l_quantity)')} as l_quantity,
 {r6_sql('coalesce((l_extendedprice - a2) / nullif(b2 - a2, 0), l_extendedprice)')} as l_extendedprice,
 {r6_sql('coalesce((l_discount - a3) / nullif(b3 - a3, 0), l_discount)')} as l_discount
from split s join b on s.grp = b.grp""")
def smote_scaled(t: Tables) -> DataFrame:
    return _rounded(smote.scale_numeric(_split(t), NUMERIC).select("grp", "id", *NUMERIC))


@query("smote_vdm", f"""with {BUCKET_SQL}, {VDM_SQL}
select grp, attr, a, b, {r6_sql('distance')} as distance from vdm""")
def smote_vdm(t: Tables) -> DataFrame:
    return smote.value_difference(_split(t), "cls", CATEGORICAL).withColumn("distance", r6("distance"))


@query("smote_sigma", f"""with {BUCKET_SQL}
select grp, attr, {r6_sql('sigma')} as sigma from (
 select grp, 'l_quantity' as attr, stddev_pop(l_quantity) as sigma from split group by grp
 union all select grp, 'l_extendedprice', stddev_pop(l_extendedprice) from split group by grp
 union all select grp, 'l_discount', stddev_pop(l_discount) from split group by grp)""")
def smote_sigma(t: Tables) -> DataFrame:
    return smote.numeric_sigma(_split(t), NUMERIC).withColumn("sigma", r6("sigma"))


# Neighbours in the whole table.  Rows that are further away in price alone than the fifth nearest of the
# eight before and behind are no neighbours; fewer than five such rows set no limit.
_FAR = """round(sqrt(
   abs(q.l_quantity - d.l_quantity) * s1 / 4 + abs(q.l_extendedprice - d.l_extendedprice) * s2 / 4
   + abs(q.l_discount - d.l_discount) * s3 / 4 + v.distance + w.distance), 9)"""
_VDM_JOIN = """join vdm v on v.attr = 'l_linestatus' and v.a = q.l_linestatus and v.b = d.l_linestatus
 join vdm w on w.attr = 'l_line' and w.a = q.l_line and w.b = d.l_line"""
WHOLE_SQL = f"""split as materialized (
 select 0::INTEGER as grp, id, cls, l_quantity, l_extendedprice, l_discount, l_linestatus, cast(l_linenumber as varchar) as l_line
 from {LI_SQL}),
{VDM_SQL},
sigma as materialized (select stddev_pop(l_quantity) as s1, stddev_pop(l_extendedprice) as s2, stddev_pop(l_discount) as s3 from split),
placed as materialized (select s.*, l_extendedprice * s2 / 4 as price, row_number() over (order by l_extendedprice, id) as place from split s, sigma),
asked as materialized (select * from placed where cls = 'pos'),
beside as (select q.id, q.place, {_FAR} as dist from asked q join (select unnest(range(-8, 9)) as step) on true
 join placed d on d.place = q.place + step, sigma {_VDM_JOIN}),
limits as (select place, max(dist) * max(dist) + 0.001 as reach from (
  select *, row_number() over (partition by place order by dist) as n from beside where dist > 0) where n <= 5 group by place having count(*) = 5),
ranges as materialized (select q.*, q.price - coalesce(reach, 'inf'::DOUBLE) as low, q.price + coalesce(reach, 'inf'::DOUBLE) as high
 from asked q left join limits using (place)),
dists as (select 0 as grp, q.id as qid, d.id as nid, {_FAR} as dist from ranges q join placed d on d.price between q.low and q.high, sigma {_VDM_JOIN}),
near as materialized (select * from (select *, row_number() over (partition by grp, qid order by dist, nid) as rank
  from dists where dist > 0) where rank <= 5)"""


@query("smote_neighbors", f"""with {WHOLE_SQL}
select grp, qid, nid, {r6_sql("dist", 4)} as dist, cast(rank as integer) as rank from near""")
def smote_neighbors(t: Tables) -> DataFrame:
    found = smote.hvdm_neighbors(_rows(t), "cls", "id", NUMERIC, CATEGORICAL, queries=F.col("cls") == "pos")
    return found.withColumn("dist", r6("dist", 4))


@query("smote_synthetic", f"""with {BUCKET_SQL}, {VDM_SQL}, {CLASS_SQL}, {NEAR_SQL}, {MADE_SQL}
select grp, i, parent, neighbor, cls, {', '.join(f"{r6_sql(c)} as {c}" for c in NUMERIC)}, l_linestatus, l_line from made""")
def smote_synthetic(t: Tables) -> DataFrame:
    return _rounded(smote.synthesize(_split(t), "cls", "id", NUMERIC, CATEGORICAL))


@query("smote_balanced", f"""with {BUCKET_SQL}, {VDM_SQL}, {CLASS_SQL}, {NEAR_SQL}, {MADE_SQL}
select id, cls, {', '.join(f"{r6_sql(c)} as {c}" for c in NUMERIC)}, l_linestatus, l_line, 0 as synthetic from split
union all select concat_ws('-', 'syn', grp, i), cls, {', '.join(f"{r6_sql(c)} as {c}" for c in NUMERIC)},
 l_linestatus, l_line, 1 from made""")
def smote_balanced(t: Tables) -> DataFrame:
    return _rounded(smote.smote(_rows(t), "cls", "id", NUMERIC, CATEGORICAL))


EMB_PAIRS_SQL = """e as materialized (select vec_id, label, embedding::DOUBLE[] as v from embeddings),
pairs as (select a.vec_id, b.vec_id as neighbor, b.label, round(sqrt(list_sum(
  list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) as dist from e a, e b),
near as (select * from (select *, row_number() over (partition by vec_id order by dist, neighbor) as rank
 from pairs where dist > 0) where rank <= 5)"""


@query("knn", f"""with {EMB_PAIRS_SQL}
select vec_id, neighbor, {r6_sql('dist')} as dist, cast(rank as integer) as rank from near""")
def knn_rows(t: Tables) -> DataFrame:
    return knn.knn(t.emb, "vec_id", "vec", 5).withColumn("dist", r6("dist"))


@query("knn_classify", f"""with {EMB_PAIRS_SQL}, votes as (select vec_id, label, count(*) as n from near group by all)
select vec_id, label as predicted, n as votes from (
 select *, row_number() over (partition by vec_id order by n desc, label) as k from votes) where k = 1""")
def knn_classify(t: Tables) -> DataFrame:
    return knn.knn_classify(t.emb, t.emb, "vec_id", "vec", "label", 5)


@query("knn_classify_mixed", f"""with {BUCKET_SQL}, {VDM_SQL}, sizes as (select distinct grp, cls as minority, 1 as lack from split), {NEAR_SQL},
labels as (select n.qid, s.cls, count(*) as n from near n join split s on s.id = n.nid group by all)
select qid as id, cls as predicted, n as votes from (
 select *, row_number() over (partition by qid order by n desc, cls) as k from labels) where k = 1""")
def knn_classify_mixed(t: Tables) -> DataFrame:
    return smote.hvdm_classify(_split(t), "cls", "id", NUMERIC, CATEGORICAL)


@query("scale_codes", """with d as (select p_brand, row_number() over (order by p_brand) - 1 as code, count(*) over () - 1 as span from (select distinct p_brand from part))
select p_partkey, code / greatest(span, 1)::DOUBLE as brand from part join d using (p_brand)""")
def scale_codes(t: Tables) -> DataFrame:
    """Category codes on [0, 1]."""
    rows = t.part.select("p_partkey", F.col("p_brand").alias("brand"))
    return smote.scale_codes(rows, ["brand"], schema.dictionary(rows, ["brand"]))
