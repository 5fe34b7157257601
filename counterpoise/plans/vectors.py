"""Queries on vectors and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import distance
from ..functions.info import llr_sql
from ..operators import matrix, similarity, solve
from .base import CP_SQL, Tables, query, r6, r6_sql, u_sql

# Seeds are the mean vectors of the labels, so every vector of the table is used.
SEEDS_SQL = """e as materialized (select vec_id, label, embedding::DOUBLE[] as v from embeddings),
cells as (select label, i, avg(v[i]) as x, var_samp(v[i]) as s from (select label, v, unnest(range(1, 65)) as i from e) group by all),
seeds as materialized (select label, list(round(x, 9) order by i) as c from cells group by label),
spread as (select i, round(1 / var_samp(v[i]), 6) as w from (select v, unnest(range(1, 65)) as i from e) group by i),
wt as materialized (select list(w order by i) as w from spread)"""


def _seeds(t: Tables) -> DataFrame:
    means = similarity.centroids(t.emb, "label", "vec")
    return means.withColumn("vec", F.transform("vec", lambda x: F.round(x, 9)))


def _weights(t: Tables):
    spread = t.emb.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.round(1 / F.var_samp("x"), 6).alias("w"))
    return spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"])).scalar()


def _ls(body: str, zipped: str = "list_zip(c, v)") -> str:
    return f"list_sum(list_transform({zipped}, lambda p: {body}))"


_DOT, _CC, _VV = _ls("p[1] * p[2]"), _ls("p[1] * p[1]"), _ls("p[2] * p[2]")
_W3 = "list_zip(c, v, w)"
DISTANCE_SQL = {
    "sq_euclidean": _ls("(p[1] - p[2]) * (p[1] - p[2])"),
    "euclidean": f"sqrt({_ls('(p[1] - p[2]) * (p[1] - p[2])')})",
    "manhattan": _ls("abs(p[1] - p[2])"),
    "chebyshev": "list_max(list_transform(list_zip(c, v), lambda p: abs(p[1] - p[2])))",
    "minkowski": f"pow({_ls('pow(abs(p[1] - p[2]), 3)')}, 1 / 3.0::DOUBLE)",
    "cosine": f"1 - {_DOT} / greatest(sqrt({_CC}) * sqrt({_VV}), {_DOT})",
    "tanimoto": f"1 - {_DOT} / greatest({_CC} + {_VV} - {_DOT}, {_DOT})",
    "weighted_euclidean": f"sqrt({_ls('(p[1] - p[2]) * (p[1] - p[2]) * p[3]', _W3)})",
    "weighted_manhattan": _ls("abs(p[1] - p[2]) * p[3]", _W3),
    "mahalanobis": f"sqrt({_ls('(p[1] - p[2]) * (p[1] - p[2]) * p[3]', _W3)} + 0.25::DOUBLE * pow({_ls('p[1] - p[2]')}, 2))",
}


def _options(t: Tables, name: str) -> dict:
    if name.startswith("weighted"):
        return {"weights": _weights(t)}
    if name == "mahalanobis":
        # a full matrix: the inverse variances on its diagonal, and a quarter everywhere
        one = t.emb.agg(F.count(F.lit(1))).select(_weights(t).alias("w"))
        rows = F.transform("w", lambda x, i: F.transform("w", lambda y, j: F.when(i == j, x + 0.25).otherwise(F.lit(0.25))))
        return {"inverse": one.select(rows).scalar()}
    return {}


for _name, _expr in DISTANCE_SQL.items():

    @query(f"dist_{_name}", f"with {SEEDS_SQL} select s.label, vec_id, {r6_sql(_expr)} as distance from e, seeds s, wt")
    def dist(t: Tables, name: str = _name) -> DataFrame:
        found = similarity.vector_distance(t.emb.drop("label"), "vec_id", "vec", _seeds(t), "label", name, **_options(t, name))
        return found.withColumn("distance", r6("distance"))


@query("mahalanobis_to_mean", f"""with m as (select avg(l_quantity) as mq, avg(l_extendedprice) as mp, var_samp(l_quantity) as vq,
 var_samp(l_extendedprice) as vp, covar_samp(l_quantity, l_extendedprice) as c from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r6_sql("""sqrt((vp * (l_quantity - mq) * (l_quantity - mq)
 - 2 * c * (l_quantity - mq) * (l_extendedprice - mp) + vq * (l_extendedprice - mp) * (l_extendedprice - mp)) / (vq * vp - c * c))""", 5)} as distance
from lineitem, m""")
def mahalanobis_to_mean(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_extendedprice").alias("vec"))
    mean, cov = solve.covariance(rows, "vec")
    inverse = solve.array_literal(solve.inverse_covariance(cov))
    found = distance.mahalanobis_to_mean(F.col("vec"), solve.array_literal(mean), inverse)
    return rows.withColumn("distance", r6(found, 5)).drop("vec")


@query("vector_distance_v", f"""with {SEEDS_SQL}, d as (select s.label, vec_id, sqrt({_ls('(p[1] - p[2]) * (p[1] - p[2])')}) as distance from e, seeds s)
select vec_id, list(distance order by label)[1]::DECIMAL(18,5)::VARCHAR as first, len(list(distance)) as n,
 {r6_sql('sum(distance)', 5)} as total from d group by vec_id""")
def vector_distance_v(t: Tables) -> DataFrame:
    pairs = similarity.vector_distance(t.emb.drop("label"), "vec_id", "vec", _seeds(t), "label", "euclidean")
    rows = similarity.distance_vectors(pairs, "vec_id", "label")
    return rows.select(
        "vec_id", F.col("distances")[0].cast("decimal(18,5)").cast("string").alias("first"),
        F.size("distances").cast("long").alias("n"), r6(distance.total(F.col("distances")), 5).alias("total"),
    )


@query("kernels", f"""with {SEEDS_SQL}, d as (select s.label, vec_id, sqrt({_ls('(p[1] - p[2]) * (p[1] - p[2])')}) as d from e, seeds s)
select label, vec_id, {r6_sql('exp(-d * d / 2) / sqrt(2 * pi())')} as normal, case when round(d, 9) < 1 then 1::DOUBLE else 0::DOUBLE end as triangular from d""")
def kernels(t: Tables) -> DataFrame:
    pairs = similarity.vector_distance(t.emb.drop("label"), "vec_id", "vec", _seeds(t), "label", "euclidean")
    return pairs.select(
        "label", "vec_id", r6(distance.normal_kernel(F.col("distance"), 1.0)).alias("normal"),
        distance.triangular_kernel(F.round("distance", 9), 1.0).alias("triangular"),
    )


# row similarity of customers by ordered parts

_BIN = f'm as materialized (select "row", col, 1::DOUBLE as val from {CP_SQL})'
_RAW = f"m as materialized (select * from {CP_SQL})"
_UNIT = f"""r as materialized (select * from {CP_SQL}), l as (select "row", sqrt(sum(val * val)) as l from r group by 1),
m as materialized (select "row", col, val / l as val from r join l using ("row"))"""
_CENTER = f"""r0 as materialized (select * from {CP_SQL}), c as (select "row", sum(abs(val)) / count(*) as mu from r0 group by 1),
r as materialized (select "row", col, val - mu as val from r0 join c using ("row") where val <> mu),
l as (select "row", sqrt(sum(val * val)) as l from r group by 1),
m as materialized (select "row", col, val / l as val from r join l using ("row"))"""

_MEASURES = {
    "cooccurrence": (_BIN, "n"),
    "loglikelihood": (_BIN, "1 - 1 / (1 + " + llr_sql("n", "(nb - n)", "(na - n)", "(cols - na - nb + n)") + ")"),
    "tanimoto": (_BIN, "n / (na + nb - n)"),
    "cityblock": (_BIN, "1 / (1 + na + nb - 2 * n)"),
    "cosine": (_UNIT, "n"),
    "pearson": (_CENTER, "n"),
    "euclidean": (_RAW, "1 / (1 + sqrt(greatest(0::DOUBLE, na - 2 * n + nb)))"),
}


def _rowsim_sql(name: str, top: int, threshold: float | None = None, exclude: bool = False) -> str:
    base, expr = _MEASURES[name]
    limit = f"s >= {threshold}" if threshold else "s > 0"
    return f"""with {base}, norm as materialized (select "row", sum(val * val) as n from m group by 1),
k as (select max(col) + 1 as cols from m),
dots as (select a."row" as a, b."row" as b, sum(a.val * b.val) as n from m a join m b on a.col = b.col group by all),
sims as (select a, b, {expr} as s from (select d.*, x.n as na, y.n as nb, cols from dots d join norm x on x."row" = d.a join norm y on y."row" = d.b, k)),
ranked as (select a as "row", b as other, s, row_number() over (partition by a order by round(s, 9) desc, b) as rank from sims where {limit} {"and a <> b" if exclude else ""})
select "row", other, {r6_sql('s')} as similarity, rank::INTEGER as rank from ranked where rank <= {top}"""


for _name in _MEASURES:

    @query(f"rowsim_{_name}", _rowsim_sql(_name, 10))
    def rowsim(t: Tables, name: str = _name) -> DataFrame:
        return similarity.row_similarity(t.cp, name, top=10).withColumn("similarity", r6("similarity"))


@query("rowsim_threshold", _rowsim_sql("cosine", 100, 0.2, True))
def rowsim_threshold(t: Tables) -> DataFrame:
    found = similarity.row_similarity(t.cp, "cosine", exclude_self=True, threshold=0.2)
    return found.withColumn("similarity", r6("similarity"))


@query("rowsim_tanimoto_threshold", _rowsim_sql("tanimoto", 100, 0.1, True))
def rowsim_tanimoto_threshold(t: Tables) -> DataFrame:
    found = similarity.row_similarity(t.cp, "tanimoto", exclude_self=True, threshold=0.1)
    return found.withColumn("similarity", r6("similarity"))


@query("row_norms", f"""with m as (select * from {CP_SQL}) select "row", count(*) as nnz, max(abs(val)) as "max", sum(val * val) as sq from m group by 1""")
def row_norms(t: Tables) -> DataFrame:
    return similarity.row_statistics(t.cp).select("row", F.col("nnz").cast("long").alias("nnz"), "max", "sq")


# matrix products

def _by_line(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("row"))
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("col"), "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("row", "col").agg(F.sum("l_quantity").alias("val"))


_BY_LINE = """(select o_custkey as "row", l_linenumber::BIGINT as col, sum(l_quantity) as val from lineitem join orders on l_orderkey = o_orderkey group by all)"""
_V = "(select p_partkey as col, p_retailprice as val from part)"


def _price(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("val"))


@query("transpose", f'select col as "row", "row" as col, val from {CP_SQL}')
def transpose(t: Tables) -> DataFrame:
    return matrix.transpose(t.cp)


@query("at_b", f'select a.col as "row", b.col as col, sum(a.val * b.val) as val from {CP_SQL} a join {_BY_LINE} b on a."row" = b."row" group by all')
def at_b(t: Tables) -> DataFrame:
    return matrix.times(t.cp, _by_line(t))


@query("mat_vec", f'select "row", {r6_sql("sum(m.val * v.val)", 3)} as val from {CP_SQL} m join {_V} v using (col) group by all')
def mat_vec(t: Tables) -> DataFrame:
    return matrix.mat_vec(t.cp, _price(t)).withColumn("val", r6("val", 3))


@query("at_a_v", f"""with m as materialized (select * from {CP_SQL}), d as (select "row", sum(m.val * v.val) as d from m join {_V} v using (col) group by all)
select col, {r6_sql('sum(val * d)', 1)} as val from m join d using ("row") group by col""")
def at_a_v(t: Tables) -> DataFrame:
    return matrix.at_a_v(t.cp, _price(t)).withColumn("val", r6("val", 1))


@query("omega", f"""select p_partkey as "row", k::INTEGER as col, {u_sql('omega', 'p_partkey', 'k')} - 0.5::DOUBLE as val from part, (select unnest(range(0, 8)) as k)""")
def omega(t: Tables) -> DataFrame:
    return matrix.omega(t.part.select(F.col("p_partkey").alias("col")), 8)


_Y = f"""y as materialized (select "row", k, sum(val * ({u_sql('omega', 'col', 'k')} - 0.5::DOUBLE)) as val from {CP_SQL}, (select unnest(range(0, 8)) as k) group by all)"""


@query("project", f"""with {_Y} select "row", k::INTEGER as col, {r6_sql('val')} as val from y""")
def project(t: Tables) -> DataFrame:
    return matrix.project(t.cp, 8).withColumn("val", r6("val"))


@query("yty", f"""with {_Y} select a.k::INTEGER as "row", b.k::INTEGER as col, {r6_sql('sum(a.val * b.val)', 4)} as val from y a join y b using ("row") group by all""")
def yty(t: Tables) -> DataFrame:
    return matrix.gram(matrix.project(t.cp, 8)).withColumn("val", r6("val", 4))
