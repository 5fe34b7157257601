"""Solver, decomposition and AUC queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators import auc, blocks, solve
from ..sources.io import dense_to_entries
from ..streaming import auc as auc_stream
from .base import Tables, query, r6, r6_sql

# The right side is the column sums; the result shown is the left side at the solution,
# which must give the right side back.
_CELLS = "c as materialized (select vec_id, i - 1 as col, embedding[i]::DOUBLE as val from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"


def _entries(t: Tables) -> DataFrame:
    return dense_to_entries(t.emb, "vec_id", "vec")


def _column(t: Tables, values: np.ndarray, name: str) -> DataFrame:
    rows = [(i, float(v)) for i, v in enumerate(values)]
    return t.spark.createDataFrame(rows, f"col long, {name} double")


@query("cg_solve", f"with {_CELLS} select col, {r6_sql('sum(val)', 4)} as val from c group by col")
def cg_solve(t: Tables) -> DataFrame:
    a = solve.DenseMatrix(t.emb, "vec")
    b = a.column_sums()
    x = solve.conjugate_gradient(a, b, lam=0.5)
    return _column(t, a.times_squared(x) + 0.5 * x, "val").withColumn("val", r6("val", 4))


@query("covariance", f"""with {_CELLS} select a.col as "row", b.col as col, {r6_sql('covar_samp(a.val, b.val)')} as val
 from c a join c b using (vec_id) group by all""")
def covariance(t: Tables) -> DataFrame:
    cov = solve.covariance(t.emb, "vec")[1]
    rows = [(i, j, float(v)) for i, row in enumerate(cov) for j, v in enumerate(row)]
    return t.spark.createDataFrame(rows, "row long, col long, val double").withColumn("val", r6("val"))


# Without the values themselves SQL still knows two sums of them: the squared entries of the
# matrix, and the squared entries of A'A.
_SUMS = f"""with {_CELLS}, g as (select a.col as i, b.col as j, sum(a.val * b.val) as v from c a join c b using (vec_id) group by all)
select 64::BIGINT as n, {r6_sql('(select sum(val * val) from c)', 4)} as energy, {r6_sql('(select sum(v * v) from g)', 2)} as fourth"""


def _sums(values: DataFrame, squares) -> DataFrame:
    return values.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(squares), 4).alias("energy"), r6(F.sum(squares * squares), 2).alias("fourth"))


@query("lanczos", _SUMS)
def lanczos(t: Tables) -> DataFrame:
    """All eigenvalues of A'A."""
    values = solve.lanczos(solve.DenseMatrix(t.emb, "vec"), 64)[0]
    return _sums(_column(t, values, "eigenvalue"), F.col("eigenvalue"))


@query("eigen_verify", """select i::INTEGER as i, 0::DOUBLE as error, 0::DOUBLE as residual from range(0, 10) r(i)""")
def eigen_verify(t: Tables) -> DataFrame:
    """Leading vectors that pass, and by how much A'A v misses the eigenvalue times v."""
    a = solve.DenseMatrix(t.emb, "vec")
    vectors = solve.lanczos(a, 64)[1]
    kept = solve.verify_eigenvectors(a, vectors[:10], max_error=0.01)
    rows = [(i, error, float(np.linalg.norm(a.times_squared(vectors[i]) - value * vectors[i]) / value)) for i, value, error in kept]
    return t.spark.createDataFrame(rows, "i int, error double, residual double").withColumns({c: r6(c) for c in ("error", "residual")})


@query("ssvd_values", _SUMS)
def ssvd_values(t: Tables) -> DataFrame:
    """All singular values."""
    values = solve.stochastic_svd(_entries(t), 64, p=0, q=1).values(t.spark)
    return _sums(values, F.col("sigma") * F.col("sigma"))


_UNIT = """select i::INTEGER as i, j::INTEGER as j, (i = j)::INTEGER::DOUBLE as val from range(0, 10) a(i), range(0, 10) b(j)"""


def _inner_products(t: Tables, rows: DataFrame) -> DataFrame:
    found = solve.DenseMatrix(rows, "vec").gram()
    cells = [(i, j, float(v)) for i, row in enumerate(found) for j, v in enumerate(row)]
    return t.spark.createDataFrame(cells, "i int, j int, val double").withColumn("val", r6("val"))


@query("ssvd_u", _UNIT)
def ssvd_u(t: Tables) -> DataFrame:
    """U'U."""
    return _inner_products(t, solve.stochastic_svd(_entries(t), 10, q=1).u())


@query("ssvd_v", _UNIT)
def ssvd_v(t: Tables) -> DataFrame:
    """V'V."""
    return _inner_products(t, solve.stochastic_svd(_entries(t), 10, q=1).v())


@query("ssvd_residual", "select i::INTEGER as i, 0::DOUBLE as residual from range(0, 10) r(i)")
def ssvd_residual(t: Tables) -> DataFrame:
    """Largest cell of A'u - sigma v for each pair of singular vectors."""
    found = solve.stochastic_svd(_entries(t), 10, q=1)
    left = solve.weighted(_entries(t), found.u(), 10).select("col", F.posexplode("vec").alias("i", "x"))
    right = found.v("sigma").select("col", F.posexplode("vec").alias("i", "y"))
    gaps = left.join(right, ["col", "i"]).groupBy("i").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("residual"))
    return gaps.withColumn("residual", r6("residual"))


@query("ssvd_small_directions", """select 64 as rank, 0::DOUBLE as u_error, 0::DOUBLE as v_error""")
def ssvd_small_directions(t: Tables) -> DataFrame:
    """Columns scaled down to 10^-10.5: all 64 directions are kept, and U'U and V'V are the identity."""
    cells = _entries(t).withColumn("val", F.col("val") * F.pow(F.lit(10.0), -F.col("col") / 6))
    found = solve.stochastic_svd(cells, 64, p=0, q=1)
    errors = []
    for blocks_, by in ((found.q_blocks, found.inner), (found.b_blocks, found.inner / found.sigma)):
        unit = blocks.inner(*[blocks.turned(blocks_, found.rank, by)] * 2, len(found.sigma), len(found.sigma))
        errors.append(float(np.abs(unit - np.eye(len(unit))).max()))
    return t.spark.createDataFrame([(found.rank, *errors)], "rank int, u_error double, v_error double").withColumns({
        c: r6(c, 4) for c in ("u_error", "v_error")})


@query("cg_blocks", f"with {_CELLS} select col, {r6_sql('sum(val)', 4)} as val from c group by col")
def cg_blocks(t: Tables) -> DataFrame:
    """The solution for the column sums, multiplied again, with all vectors as tables of blocks."""
    a = solve.BlockMatrix(_entries(t))
    b = blocks.pack(_entries(t).groupBy("col").agg(F.array(F.sum("val")).alias("vec")), "col")
    x = solve.conjugate_gradient(a, b, lam=2000.0, max_iter=12)
    back = blocks.combined([(1.0, a.times(a.times(x), transposed=True)), (2000.0, x)])
    return blocks.unpack(back, "col", 1).select("col", r6(F.col("vec")[0], 4).alias("val"))


@query("lanczos_blocks", f"""with {_CELLS}, g as (select a.col as i, b.col as j, sum(a.val * b.val) as v from c a join c b using (vec_id) where a.col < 6 and b.col < 6 group by all)
select 6::BIGINT as n, {r6_sql('(select sum(val * val) from c where col < 6)', 4)} as energy, {r6_sql('(select sum(v * v) from g)', 2)} as fourth, 0::DOUBLE as unit""")
def lanczos_blocks(t: Tables) -> DataFrame:
    """Eigenvalues of A'A for the first six columns by Lanczos with vectors as tables; verified, and with V'V = I."""
    a = solve.BlockMatrix(_entries(t).where(F.col("col") < 6))
    _, vectors, state = solve.lanczos(a, 6)
    wide = len(state.alpha)
    kept = solve.verify_eigenvectors(a, vectors, max_error=1e-6, width=wide)
    unit = float(np.abs(blocks.inner(vectors, vectors, wide, wide) - np.eye(wide)).max())
    found = t.spark.createDataFrame([(value, unit) for _, value, _ in kept], "eigenvalue double, unit double")
    return found.agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("eigenvalue"), 4).alias("energy"), r6(F.sum(F.col("eigenvalue") ** 2), 2).alias("fourth"),
        r6(F.max("unit")).alias("unit"))


def _product(found: solve.Decomposition) -> DataFrame:
    """U Sigma V' cell by cell; V has one row per matrix column."""
    rows = found.reconstruct()
    cells = rows.select("row", F.posexplode("vec").alias("col", "val"))
    return cells.withColumn("col", F.col("col").cast("long"))


@query("ssvd_reconstruct", f'with {_CELLS} select vec_id as "row", col, {r6_sql("val", 4)} as val from c')
def ssvd_reconstruct(t: Tables) -> DataFrame:
    """With as many vectors as columns the product of the factors is the matrix itself."""
    return _product(solve.stochastic_svd(_entries(t), 64, p=0)).withColumn("val", r6("val", 4))


@query("pca", f"""with {_CELLS}, m as (select col, avg(val) as mean from c group by col)
select vec_id as "row", c.col, {r6_sql("val - mean", 4)} as val from c join m using (col)""")
def pca(t: Tables) -> DataFrame:
    """The same for the centered matrix."""
    return _product(solve.stochastic_svd(_entries(t), 64, p=0, center=True)).withColumn("val", r6("val", 4))


# online AUC

def _events(t: Tables) -> DataFrame:
    return t.events.select(
        "ts", "event_id", (F.col("user_id") % 10).alias("grp"),
        (F.col("event_type") == "purchase").cast("int").alias("cls"), F.col("value").alias("score"),
    )


def _auc_sql(group: bool) -> str:
    by = "partition by grp" if group else ""
    key = "grp, " if group else ""
    same = "and h.grp = e.grp" if group else ""
    return f"""e as materialized (select event_id, user_id % 10 as grp, case when event_type = 'purchase' then 1 else 0 end as cls, value as score,
 sum(case when event_type = 'purchase' then 1 else 0 end) over w as n1, sum(case when event_type = 'purchase' then 0 else 1 end) over w as n0
 from events window w as ({by.replace('grp', 'user_id % 10')} order by ts, event_id rows unbounded preceding)),
h as materialized (select grp, cls, score, case when cls = 1 then n1 else n0 end as seq from e),
k as (select *, case when cls = 1 then n0 else n1 end as other from e),
pairs as (select e.event_id, {'e.grp, ' if group else ''}e.cls, avg(case when h.score is null then 0.5::DOUBLE when e.score > h.score then 1 when e.score = h.score then 0.5 else 0 end) as x
 from k e left join h on h.cls = 1 - e.cls and h.seq > e.other - 10 and h.seq <= e.other {same} group by all),
m as (select {key}coalesce(avg(x) filter (cls = 0), 0.5) as a0, coalesce(avg(x) filter (cls = 1), 0.5) as a1,
 count(*) filter (cls = 0) as n0, count(*) filter (cls = 1) as n1 from pairs {'group by grp' if group else ''})"""


_PARTS = f"{r6_sql('a0')} as a0, {r6_sql('a1')} as a1, n0, n1, {r6_sql('(1 - a0 + a1) / 2')} as auc"


@query("online_auc", f"with {_auc_sql(False)} select {_PARTS} from m")
def online_auc(t: Tables) -> DataFrame:
    found = auc.online_auc(_events(t), ["ts", "event_id"], "cls", "score")
    return found.withColumns({c: r6(c) for c in ("a0", "a1", "auc")})


@query("grouped_auc", f"with {_auc_sql(True)} select {r6_sql('avg((1 - a0 + a1) / 2)')} as auc, count(*) as groups from m")
def grouped_auc(t: Tables) -> DataFrame:
    found = auc.grouped_auc(_events(t), ["ts", "event_id"], "cls", "score", ["grp"])
    return found.withColumn("auc", r6("auc"))


def _window_sql(w: int) -> str:
    """The running means when every update is a += (x - a) / min(w, n), as weighted sums."""
    numbered = "j as (select p.*, case when p.cls = 1 then e.n1 else e.n0 end as seq from pairs p join e using (event_id)), z as (select *, count(*) over (partition by grp, cls) as size from j)"
    weight = f"case when size <= {w} then 1.0::DOUBLE / size else power(1 - 1.0::DOUBLE / {w}, size - greatest(seq, {w})) / {w} end"
    head = _auc_sql(True).rsplit("m as (", 1)[0]
    return f"""with {head}{numbered},
m as (select grp, coalesce(sum(x * {weight}) filter (cls = 0), 0.5) as a0, coalesce(sum(x * {weight}) filter (cls = 1), 0.5) as a1,
 count(*) filter (cls = 0) as n0, count(*) filter (cls = 1) as n1 from z group by grp)"""


@query("online_auc_window", f"{_window_sql(50)} select grp, {_PARTS} from m")
def online_auc_window(t: Tables) -> DataFrame:
    """Means over a window of 50 updates, per group."""
    found = auc.group_auc(_events(t), ["ts", "event_id"], "cls", "score", ["grp"], window_size=50)
    return found.withColumns({c: r6(c) for c in ("a0", "a1", "auc")})


def _samples(t: Tables) -> DataFrame:
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
    source = source.option("maxFilesPerTrigger", 16).parquet(t.path)
    return source.select(
        (F.col("user_id") % 10).cast("string").alias("grp"),
        (F.col("event_type") == "purchase").cast("int").alias("cls"), F.col("value").alias("score"),
        F.col("ts").alias("ord1"), F.col("event_id").alias("ord2"),
    )


@query("online_auc_stream_split", f"with {_auc_sql(True)} select grp::VARCHAR as grp, {_PARTS} from m")
def online_auc_stream_split(t: Tables) -> DataFrame:
    """The stream whose micro-batches are cut into parts."""
    return auc_stream.advance_stream(_samples(t), "auc-split").withColumns({c: r6(c) for c in ("a0", "a1", "auc")})


@query("online_auc_stream", f"with {_auc_sql(True)} select grp::VARCHAR as grp, {_PARTS} from m")
def online_auc_stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    source = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    source = source.option("maxFilesPerTrigger", 16).parquet(t.path)
    samples = source.select(
        (F.col("user_id") % 10).cast("string").alias("grp"),
        (F.col("event_type") == "purchase").cast("int").alias("cls"), F.col("value").alias("score"),
        F.col("ts").alias("ord1"), F.col("event_id").alias("ord2"),
    )
    found = auc_stream.run_to_end(auc_stream.auc_stream(samples), "auc")
    return found.withColumns({c: r6(c) for c in ("a0", "a1", "auc")})
