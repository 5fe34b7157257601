"""Registry of queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.io import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables, each read with the columns its query needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents, ready for work on their whole text."""
        return spread(self.documents.select("doc_id", "text"))

    @cached_property
    def lab(self) -> DataFrame:
        """Labelled documents: labels joined to document features."""
        docs = self.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
        labels = self.labels.select("doc_id", F.col("toxic").cast("string").alias("toxic"), "quality")
        return labels.join(docs, "doc_id")

    @cached_property
    def li(self) -> DataFrame:
        """Line items with a unique row id and a two-valued class."""
        row = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        pos = F.when(F.col("l_returnflag") == "R", "pos").otherwise("neg")
        return spread(self.lineitem).withColumn("id", row).withColumn("cls", pos)

    @cached_property
    def cp(self) -> DataFrame:
        """Customer by part matrix of ordered quantity, in (row, col, val) form."""
        orders = self.orders.select("o_orderkey", F.col("o_custkey").alias("row"))
        lines = self.lineitem.select("l_orderkey", F.col("l_partkey").alias("col"), "l_quantity")
        joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        return joined.groupBy("row", "col").agg(F.sum("l_quantity").alias("val"))

    @cached_property
    def emb(self) -> DataFrame:
        """Embeddings with double coordinates."""
        vec = F.col("embedding").cast("array<double>").alias("vec")
        return self.embeddings.select("vec_id", vec, "label")


LAB_SQL = """(select l.doc_id, cast(l.toxic as varchar) as toxic, l.quality, d.lang, d.source,
 cast(d.n_chars as double) as n_chars from labels l join documents d on l.doc_id = d.doc_id)"""
LI_SQL = """(select *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
 case when l_returnflag = 'R' then 'pos' else 'neg' end as cls from lineitem)"""
CP_SQL = """(select o_custkey as "row", l_partkey as col, sum(l_quantity) as val
 from lineitem join orders on l_orderkey = o_orderkey group by all)"""


def u_sql(seed, *keys: str) -> str:
    """SQL text of the draw in functions/draw.py."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::UBIGINT / 4503599627370496::DOUBLE)"


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded value without negative zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def r6_sql(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0::DOUBLE)"


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name``."""

    def register(fn):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
