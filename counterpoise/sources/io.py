"""Readers and writers for labelled rows, lines, records, matrices and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.schema import Roles

MISSING = "?"


def read_lines(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    """Text lines, plain or gzip; ``skip_header`` drops the first line of every file."""
    if skip_header:
        # one column, no separator can occur: the csv reader skips each file's header
        return spark.read.schema("value string").option("header", True).option("sep", "\x01").option(
            "quote", ""
        ).option("enforceSchema", True).csv(path)
    return spark.read.text(path)


def parse_delimited(lines: DataFrame, columns: list[str], roles: Roles, column: str = "value") -> DataFrame:
    """Typed rows from lines split at one comma or one space.

    Empty lines are skipped, rows with the missing mark in a used column are dropped, and
    a line with another number of tokens is an error.
    """
    tokens = lines.where(F.length(F.trim(F.col(column))) > 0).select(F.split(column, "[, ]").alias("t"))
    message = F.concat(F.lit(f"expected {len(columns)} values, line has "), F.size("t").cast("string"))
    checked = F.when(F.size("t") == len(columns), F.col("t")).otherwise(F.raise_error(message).cast("array<string>"))
    rows = tokens.select(checked.alias("t")).select(*[F.col("t")[i].alias(c) for i, c in enumerate(columns)])
    kept = [c for c in columns if c not in roles.ignored]
    complete = rows.where(~F.array_contains(F.array(*[F.col(c) for c in kept]), MISSING)).select(*kept)
    numbers = [*roles.numeric, *([roles.label] if roles.regression else [])]
    return complete.withColumns({c: F.col(c).cast("double") for c in numbers})


def read_delimited(spark: SparkSession, path: str, columns: list[str], roles: Roles) -> DataFrame:
    return parse_delimited(read_lines(spark, path), columns, roles)


def split_records(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """Each line as (list of items, 1)."""
    return lines.select(F.split(column, pattern).alias("items"), F.lit(1).cast("long").alias("n"))


def read_records(
    spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """Record files of a file, folder or glob; logs, checksums and hidden files are skipped."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table over all cores before costly work on each row.

    A small file often is one row group, which one task reads whatever the split size.
    Tables above ``SPREAD_BYTES`` per core keep their file splits and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES * cores else df


GATHER_BYTES = 8 << 20
MAX_ESTIMATE = 1 << 46  # above it, a frame has no known size


def gather(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one task, so that counts per ``key`` and something else need no further shuffle.

    Meant for rows that grow when they are cut up, such as texts: tasks are sized by what is read,
    where Spark has an estimate of it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-size // GATHER_BYTES)) if size < MAX_ESTIMATE else tasks, key)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row long, col long, val double").parquet(path)


def dense_to_entries(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Array vectors to (row, col, val), zeros left out."""
    cells = vectors.select(F.col(id_col).cast("long").alias("row"), F.posexplode(vec).alias("col", "val"))
    return cells.where(F.col("val") != 0).select("row", F.col("col").cast("long").alias("col"), "val")


def inverse_dictionary(terms: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Terms of the ids in ``ids``."""
    return ids.join(terms, id_col, "left")


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def vector_dimension(vectors: DataFrame, vec: str) -> DataFrame:
    """Length of the vectors, from all of them."""
    return vectors.agg(F.max(F.size(vec)).cast("long").alias("dimension"))


def write(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet", **options) -> None:
    """Write a table; an existing path is an error unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").options(**options).format(fmt).save(path)


def write_text_rows(df: DataFrame, path: str, columns: list[str], overwrite: bool = False, sep: str = ",") -> None:
    """Rows as delimited text, many files, no global order."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns])
    df.select(line.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)
