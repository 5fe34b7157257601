"""Where long plans are cut: tables written to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/checkpoints"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, where driver and
    executors are one machine, falls back to ``LOCAL_DIR``; elsewhere a missing setting is an
    error, since a folder of one machine would be lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return LOCAL_DIR


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/counterpoise/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    The written table outlives lost executors, ends the lineage, and fixes values that
    depend on how rows were split over tasks (row positions of a sort).  A caller that no
    longer reads it hands the frame to ``discard``; else it stays until the folder is cleared.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_path = path
    return written


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned."""
    path = getattr(df, "_written_path", None)
    if path is not None:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def row_count(df: DataFrame) -> int:
    return df.count()


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows
