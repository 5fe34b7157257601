"""Connected components by smallest labels, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for all nodes of ``edges``; a component is named by its smallest node.

    Each round every node takes the smallest label among its neighbours, then the label of
    its label, so that paths halve.  Minima combine before the shuffle, so a node may have any
    number of edges.  Each round's labels are written and the round before is deleted.
    Null ends, loops and repeated edges are allowed and change nothing.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialize(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("_was"), F.least("label", "_near").alias("_at")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_further"))
        stepped = lower.join(jump, "_at").select("node", "_was", F.least("_at", "_further").alias("label"))
        following = materialize(stepped, "labels")
        changed = following.where(F.col("label") != F.col("_was")).limit(1).count()
        discard(labels)
        labels = following
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
