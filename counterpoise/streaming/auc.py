"""Prequential AUC as a stateful stream: one small state per group.

``auc_stream`` takes the rows of a group one after the other in the group's task.  ``advance_stream`` cuts
the micro-batch of a large group into parts (operators/auc.py), for streams with hot groups.

The state holds the retained scores of both classes, their means and counts; Spark keeps
it in the checkpoint, so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.auc import advance, slot
from ..session import new_path

HISTORY = 10
STATE = "scores0 array<double>, scores1 array<double>, a0 double, a1 double, n0 long, n1 long"
OUTPUT = "grp string, a0 double, a1 double, n0 long, n1 long, auc double"


def _updates(policy: str, history: int, window_size: int | None):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            s0, s1, a0, a1, n0, n1 = state.get
            scores, means, counts = [list(s0), list(s1)], [a0, a1], [n0, n1]
        else:
            scores, means, counts = [[], []], [0.5, 0.5], [0, 0]
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["ord1", "ord2"], kind="stable")
        for cls, score in zip(batch["cls"].to_numpy(), batch["score"].to_numpy()):
            cls, score, n = int(cls), float(score), counts[int(cls)]
            place = slot(policy, n, history, str(key[0]), cls)
            if n < history:
                scores[cls].append(score)
            elif place >= 0:
                scores[cls][place] = score
            counts[cls] = n + 1
            other = scores[1 - cls]
            if other:
                share = sum(1.0 if score > v else 0.5 if score == v else 0.0 for v in other) / len(other)
                span = counts[cls] if window_size is None else min(window_size, counts[cls])
                means[cls] += (share - means[cls]) / span
        state.update((scores[0], scores[1], means[0], means[1], counts[0], counts[1]))
        auc = (1 - means[0] + means[1]) / 2
        yield pd.DataFrame(
            {"grp": [key[0]], "a0": [means[0]], "a1": [means[1]], "n0": [counts[0]], "n1": [counts[1]], "auc": [auc]}
        )

    return run


def auc_stream(
    samples: DataFrame, policy: str = "fifo", history: int = HISTORY, window_size: int | None = None
) -> DataFrame:
    """Stream of (grp, a0, a1, n0, n1, auc) after each micro-batch.

    ``samples`` is a stream of (grp string, cls int, score double, ord1, ord2); inside a
    micro-batch the samples of a group are taken in (ord1, ord2) order, so a source should
    bound its micro-batches (maxFilesPerTrigger).  The result equals the batch form only if
    micro-batches arrive in event order; a late one is taken after those before it.  ``policy`` tells
    which score a new one replaces: the oldest ('fifo'), one of a fair reservoir ('fair'),
    or any ('random').
    """
    return samples.groupBy("grp").applyInPandasWithState(
        _updates(policy, history, window_size), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input, keep each group's last row; results and state go to the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(OUTPUT + ", batch long").parquet(out)
    last = F.max_by(F.struct(*[F.col(c) for c in ("a0", "a1", "n0", "n1", "auc")]), "batch")
    return rows.groupBy("grp").agg(last.alias("l")).select("grp", "l.*")


def advance_stream(
    samples: DataFrame, name: str, policy: str = "fifo", history: int = HISTORY, window_size: int | None = None
) -> DataFrame:
    """Process all available input of (grp, cls, score, ord1, ord2); (grp, a0, a1, n0, n1, auc) at its end.

    The state of all groups is a table per micro-batch, made from the one before it and the batch's
    rows.  A batch that is done again writes the same table again, so a restart counts no row twice.
    """
    spark = samples.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    schema = "grp string, " + STATE.replace("scores", "slots")

    def step(batch: DataFrame, batch_id: int) -> None:
        state = batch.sparkSession.read.schema(schema).parquet(f"{out}/batch={batch_id - 1}") if batch_id else None
        found = advance(batch, ["ord1", "ord2"], "cls", "score", ["grp"], history, window_size, policy, state)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    rows = spark.read.schema(schema + ", batch long").parquet(out)
    newest = rows.agg(F.max("batch")).first()[0]
    last = rows.where(F.col("batch") == (newest if newest is not None else -1))
    return last.select("grp", "a0", "a1", "n0", "n1", ((1 - F.col("a0") + F.col("a1")) / 2).alias("auc"))
