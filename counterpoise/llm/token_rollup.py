"""Token counts as delta-maintained rollups.

Batches of inserts, deletes and revised counts become signed changes; each batch adds its
changes to totals by source, language and tokenizer.  A batch is committed by its last write,
so a batch that failed half-way counts for nothing, and a batch that is sent again changes
nothing.  Totals are sums of batch deltas, so a commit never rewrites what came before it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

GROUP = ["source", "lang", "tokenizer"]
FEED = "op string, doc_id long, source string, lang string, tokenizer string, tokens long"
CHANGE = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int, batch long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, batch long"

_encodings: dict[tuple, object] = {}


def bpe(vocabulary: bytes, pattern: str):
    """Encoder of a byte-pair vocabulary file (base64 token and rank on each line); one per worker."""
    import tiktoken

    key = (hash(vocabulary), pattern)
    if key not in _encodings:
        pairs = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``tokens``: the number of tokens of the whole text, 0 for null.

    The vocabulary file is read by the driver and travels with the task, about a megabyte.
    """
    with open(vocabulary_path, "rb") as file:
        vocabulary = file.read()
    others = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe(vocabulary, pattern)
        for batch in batches:
            out = batch[others].copy()
            out["tokens"] = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch[text_col]]
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", tokens long"
    return docs.select(*others, text_col).mapInPandas(run, schema)


class TokenLedger:
    """Changes, deltas and commit records of one rollup, in one shared folder.

    A document counts once per tokenizer.  ``insert`` adds it, or replaces it if it is there;
    ``revise`` replaces its count, source and language, or adds it if it is not there; ``delete``
    removes it under the named tokenizer, or under all of them if that is null, and does nothing
    if it is not there.  Of several rows for one document and tokenizer in a batch the last by
    (op, tokens, source, lang) counts, so the outcome does not depend on row order.  Rows with a
    null id or an unknown op are left out; a null count is 0; null sources and languages are
    groups of their own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        return self._read("commits", "batch long").distinct()

    def state(self) -> DataFrame:
        """Current rows: (doc_id, source, lang, tokenizer, tokens)."""
        changes = self._read("changes", CHANGE).join(self.committed(), "batch", "left_semi")
        keys = ["doc_id", *GROUP, "tokens"]
        return changes.groupBy(*keys).agg(F.sum("sign").alias("_n")).where(F.col("_n") > 0).select(*keys)

    def commit(self, batch: int, feed: DataFrame) -> bool:
        """Add one batch; False if it was committed before."""
        if self.committed().where(F.col("batch") == batch).count():
            return False
        known = feed.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "delete", "revise"))
        named = known.where((F.col("op") == "delete") & F.col("tokenizer").isNull()).select("doc_id").distinct()
        state = self.state()
        everything = named.join(state, "doc_id").select(F.lit("delete").alias("op"), "doc_id", *GROUP, "tokens")
        rows = known.where(F.col("tokenizer").isNotNull()).select("op", "doc_id", *GROUP, F.coalesce("tokens", F.lit(0)).alias("tokens"))
        row = F.struct("op", "tokens", "source", "lang")
        wanted = rows.unionByName(everything).groupBy("doc_id", "tokenizer").agg(F.max_by(row, row).alias("_w"))
        wanted = wanted.select("doc_id", "tokenizer", "_w.op", "_w.source", "_w.lang", "_w.tokens")
        gone = state.join(wanted.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi").withColumn("sign", F.lit(-1))
        come = wanted.where(F.col("op") != "delete").drop("op").withColumn("sign", F.lit(1))
        names = ["doc_id", *GROUP, "tokens", "sign"]
        changes = gone.select(*names).unionByName(come.select(*names))
        changes.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")
        written = self.spark.read.parquet(f"{self.folder}/changes/batch={batch}")
        deltas = written.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        deltas.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        # the record makes the batch count; until then readers pass over its files
        self.spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens), groups without documents left out."""
        deltas = self._read("deltas", DELTA).join(self.committed(), "batch", "left_semi")
        summed = deltas.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("n_docs"), F.sum("tokens").cast("long").alias("n_tokens"))
        return summed.where(F.col("n_docs") != 0)
