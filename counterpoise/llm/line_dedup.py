"""Line dedup: lines found in many documents stay only in the last document that holds them.

Everything is DataFrame code.  Texts are read twice and shuffled once; between the reads
only (document, position, line hash) rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 16


def lines_of(text: Column) -> Column:
    """The text cut at every newline; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_marks(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(``_doc``, ``_pos``, ``_h1``, ``_h2``) of lines long enough to count; 128 hash bits stand for the key."""
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    lines = docs.select(F.col(id_col).alias("_doc"), F.posexplode(keys).alias("_pos", "_key"))
    lines = lines.where(F.length("_key") >= min_chars)
    return lines.select("_doc", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))


def repeated_lines(marks: DataFrame, min_docs: int) -> DataFrame:
    """Keys held by at least ``min_docs`` documents, with the largest document that holds each.

    A key may lie in any share of the documents: both aggregates combine before the shuffle.
    """
    held = marks.groupBy("_h1", "_h2", "_doc").agg(F.lit(1).alias("_one"))
    counted = held.groupBy("_h1", "_h2").agg(F.count("_one").alias("_docs"), F.max("_doc").alias("_keeper"))
    return counted.where(F.col("_docs") >= min_docs).select("_h1", "_h2", "_keeper")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with repeated lines dropped from the text, plus ``_n_lines`` and ``_n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
    all their lines except in the largest ``id_col`` that holds them; there every copy stays.
    Other lines keep their order, joined by a newline.  A null or empty text is one empty line
    and becomes the empty text.  Other columns pass unchanged; rows with a null id keep their
    text.  ``id_col`` must be unique: rows that share an id and a text lose the same lines.
    """
    marks = line_marks(docs.where(F.col(id_col).isNotNull()), id_col, text_col, min_chars)
    repeated = repeated_lines(marks, min_docs)
    # one line may lie in a third of all documents: its rows are dealt over several tasks
    salted = marks.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)))
    spread = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gone = salted.join(spread, ["_h1", "_h2", "_salt"]).where(F.col("_doc") < F.col("_keeper"))
    cuts = gone.groupBy("_doc").agg(F.array_sort(F.collect_set("_pos")).alias("_cuts"))
    joined = packed(docs, id=F.col(id_col), text=F.col(text_col)).join(cuts, F.col("id") == F.col("_doc"), "left")

    lines = lines_of(F.col("text"))
    none = F.array().cast("array<int>")
    cut = F.coalesce("_cuts", none)
    # the stretches between two dropped positions, so that long documents take linear time
    starts = F.concat(F.array(F.lit(-1)), cut)
    ends = F.concat(cut, F.array(F.size("_lines")))
    stretches = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    kept = F.when(F.size(cut) == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.flatten(stretches), "\n")
    )
    out = joined.withColumn("_lines", lines).withColumn("_kept", kept)
    counts = {"_n_lines": F.size("_lines").cast("long"), "_n_dropped": F.size(cut).cast("long")}
    return unpacked(out, docs.columns, **{text_col: F.col("_kept")}, **counts)
