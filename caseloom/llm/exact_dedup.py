"""Exact duplicates: 128-bit content hash, bytes compared inside each hash group, smallest id stays.

Built-in functions only.  The hash leads the grouping key and the text itself completes it, so Spark's aggregate
compares bytes among rows of one hash and two texts that collide stay apart.  Copies meet in the map-side
aggregate first: a group of any size reaches the shuffle as one row per task and leaves it as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.common import WS, text_of, unused


def normalised(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, WS + "+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                content_hash: Callable[[Column], Column] = lambda t: F.unhex(F.md5(t))) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    A null text counts as empty, so null, empty and blank-free empty texts form one group.  A repeated row (same id
    and text) gets the same verdict as its twin and counts in ``group_size``.  Null ids never become ``keep_id``
    unless the whole group has none.  Other columns of ``docs`` are not touched or read; an empty table gives no rows.
    """
    t = normalised(text_of(text_col))
    base = docs.select(F.col(id_col).alias("_id"), t.alias("_t")).withColumn("_h", content_hash(F.col("_t")))
    digest = F.unhex(F.sha2(F.col("_t"), 256)).alias("_s")
    groups = base.groupBy("_h", "_t").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    found = base.select("_id", "_h", digest).join(groups.select("_h", digest, "_keep", "_n"), ["_h", "_s"])
    return found.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_s")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no equal with a smaller id; all columns as they came.

    Equal rows of one id both stay, as nothing tells them apart.
    """
    name = unused(docs, "_gone")
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
