"""Session helpers: local sessions for tests, the shared scratch folder, and size checks.

Two decisions in this library depend on volume: whether a side may be broadcast and whether a
single-task window is acceptable.  Both go through :func:`small_input`, which compares the
optimizer's size of the *leaf* relations (files on disk, so a proven figure, not a guess about
an intermediate result) with ``caseloom.smallInputBytes``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_INPUT_KEY = "caseloom.smallInputBytes"
SMALL_INPUT_DEFAULT = 64 * 1024 * 1024
BROADCAST_BYTES = 128 * 1024 * 1024
KEY_BYTES = 2 * 1024 * 1024


def local_session(name: str = "caseloom", cpus: int | str = "*", partitions: int = 8, **conf) -> SparkSession:
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), "caseloom", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing a Parquet table; survives executor loss and gives later joins real statistics."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """:func:`materialize` plus the number of rows, read from the file footers."""
    out = materialize(df, label)
    return out, out.count()


def stage_if_large(df: DataFrame, label: str = "stage") -> DataFrame:
    """For a table that is read more than once: written when its input is large, recomputed when it is small."""
    return df if small_input(df) else materialize(df, label)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows inside the plan, so the optimizer knows their size (an RDD-backed table has none)."""
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, cols)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def input_bytes(df: DataFrame) -> int | None:
    """Total size of the distinct leaf relations under ``df``, or None when the optimizer cannot tell."""
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = {}
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            sizes[leaf.canonicalized().hashCode()] = int(str(leaf.stats().sizeInBytes()))
        return sum(sizes.values())
    except Exception:
        return None


def small_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(SMALL_INPUT_KEY, str(SMALL_INPUT_DEFAULT)))


def small_input(*dfs: DataFrame) -> bool:
    """True when every leaf table together is small enough for one task to hold."""
    total = 0
    for df in dfs:
        b = input_bytes(df)
        if b is None:
            return False
        total += b
    return total <= small_limit(dfs[0].sparkSession)


def lookup_side(df: DataFrame, label: str = "lookup") -> DataFrame:
    """Prepare a dimension/model table for a join: broadcast only behind a size check.

    Small inputs bound the result, so the hint is safe.  Otherwise the table is written once and
    the *measured* size decides; beyond the limit the join stays a shuffle join (AQE splits skew).
    """
    if small_input(df):
        return F.broadcast(df)
    stored = materialize(df, label)
    size = input_bytes(stored)
    return F.broadcast(stored) if size is not None and size <= BROADCAST_BYTES else stored


def key_side(df: DataFrame) -> DataFrame:
    """Prepare a table with a row for each case or customer for a join: it grows with the facts, and its files are far
    smaller than its rows in memory, so beyond a few megabytes of input it is never sent through the driver."""
    size = input_bytes(df)
    small = size is not None and size <= min(KEY_BYTES, small_limit(df.sparkSession))
    return F.broadcast(df) if small else df.hint("merge")
