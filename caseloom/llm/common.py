"""Shared helpers: reading inputs, expression tricks, and size-checked join sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseloom.session import materialize

#: White space of the contracts (space and \t \n \v \f \r), as a regular expression for Java and DuckDB.
WS = r"[\x20\x09-\x0D]"
#: Rows times an estimated row width up to which a written table may be broadcast.
BROADCAST_LIMIT = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the caller has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(arr: Column) -> Column:
    grown = F.aggregate(arr, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.slice(grown, F.lit(2), F.size(arr))


def running_total(arr: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array of longs; two levels, so a long array is not copied once per element."""

    def blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        local = F.transform(starts, lambda b: _running(F.slice(a, b * block + 1, F.lit(block))))
        return let(local, lambda parts: let(
            _running(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(F.transform(
                parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(ends, i - 1)).otherwise(0))))))

    return let(arr, lambda a: F.when(F.size(a) <= block, _running(a)).otherwise(blocks(a)))


def measured_side(df: DataFrame, label: str, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Write one side of a join; broadcast it only if its counted rows times ``row_bytes`` stay below ``limit``.

    Beyond the limit it stays an ordinary shuffle join, in which adaptive execution splits skewed keys.
    """
    stored = materialize(df, label)
    return F.broadcast(stored) if stored.count() * row_bytes <= limit else stored
