"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Equal texts are one group and are never divided.  Differencing starts with one partial partition per item (the item in
one shard, the others empty) and repeatedly combines the two with the largest spread, oppositely ordered, so that their
differences cancel; the last one left is the partition.

It needs all items at one place, so their number is fixed whatever the number of documents.  A group of at least
1 / ``ITEMS`` of all bytes is an item of its own (there are at most ``ITEMS`` such groups); all others are spread by hash
over ``ITEMS`` bundles, each an item with the bytes that Spark summed for it.  Bundles are small against a shard, so they
fill up what large groups leave uneven.  A table with few groups has hardly any bundles of more than one group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.llm.common import text_of
from caseloom.session import materialize

#: Largest number of single groups, and number of bundles.
ITEMS = 1 << 14


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item.

    The order of combining decides ties: of equal spreads, the partition that was made first.
    """
    if not sizes:
        return []
    nodes: list[tuple | None] = [None] * len(sizes)  # (one, other, order of the combined sums)
    heap = [(-s, i, (s, *[0] * (shards - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    places = range(shards)
    while len(heap) > 1:
        _, one, a = heapq.heappop(heap)
        _, other, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(places, key=lambda i: -sums[i])
        nodes.append((one, other, order))
        ranked = tuple(sums[i] for i in order)
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    found, todo = [0] * len(sizes), [(heap[0][1], list(places))]
    while todo:
        node, shard_of = todo.pop()  # shard of each place of the node's sums
        if nodes[node] is None:
            found[node] = shard_of[0]
            continue
        one, other, order = nodes[node]
        left = [0] * shards
        for place, i in enumerate(order):
            left[i] = shard_of[place]
        todo += [(one, left), (other, left[::-1])]
    return found


def text_size(text: Column) -> Column:
    """Bytes of a text plus one for its end."""
    return (F.octet_length(text) + 1).cast("long")


def shard_plan(groups: DataFrame, shards: int, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """Shards of large groups (``_h``, ``_large``) and of bundles (``_b``, ``_bundle``) for groups (``_h``, ``_g`` bytes)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("_g")).first()[0] or 0
    large = groups.where(F.col("_g") * items >= total).select("_h", "_g").orderBy("_h").collect()  # at most ``items`` rows
    rest = groups.where(F.col("_g") * items < total).groupBy(bundle_of(items).alias("_b")).agg(F.sum("_g").alias("_g"))
    bundles = rest.orderBy("_b").collect()  # at most ``items`` rows
    shard = difference([r._g for r in large] + [r._g for r in bundles], shards)
    return (spark.createDataFrame([(r._h, s) for r, s in zip(large, shard)], "_h binary, _large int"),
            spark.createDataFrame([(r._b, s) for r, s in zip(bundles, shard[len(large):])], "_b int, _bundle int"))


def bundle_of(items: int) -> Column:
    return F.pmod(F.xxhash64("_h"), F.lit(items)).cast("int")


def _content(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def with_shard(rows: DataFrame, plan: tuple[DataFrame, DataFrame], items: int = ITEMS) -> DataFrame:
    """``rows`` (with ``_h``) and their ``_shard``; both sides of the plan have at most ``items`` rows."""
    large, bundles = plan
    found = rows.join(F.broadcast(large), "_h", "left").withColumn("_b", bundle_of(items)).join(F.broadcast(bundles), "_b", "left")
    return found.withColumn("_shard", F.coalesce("_large", "_bundle")).drop("_b", "_large", "_bundle")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_h").agg(F.sum("_size").alias("_g"))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``slot`` counts the rows of a shard from 0 in order of id, without gaps.  A null text counts as the empty one, and both
    are one group.  Repeated rows are rows of their own in the same shard; null ids come first.  The law is ``bytes``, so
    ``grown_shard`` is null.  Other columns are not read; an empty table gives no rows.
    """
    t = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), _content(t).alias("_h"), text_size(t).alias("_size"),
                       F.crc32(t.cast("binary")).alias("_crc")).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows, "shard-rows")
    placed = with_shard(rows, shard_plan(materialize(_groups(rows), "shard-groups"), shards, items), items)
    order = ["_shard", "_id", "_h", "_row"]  # the row number parts equal rows, so that a range never holds too many
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = materialize(placed.drop("_h", "_row"), "shard-order")
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = placed.groupBy("_shard", "_part").agg(F.min("_i").alias("_i0"), F.count(F.lit(1)).alias("_k"))
    before = W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per task and shard
    runs = runs.select("_shard", "_part", (F.coalesce(F.sum("_k").over(before), F.lit(0)) - F.col("_i0")).alias("_shift"))
    out = placed.join(F.broadcast(runs), ["_shard", "_part"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_i") + F.col("_shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS) -> None:
    """Write ``docs`` with all columns as one Parquet folder per shard, ``shard=0`` ..., sorted by id in each file.

    The same rule as :func:`assign_shards`; a column named ``shard`` of the caller is replaced.
    """
    t = text_of(text_col)
    keys = docs.select(_content(t).alias("_h"), text_size(t).alias("_size"))
    plan = shard_plan(materialize(_groups(keys), "shard-groups"), shards, items)
    own = docs.drop("shard").select(F.struct("*").alias("_doc")) if "shard" in docs.columns else docs.select(F.struct("*").alias("_doc"))
    rows = with_shard(own.withColumn("_h", _content(text_of(F.col("_doc")[text_col]))), plan, items)
    rows = rows.withColumns({"_key": F.col("_doc")[id_col], "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("_shard", "_key", "_row").sortWithinPartitions("_shard", "_key")
    rows.select("_doc.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
