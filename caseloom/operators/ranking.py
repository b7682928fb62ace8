"""Exact global ranks, exact quantiles and top-k choices without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.operators import sequence as S
from caseloom.session import materialize, small_input, stage_if_large


def global_rank(df: DataFrame, order: list, name: str = "rank", small: bool | None = None, total: str | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order`` (columns or sort expressions).

    ``total`` names an optional column with the number of rows.

    Large inputs: one range exchange, one write, then each row's rank is its index inside the
    range partition plus the row counts of the partitions before it.
    """
    if small is None:
        small = small_input(df)
    if small:  # the whole input fits one task, proven by its size on disk
        w = W.orderBy(*order)
        out = df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
        everything = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        return out.withColumn(total, F.count(F.lit(1)).over(everything)) if total else out
    staged = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()),
        "rank",
    ).withColumns({"_part": F.shiftright("_mid", 33), "_idx": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    everything = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = staged.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_off"), F.sum("count").over(everything).alias("_tot"))
    out = staged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_idx") + F.col("_off"))
    if total:
        out = out.withColumn(total, F.col("_tot"))
    return out.drop("_mid", "_part", "_idx", "_off", "_tot")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], name: str = "q",
                    small: bool | None = None, extra: list[Column] | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles as an array column, one row per group (nulls ignored).

    ``extra`` are further aggregates over the same rows.  ``weight`` says how many times a row stands.

    ``percentile`` keeps every distinct value of a group in one task.  Beyond small inputs the
    values are counted per (group, value) first, ordered with :func:`sequence` (which splits a hot
    group), and only the two order statistics around each requested rank are kept.
    """
    df = df.where(F.col(value).isNotNull())
    if small is None:
        small = small_input(df)
    if small:
        times = F.col(weight) if weight else F.lit(1)
        return df.groupBy(*by).agg(F.percentile(value, [float(q) for q in qs], times).alias(name), *(extra or []))
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    if extra:
        src = materialize(src, "values")
    counts = materialize(src.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_w")), "value-counts")
    n = counts.groupBy(*keys).agg(F.sum("_w").alias("_n"))
    runs = S.sequence(counts, {"_hi": S.running_sum("_w")}, case=keys, order=(value,), chunk_rows=S.CHUNK_ROWS)
    runs = runs.join(n, keys)
    h = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    wanted = F.array(*[F.floor(x) for x in h], *[F.ceil(x) for x in h])
    lo = F.col("_hi") - F.col("_w")
    hits = runs.where(F.exists(wanted, lambda r: (r >= lo) & (r < F.col("_hi"))))
    parts = []
    for i, x in enumerate(h):
        for tag, r in (("f", F.floor(x)), ("c", F.ceil(x))):
            parts.append(F.max(F.when((r >= lo) & (r < F.col("_hi")), F.col(value).cast("double"))).alias(f"_{tag}{i}"))
        parts.append(F.max(x - F.floor(x)).alias(f"_g{i}"))
    out = hits.groupBy(*keys).agg(*parts)
    arr = F.array(*[F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * F.col(f"_g{i}") for i in range(len(qs))])
    if not extra:
        return out.select(*by, arr.alias(name))
    more = src.groupBy(*keys).agg(*extra)
    return out.select(*keys, arr.alias(name)).join(more, keys).drop("_all")


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """1-based average rank of ``value`` inside each group: rank + (ties - 1) / 2.

    Works on (group, value) counts, so ties cost nothing and a hot group is split by ``sequence``.
    """
    keys = by or ["_all"]
    src = stage_if_large(df if by else df.withColumn("_all", F.lit(0)), "values")
    counts = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    ranked = S.sequence(counts, {"_below": S.running_sum("_t", inclusive=False)}, case=keys, order=(value,))
    ranked = ranked.select(*keys, value, (F.col("_below") + (F.col("_t") + 1) / 2).alias(name))
    return src.join(ranked, [*keys, value]).drop("_all")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of a total order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def best_per_group(df: DataFrame, keys: list[str], order_struct: Column, cols: list[str]) -> DataFrame:
    """The row with the smallest ``order_struct`` per group, as a mergeable aggregate (no sort, no window)."""
    picked = F.min_by(F.struct(*cols), order_struct)
    return df.groupBy(*keys).agg(picked.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])
