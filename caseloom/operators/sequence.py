"""Ordered per-case columns (position, lag, lead, running values) that survive a hot case.

A plain ``Window.partitionBy(case)`` puts a whole case into one task.  That is fine until one
case holds a large share of all events.  :func:`sequence` therefore has two layouts:

* **plain** - one window per case; every ordered column shares a single exchange and sort.
* **chunked** - cases above ``chunk_rows`` are range-partitioned on ``(case, order)`` (Spark's range
  partitioner splits inside a case), written once, and each *chunk* gets its own window.  Chunk
  summaries (a few values per chunk) carry positions, heads, tails and running values across
  chunk borders.  All other cases keep the plain layout; both branches are unioned.

The results are identical; only the placement of the work differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.session import materialize, small_input

CHUNK_ROWS = 2_000_000


@dataclass(frozen=True)
class Spec:
    kind: str  # pos | len | lag | lead | first | last | sum | max | last_seen
    expr: Column | str | None = None
    k: int = 1
    inclusive: bool = True

    @property
    def col(self) -> Column:
        return F.col(self.expr) if isinstance(self.expr, str) else self.expr


def pos() -> Spec:
    return Spec("pos")


def length() -> Spec:
    return Spec("len")


def lag(c, k: int = 1) -> Spec:
    return Spec("lag", c, k)


def lead(c, k: int = 1) -> Spec:
    return Spec("lead", c, k)


def first(c) -> Spec:
    return Spec("first", c)


def last(c) -> Spec:
    return Spec("last", c)


def running_sum(c, inclusive: bool = True) -> Spec:
    return Spec("sum", c, inclusive=inclusive)


def running_max(c, inclusive: bool = True) -> Spec:
    return Spec("max", c, inclusive=inclusive)


def last_seen(c, inclusive: bool = True) -> Spec:
    """Most recent non-null value of ``c``."""
    return Spec("last_seen", c, inclusive=inclusive)


def _aliased(keys: list[str], order: list[str], specs: dict[str, Spec]) -> tuple[list[Column], dict[str, str]]:
    """Evaluate each distinct input expression once, under an internal name."""
    names: dict[str, str] = {}
    extra = []
    for name, s in specs.items():
        if s.expr is None:
            continue
        if isinstance(s.expr, str):
            names[name] = s.expr
        else:
            names[name] = f"_in_{name}"
            extra.append(s.col.alias(f"_in_{name}"))
    return extra, names


def _local(s: Spec, c: Column | None, w, upto, whole) -> Column:
    if s.kind == "pos":
        return (F.row_number().over(w) - 1).cast("long")
    if s.kind == "len":
        return F.count(F.lit(1)).over(whole)
    if s.kind == "lag":
        return F.lag(c, s.k).over(w)
    if s.kind == "lead":
        return F.lead(c, s.k).over(w)
    if s.kind == "first":
        return F.first(c).over(whole)
    if s.kind == "last":
        return F.last(c).over(whole)
    frame = upto if s.inclusive else w.rowsBetween(W.unboundedPreceding, -1)
    agg = {"sum": F.sum, "max": F.max}.get(s.kind)
    return agg(c).over(frame) if agg else F.last(c, ignorenulls=True).over(frame)


def _plain(df: DataFrame, keys, order, specs, names) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cols = {n: _local(s, F.col(names[n]) if n in names else None, w, upto, whole) for n, s in specs.items()}
    cols = {n: (F.coalesce(c, F.lit(0)) if specs[n].kind == "sum" else c) for n, c in cols.items()}
    return df.withColumns(cols)


def _chunked(df: DataFrame, keys, order, specs, names, n_chunks: int) -> DataFrame:
    staged = materialize(
        df.repartitionByRange(n_chunks, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), 33)),
        "chunks",
    )
    unit = [*keys, "_chunk"]
    w = W.partitionBy(*unit).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = {"_rn": F.row_number().over(w), "_cn": F.count(F.lit(1)).over(whole)}
    for n, s in specs.items():
        if s.kind in ("lag", "lead", "sum", "max", "last_seen"):
            local[f"_l_{n}"] = _local(s, F.col(names[n]), w, upto, whole)
    rows = staged.withColumns(local)

    # one summary row per chunk: its size, its border values, and its aggregates
    k_lag = max([s.k for s in specs.values() if s.kind == "lag"], default=0)
    k_lead = max([s.k for s in specs.values() if s.kind == "lead"], default=0)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for n, s in specs.items():
        c = F.col(names[n]) if n in names else None
        if s.kind == "sum":
            aggs.append(F.sum(c).alias(f"_a_{n}"))
        elif s.kind == "max":
            aggs.append(F.max(c).alias(f"_a_{n}"))
        elif s.kind == "last_seen":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col("_rn"))).alias(f"_a_{n}"))
        elif s.kind in ("first", "last"):
            by = F.min_by if s.kind == "first" else F.max_by
            aggs.append(by(F.struct(c.alias("v")), F.col("_rn")).alias(f"_a_{n}"))
        elif s.kind == "lag":
            near = F.when(F.col("_rn") > F.col("_cn") - k_lag, F.struct("_rn", c.alias("v")))
            aggs.append(F.sort_array(F.collect_list(near)).alias(f"_a_{n}"))
        elif s.kind == "lead":
            near = F.when(F.col("_rn") <= k_lead, F.struct("_rn", c.alias("v")))
            aggs.append(F.sort_array(F.collect_list(near)).alias(f"_a_{n}"))
    summary = rows.groupBy(*unit).agg(*aggs)

    cw = W.partitionBy(*keys).orderBy("_chunk")
    before = cw.rowsBetween(W.unboundedPreceding, -1)
    everything = cw.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry = {"_off": F.coalesce(F.sum("_cnt").over(before), F.lit(0)), "_tot": F.sum("_cnt").over(everything)}
    for n, s in specs.items():
        a = F.col(f"_a_{n}")
        if s.kind == "sum":
            carry[f"_c_{n}"] = F.sum(a).over(before)
        elif s.kind == "max":
            carry[f"_c_{n}"] = F.max(a).over(before)
        elif s.kind == "last_seen":
            carry[f"_c_{n}"] = F.last(a, ignorenulls=True).over(before)
        elif s.kind == "first":
            carry[f"_c_{n}"] = F.first(a).over(everything)
        elif s.kind == "last":
            carry[f"_c_{n}"] = F.last(a).over(everything)
        elif s.kind == "lag":  # every chunk has a row, so k chunks hold at least k values
            carry[f"_c_{n}"] = F.flatten(F.collect_list(a).over(cw.rowsBetween(-k_lag, -1)))
        elif s.kind == "lead":
            carry[f"_c_{n}"] = F.flatten(F.collect_list(a).over(cw.rowsBetween(1, k_lead)))
    borders = summary.withColumns(carry).select(*unit, *carry)
    joined = rows.join(F.broadcast(borders), unit, "left")  # rows / chunk_rows entries: bounded by construction

    out = {}
    for n, s in specs.items():
        c, l = F.col(f"_c_{n}"), F.col(f"_l_{n}")
        if s.kind == "pos":
            out[n] = (F.col("_rn") - 1 + F.col("_off")).cast("long")
        elif s.kind == "len":
            out[n] = F.col("_tot")
        elif s.kind in ("first", "last"):
            out[n] = c["v"]
        elif s.kind == "sum":
            out[n] = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif s.kind == "max":
            out[n] = F.greatest(l, c)
        elif s.kind == "last_seen":
            out[n] = F.coalesce(l, c)
        elif s.kind == "lag":
            idx = F.size(c) - (F.lit(s.k) - F.col("_rn"))  # 1-based from the left
            out[n] = F.when(F.col("_rn") > s.k, l).when((idx >= 1) & (idx <= F.size(c)), F.try_element_at(c, idx)["v"])
        elif s.kind == "lead":
            idx = F.lit(s.k) - (F.col("_cn") - F.col("_rn"))
            out[n] = F.when(idx <= 0, l).when(idx <= F.size(c), F.try_element_at(c, F.greatest(idx, F.lit(1)).cast("int"))["v"])
    return joined.withColumns(out)


def sequence(df: DataFrame, specs: dict[str, Spec], case="case_id", order=("us", "event_idx"),
             chunk_rows: int | None = None) -> DataFrame:
    """Add the ordered columns in ``specs`` to ``df``; ``(case, *order)`` must identify a row."""
    keys = [case] if isinstance(case, str) else list(case)
    order = list(order)
    base_cols = df.columns
    extra, names = _aliased(keys, order, specs)
    src = df.select("*", *extra) if extra else df
    keep = [*base_cols, *[n for n in specs if n not in base_cols]]

    limit = chunk_rows or CHUNK_ROWS
    if chunk_rows is None and small_input(df):
        return _plain(src, keys, order, specs, names).select(*keep)
    hot = materialize(df.groupBy(*keys).count().where(F.col("count") > limit), "hot")
    stats = hot.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).first()
    if not stats["n"]:
        return _plain(src, keys, order, specs, names).select(*keep)
    hot_keys = F.broadcast(hot.select(*keys))  # at most rows / chunk_rows keys
    n_chunks = int(stats["rows"] // limit) + 1
    big = _chunked(src.join(hot_keys, keys, "left_semi"), keys, order, specs, names, n_chunks).select(*keep)
    rest = _plain(src.join(hot_keys, keys, "left_anti"), keys, order, specs, names).select(*keep)
    return rest.unionByName(big)
