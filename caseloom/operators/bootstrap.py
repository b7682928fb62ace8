"""Case-level (cluster) bootstrap.

:func:`replicates` draws case numbers and joins them.  The ``split_`` forms need no draws: how often each case stands in a
replicate follows from hashes alone.  All draws of a replicate go down a binary tree over blocks of cases; each node
splits its draws by a binomial number whose generator is keyed by (seed, replicate, node), so both halves always add up
and every task finds the same numbers.  Inside its block a case's count comes from the block's own generator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.functions.pyfuncs import by_value
from caseloom.functions.columns import hash_order, hash_unit, rnd
from caseloom.operators.ranking import exact_quantiles, global_rank
from caseloom.session import lookup_side, materialize


def case_sums(df: DataFrame, value: str, case: str = "case_id") -> DataFrame:
    """(case, s, c): only these sums enter the resampling, never the rows."""
    return df.groupBy(case).agg(F.sum(value).alias("s"), F.count(value).alias("c"))


def replicates(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 300, seed: int = 0) -> DataFrame:
    """(b, m): replicate means over whole cases drawn with replacement.

    Each replicate draws as many cases as there are; a draw is a hash of (replicate, slot), so lost
    tasks recompute the same draws.  Draws are spread over the case slots, then joined on the index.
    """
    sums = global_rank(case_sums(df, value, case), [case], "idx", total="total")
    slots = sums.select(F.col("idx").alias("slot"), "total", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = slots.select("b", (hash_order(seed, "b", "slot") % F.col("total")).alias("idx"))
    side = lookup_side(sums.select("idx", "s", "c"), "boot")
    return draws.join(side, "idx").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))


def bootstrap_mean(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 300, seed: int = 0) -> DataFrame:
    """Mean and 95 % percentile interval from ``n_boot`` resamples of whole cases."""
    return _interval(df, value, replicates(df, value, case, n_boot, seed))


def bootstrap_mean_poisson(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 300, seed: int = 0) -> DataFrame:
    """The same interval with independent Poisson(1) case weights: no draw table and no join, for very many cases."""
    sums = case_sums(df, value, case)
    reps = sums.select(case, "s", "c", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    u = hash_unit(seed, "b", case)
    # inverse distribution function of Poisson(1); mass beyond 8 is below 2e-6
    cdf, p, k = [], 0.36787944117144233, 0
    acc = p
    while k < 9:
        cdf.append(acc)
        k += 1
        p /= k
        acc += p
    weight = sum([(u >= c).cast("int") for c in cdf[1:]], (u >= cdf[0]).cast("int"))
    reps = reps.withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m"))
    return _interval(df, value, reps)


#: Cases of a block, the leaf of the splitting tree.
BLOCK = 1024


def block_draws(total: int, block: int, replicate: int, seed: int, size: int = BLOCK) -> int:
    """Draws of a replicate (as many as cases) that fall into a block of cases."""
    lo, hi, draws = 0, -(-total // size), total
    while hi - lo > 1 and draws:
        mid = (lo + hi) // 2
        share = (mid - lo) * size / (min(hi * size, total) - lo * size)
        left = int(np.random.default_rng([seed, replicate, lo, hi]).binomial(draws, share))
        lo, hi, draws = (lo, mid, left) if block < mid else (mid, hi, draws - left)
    return draws


def block_counts(total: int, block: int, n_boot: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """(replicate, case of the block): how often each case is drawn."""
    cases = min(size, total - block * size)
    out = np.zeros((n_boot, cases), np.int64)
    for b in range(n_boot):
        k = block_draws(total, block, b, seed, size)
        out[b] = np.bincount(np.random.default_rng([seed, b, block]).integers(0, cases, k), minlength=cases)
    return out


class _Counts:
    """Counts of the block last asked for; rows come in order of case number."""

    def __init__(self, n_boot: int, seed: int, size: int):
        self.n_boot, self.seed, self.size, self.at, self.held = n_boot, seed, size, None, None

    def of(self, idx: np.ndarray, total: int) -> np.ndarray:
        """(replicate, row) of a batch."""
        out = np.empty((self.n_boot, len(idx)), np.int64)
        for block in np.unique(idx // self.size):
            if self.at != (total, block):
                self.at, self.held = (total, block), block_counts(total, int(block), self.n_boot, self.seed, self.size)
            mine = idx // self.size == block
            out[:, mine] = self.held[:, idx[mine] % self.size]
        return out


def split_replicates(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 300, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(b, m, cases): replicate means over whole cases drawn with replacement; ``cases`` drawn are as many as there are.

    Tasks send one row per replicate, whatever the number of cases; there is no join.  A case without a value counts as
    drawn and adds nothing.
    """
    sums = global_rank(case_sums(df, value, case), [case], "idx", total="total")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = _Counts(n_boot, seed, block), np.zeros((3, n_boot))
        for b in batches:
            s, c, idx, total = (b.column(x).to_numpy(zero_copy_only=False) for x in ("s", "c", "idx", "total"))
            if len(idx):
                w = counts.of(idx, int(total[0]))
                part += [(w * np.nan_to_num(s.astype(float))).sum(axis=1), (w * c).sum(axis=1), w.sum(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot), pa.int32()), pa.array(part[0]), pa.array(part[1]), pa.array(part[2])], names=["b", "s", "c", "k"])

    parts = sums.select("s", "c", "idx", "total").mapInArrow(by_value(work), "b int, s double, c double, k double")
    return parts.groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"), F.sum("k").cast("long").alias("cases")).where("cases > 0")


def split_bootstrap_mean(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 300, seed: int = 0) -> DataFrame:
    """Mean and 95 % percentile interval from :func:`split_replicates`."""
    return _interval(df, value, split_replicates(df, value, case, n_boot, seed).drop("cases"))


def split_bootstrap_median(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 100, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Median and its interval by counts of the splitting tree; see :func:`replicate_medians`."""
    cases = global_rank(df.select(case).distinct(), [case], "idx", total="total")
    rows = df.where(F.col(value).isNotNull()).groupBy(case, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).join(cases.hint("merge"), case)
    rows = rows.select("v", "n", "idx", "total").repartitionByRange("idx").sortWithinPartitions("idx")

    def counted():
        counts = _Counts(n_boot, seed, block)

        def draws(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n, idx, total = (part.column(x).to_numpy(zero_copy_only=False) for x in ("n", "idx", "total"))
            w = counts.of(idx, int(total[0])) * n
            rep, row = np.nonzero(w)
            return rep, row, w[rep, row]

        return draws

    return _median_interval(df, value, replicate_medians(rows, counted, n_boot))


#: Ranges of values in the first pass of :func:`replicate_medians`, and rows expanded at once.
RANGES, STEP = 1024, 2000


def replicate_medians(rows: DataFrame, draws: Callable, n_boot: int, ranges: int = RANGES) -> DataFrame:
    """(b, m): weighted median of every replicate, exact, without a row per draw.

    ``rows`` has a double ``v`` without nulls.  ``draws()`` makes a function from a batch to the arrays (replicate, row of
    the batch, weight).  The first pass sums weights by (replicate, range of values) inside each task.  The second one
    counts values in the one or two ranges where a replicate's middle ranks fall.  The cut points are approximate
    quantiles, so that ranges are even; the medians are the same for any.
    """
    rows = materialize(rows, "resampled")
    cuts = rows.agg(F.percentile_approx("v", [(i + 1) / ranges for i in range(ranges - 1)], 10 * ranges)).first()[0]
    cuts = np.unique(np.array(cuts or [], float))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(replicate, range, value, weight) of a few rows at a time."""
        of = draws()
        for b in batches:
            for part in (b.slice(k, STEP) for k in range(0, len(b), STEP)):
                v = part.column("v").to_numpy(zero_copy_only=False)
                rep, row, w = of(part)
                yield rep, np.searchsorted(cuts, v)[row], v[row], w

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(cuts) + 1
        total = np.zeros(n_boot * width, np.int64)
        for rep, r, _, w in expand(batches):
            total += np.bincount(rep * width + r, w, len(total)).astype(np.int64)
        cell = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell // width, pa.int32()), pa.array(cell % width, pa.int32()), pa.array(total[cell])], names=["b", "r", "w"])

    cells = rows.mapInArrow(by_value(weigh), "b int, r int, w long").groupBy("b", "r").agg(F.sum("w").alias("w"))
    order = W.partitionBy("b").orderBy("r")  # at most ``ranges`` rows
    cells = cells.select("b", "r", "w", F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"),
                         F.sum("w").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    half = (F.col("n") - 1) / 2
    holds = lambda rank, lo, hi: (rank >= lo) & (rank < hi)
    end = F.col("below") + F.col("w")
    wanted = cells.where(holds(F.floor(half), F.col("below"), end) | holds(F.ceil(half), F.col("below"), end)).drop("w")
    wanted = materialize(wanted, "middle-ranges")  # one or two rows a replicate
    open_ = np.zeros((n_boot, len(cuts) + 1), bool)
    for x in wanted.select("b", "r").collect():
        open_[x.b, x.r] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, r, v, w in expand(batches):
            k = open_[rep, r]
            yield pa.RecordBatch.from_arrays([pa.array(rep[k], pa.int32()), pa.array(r[k], pa.int32()), pa.array(v[k]), pa.array(w[k], pa.int64())], names=["b", "r", "v", "w"])

    near = rows.mapInArrow(by_value(count), "b int, r int, v double, w long").groupBy("b", "r", "v").agg(F.sum("w").alias("w")).join(F.broadcast(wanted), ["b", "r"])
    hi = F.col("below") + F.sum("w").over(W.partitionBy("b", "r").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = near.select("b", "v", "n", (hi - F.col("w")).alias("lo"), hi.alias("hi"))
    at = lambda rank: F.max(F.when(holds(rank, F.col("lo"), F.col("hi")), F.col("v")))
    out = near.groupBy("b").agg(at(F.floor(half)).alias("x"), at(F.ceil(half)).alias("y"), F.max(half - F.floor(half)).alias("g"))
    return out.select("b", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * F.col("g")).alias("m"))


def _median_interval(df: DataFrame, value: str, reps: DataFrame) -> DataFrame:
    mid = exact_quantiles(df, [], value, [0.5], "_q").agg(F.max(F.col("_q")[0]).alias("m")).scalar()
    q = F.percentile("m", [0.025, 0.975])
    return reps.agg(rnd(F.max(mid)).alias("median"), rnd(q[0]).alias("lo"), rnd(q[1]).alias("hi"), F.count(F.lit(1)).alias("n_boot"))


def _interval(df: DataFrame, value: str, reps: DataFrame) -> DataFrame:
    """n_boot replicate means: a bounded table, so the built-in percentile is enough."""
    mean = df.agg(F.avg(value).alias("m")).scalar()
    q = F.percentile("m", [0.025, 0.975])
    return reps.agg(rnd(F.max(mean)).alias("mean"), rnd(q[0]).alias("lo"), rnd(q[1]).alias("hi"), F.count(F.lit(1)).alias("n_boot"))


def drawn_rows(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 100, seed: int = 0) -> DataFrame:
    """(v, bs): value of each row and the replicates that drew its case, once per draw.

    File sizes say little about draws, so the joins are named: Spark would broadcast them.
    """
    cases = global_rank(df.select(case).distinct(), [case], "idx", total="total")
    slots = cases.select(F.col("idx").alias("slot"), "total", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = slots.select("b", (hash_order(seed, "b", "slot") % F.col("total")).alias("idx")).groupBy("idx").agg(F.collect_list("b").alias("bs"))
    known = cases.select(case, "idx").join(draws.hint("merge"), "idx").drop("idx")
    rows = df.where(F.col(value).isNotNull()).select(case, F.col(value).cast("double").alias("v"))
    return rows.join(known.hint("merge"), case).select("v", "bs")


def bootstrap_median(df: DataFrame, value: str, case: str = "case_id", n_boot: int = 100, seed: int = 0) -> DataFrame:
    """Median and its interval by the draws of :func:`replicates`; see :func:`replicate_medians`."""

    def listed():
        def draws(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            bs = part.column("bs")
            rep = bs.flatten().to_numpy(zero_copy_only=False)
            return rep, np.repeat(np.arange(len(part)), bs.value_lengths().to_numpy(zero_copy_only=False)), np.ones(len(rep), np.int64)

        return draws

    return _median_interval(df, value, replicate_medians(drawn_rows(df, value, case, n_boot, seed), listed, n_boot))
