"""Case-level splits by exact global rank; membership is a table, never a driver list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import hash_key, hash_order, rnd
from caseloom.operators.ranking import global_rank
from caseloom.operators.sequence import running_sum, sequence
from caseloom.session import lookup_side, materialize


def _hash_ranked(df: DataFrame, col: str, seed) -> DataFrame:
    """Distinct values of ``col`` with their hash-order ``rank`` and the number of values ``total``."""
    ids = df.select(col).distinct().withColumn("_h", hash_key(seed, col))
    return global_rank(ids, ["_h", col], total="total").drop("_h")


def _cut(ranked: DataFrame, fracs) -> DataFrame:
    n_tr, n_va = (F.floor(F.col("total") * F.lit(float(f))) for f in fracs)
    part = F.when(F.col("rank") < n_tr, "train").when(F.col("rank") < n_tr + n_va, "val").otherwise("test")
    return ranked.withColumn("split", part)


def split_random(events: DataFrame, seed: int = 0, fracs=(0.7, 0.15)) -> DataFrame:
    """(case_id, split): cases in md5 order, cut at int(n * fraction)."""
    return _cut(_hash_ranked(events, "case_id", seed), fracs).select("case_id", "split")


def assign_random(events: DataFrame, seed: int = 0, fracs=(0.7, 0.15)) -> DataFrame:
    """Events with a ``split`` column, equal to joining :func:`split_random` but without a join.

    Only the case ids are ranked; the two cut points (hash, case_id) are one small row, and every event is
    placed by comparing its own case against them, so the facts are not shuffled.
    """
    r = global_rank(events.select("case_id").distinct().withColumn("_h", hash_key(seed, "case_id")), ["_h", "case_id"], total="total")
    n_tr, n_va = (F.floor(F.col("total") * F.lit(float(f))) for f in fracs)
    key = F.struct(F.col("_h").alias("h"), F.col("case_id").alias("c"))
    cut = r.agg(F.min(F.when(F.col("rank") >= n_tr, key)).alias("val"), F.min(F.when(F.col("rank") >= n_tr + n_va, key)).alias("test")).first()

    def from_cut(c) -> Column:
        if c is None:
            return F.lit(False)
        return (F.col("_h") > c["h"]) | ((F.col("_h") == c["h"]) & (F.col("case_id") >= F.lit(c["c"])))

    part = F.when(from_cut(cut["test"]), "test").when(from_cut(cut["val"]), "val").otherwise("train")
    return events.withColumn("_h", hash_key(seed, "case_id")).withColumn("split", part).drop("_h")


def split_chronological(cases: DataFrame, fracs=(0.7, 0.15)) -> DataFrame:
    """(case_id, first_us, last_us, split): cases by (start, case_id)."""
    c = cases.select("case_id", "first_us", "last_us")
    return _cut(global_rank(c, ["first_us", "case_id"], total="total"), fracs).select("case_id", "first_us", "last_us", "split")


def chronological_meta(split: DataFrame) -> DataFrame:
    """Cutoff, last train start, and the share of train cases reaching into the test window."""
    s = split.groupBy("split").agg(F.min("first_us").alias("lo"), F.max("first_us").alias("hi"))
    cutoff = s.where(F.col("split") == "test").agg(F.max("lo").alias("c")).scalar()
    return split.where(F.col("split") == "train").agg(
        F.max("first_us").alias("train_end_us"), F.count(F.lit(1)).alias("n_train"),
        F.count_if(F.col("last_us") >= cutoff).alias("n_overlap"), F.max(cutoff).alias("cutoff_us"),
    ).withColumn("overlap_frac", rnd(F.col("n_overlap") / F.greatest(F.col("n_train"), F.lit(1))))


def split_cv(events: DataFrame, fold: int, n_folds: int = 5, seed: int = 0, val_frac: float = 0.2) -> DataFrame:
    """k-fold split: fold sizes as equal as possible (the first n % k folds get one more); the rest is re-ordered for val/train."""
    r = _hash_ranked(events, "case_id", seed)
    small, extra = F.floor(F.col("total") / n_folds), F.col("total") % n_folds
    edge = extra * (small + 1)
    f = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(
        extra + F.floor((F.col("rank") - edge) / F.greatest(small, F.lit(1))))
    r = r.select("case_id", f.cast("int").alias("fold"))
    rest = r.where(F.col("fold") != fold).withColumn("_h", hash_key(seed + 1000 + fold, "case_id"))
    rest = global_rank(rest, ["_h", "case_id"], total="total")
    rest = rest.withColumn("split", F.when(F.col("rank") < F.floor(F.col("total") * val_frac), "val").otherwise("train"))
    test = r.where(F.col("fold") == fold).withColumn("split", F.lit("test"))
    return rest.select("case_id", "fold", "split").unionByName(test)


def leaked_cases(split: DataFrame) -> DataFrame:
    """Cases present in more than one part (must be empty)."""
    return split.groupBy("case_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where(F.col("a") != F.col("b"))


def fingerprint(split: DataFrame) -> DataFrame:
    """Order-free fingerprint: xor of 60-bit md5 prefixes of split:case_id, with the count."""
    h = hash_order("fp", "split", "case_id")
    return split.agg(F.bit_xor(h).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def split_groups(df: DataFrame, group: str, held_frac: float = 0.25, seed: int = 0) -> DataFrame:
    """Rows with a ``part`` column: whole groups held out, max(1, int(n * f)) of them, none if there is one group."""
    r = _hash_ranked(df, group, seed)
    n_held = F.when(F.col("total") > 1, F.greatest(F.lit(1), F.floor(F.col("total") * held_frac))).otherwise(0)
    held = r.select(group, F.when(F.col("rank") < n_held, "heldout").otherwise("train").alias("part"))
    return df.join(lookup_side(held, "groups"), group)


def select_groups(df: DataFrame, group: str, budget: int, seed: int = 0, chunk_rows: int | None = None) -> DataFrame:
    """Whole groups in hash order, each taken if it still fits into ``budget`` rows and skipped otherwise.

    One row per taken group: ``size`` and ``total``, the rows taken so far.  Null is a group of its own; a budget below
    one takes nothing.

    Let lo be the power of two with lo <= rest < 2 lo.  Until the rest falls below lo, each group smaller than lo fits,
    and no more than one of the others does, as it brings the rest below lo.  One pass of running sums over the groups
    finds where that happens, so there are at most log2(budget) + 1 passes however many groups are skipped.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_h", hash_key(seed, group))
    ranked = materialize(global_rank(sizes, ["_h", group], name="_rank").select(group, "size", "_rank", F.lit(0).alias("_all")), "groups")
    rest, at, taken = int(budget), 0, F.lit(False)
    while rest >= 1:
        lo = 1 << rest.bit_length() - 1
        open_ = ranked.where((F.col("_rank") >= at) & (F.col("size") <= rest))
        small = F.col("size") < lo
        runs = sequence(open_, {"_before": running_sum(F.when(small, F.col("size")).otherwise(0), inclusive=False)},
                        case="_all", order=("_rank",), chunk_rows=chunk_rows)
        left = F.lit(rest) - F.col("_before") - F.col("size")
        turn = runs.where(F.when(small, left < lo).otherwise(left >= 0)).agg(F.min(F.struct("_rank", left.alias("left"))).alias("t")).first()["t"]
        ahead = (F.col("_rank") >= at) & (F.col("size") < lo)
        if turn is None:  # the small groups end before the rest falls below lo
            taken = taken | ahead
            break
        taken = taken | (ahead & (F.col("_rank") < turn["_rank"])) | (F.col("_rank") == turn["_rank"])
        rest, at = turn["left"], turn["_rank"] + 1
    out = sequence(ranked.where(taken), {"total": running_sum("size")}, case="_all", order=("_rank",), chunk_rows=chunk_rows)
    return out.select(group, "size", "total")


def few_shot(train: DataFrame, frac: float = 0.05, at_least: int = 20, seed: int = 0) -> DataFrame:
    """max(int(n * f), at_least) cases of a train part, in hash order."""
    r = _hash_ranked(train, "case_id", seed)
    return r.where(F.col("rank") < F.greatest(F.floor(F.col("total") * frac), F.lit(at_least))).select("case_id")


def sample_prefixes(prefixes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` evaluation prefixes without replacement (a sampling operator; n is its parameter)."""
    return prefixes.withColumn("_h", hash_key(seed, "case_id", "pos")).orderBy("_h", "case_id", "pos").limit(n).drop("_h")


def statistics(frame: DataFrame, split: DataFrame) -> DataFrame:
    """Cases, prefixes and complete share per part."""
    return frame.join(split.select("case_id", "split"), "case_id").groupBy("split").agg(
        F.count_distinct("case_id").alias("n_cases"), F.count("y").alias("n_prefixes"),
        rnd(F.sum(((F.col("pos") == 0) & F.col("complete")).cast("double")) / F.sum((F.col("pos") == 0).cast("double"))).alias("complete_share"))


def cutoff(split: DataFrame) -> Column:
    """Start of the first test case, as a scalar sub-query."""
    return split.where(F.col("split") == "test").agg(F.min("first_us").alias("c")).scalar()


def strict_events(events: DataFrame, split: DataFrame) -> DataFrame:
    """Train and validation events before the cutoff, test events whole; ``_full`` is the uncut case length."""
    ev = events.join(lookup_side(split.select("case_id", "split"), "split"), "case_id")
    return ev.where((F.col("split") == "test") | (F.col("us") < cutoff(split)))


def strict_counts(events: DataFrame, split: DataFrame) -> DataFrame:
    """Dropped and truncated cases per non-test part."""
    ev = events.join(lookup_side(split.select("case_id", "split"), "split"), "case_id").where(F.col("split") != "test")
    per = ev.withColumn("_c", cutoff(split)).groupBy("split", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("us") < F.col("_c")).alias("kept"))
    return per.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("kept") == 0).alias("n_dropped"),
        F.count_if((F.col("kept") > 0) & (F.col("kept") < F.col("n"))).alias("n_truncated"), F.sum("kept").alias("n_events"))
