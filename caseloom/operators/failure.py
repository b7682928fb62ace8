"""Failure analysis of forecasts: derailment, loops, monotonicity, distance effects, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import distance_bucket, rnd
from caseloom.operators import metrics as me, sequence as S, sparse, transitions as tr
from caseloom.operators.frame import drop_event


# Words that mark an informative event in the process logs.
INFORMATIVE = ["REJECTED", "Queued", "Wait", "Send Reminder", "SAVED"]


def is_informative(label="activity", words: list[str] | None = None) -> Column:
    """Does the label contain one of the words?"""
    words = words or INFORMATIVE
    hit = F.col(label).contains(words[0])
    for w in words[1:]:
        hit = hit | F.col(label).contains(w)
    return hit


def derailment(pairs: DataFrame) -> DataFrame:
    """After the first wrong step (if it is not the last): mean error rate, share mostly wrong."""
    n = F.least(F.size("pred"), F.size("true"))
    wrong = F.zip_with(F.slice("pred", 1, n), F.slice("true", 1, n), lambda a, b: (a != b).cast("int"))
    d = pairs.select(wrong.alias("w")).withColumn("fw", F.array_position("w", 1))  # 1-based, 0 = none
    d = d.where((F.col("fw") > 0) & (F.col("fw") < F.size("w")))
    rest = F.slice("w", F.col("fw").cast("int") + 1, F.size("w"))
    rate = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)
    return d.select(rate.alias("r")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("r")).alias("error_after"), rnd(F.avg((F.col("r") > 0.5).cast("double"))).alias("derailed"))


def has_loop(arr: Column) -> Column:
    """The same label at least three times in a row."""
    run = F.exists(F.sequence(F.lit(1), F.size(arr) - 2), lambda i: (F.element_at(arr, i) == F.element_at(arr, i + 1)) & (F.element_at(arr, i + 1) == F.element_at(arr, i + 2)))
    return F.when(F.size(arr) >= 3, run).otherwise(F.lit(False))


def loop_share(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(has_loop(F.col("pred")).cast("double"))).alias("loop_share"))


def remaining_monotonicity(predicted: DataFrame) -> DataFrame:
    """Mean over complete cases (more than two events) of the share of steps whose predicted remaining time does not grow."""
    c = predicted.where(F.col("complete") & (F.col("n") > 2))
    c = S.sequence(c, {"_before": S.lag("rem_hat")}).where(F.col("_before").isNotNull())
    per = c.groupBy("case_id").agg(F.avg((F.col("rem_hat") <= F.col("_before")).cast("double")).alias("m"))
    return per.agg(rnd(F.avg("m")).alias("monotone"), F.count(F.lit(1)).alias("n_cases"))


def accuracy_by_distance(scored: DataFrame, informative: Column) -> DataFrame:
    """Accuracy by distance to the most recent earlier informative event; ``none`` when there is none yet."""
    s = S.sequence(scored, {"_last": S.last_seen(F.when(informative, F.col("pos")), inclusive=False)})
    s = s.where((F.col("pos") < F.col("n") - 1) & F.col("y_id").isNotNull())
    b = F.when(F.col("_last").isNull(), "none").otherwise(distance_bucket(F.col("pos") - F.col("_last")))
    return s.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("correct")).alias("accuracy"))


def forgetting(frame: DataFrame, m: tr.TransitionModel, informative: Column) -> DataFrame:
    """Mean KL between the forecasts with and without the first informative event, by distance from it."""
    firsts = frame.groupBy("case_id").agg(F.min(F.when(informative, F.col("pos"))).alias("i0"), F.count(F.lit(1)).alias("_len"))
    firsts = firsts.where((F.col("i0") > 0) & (F.col("i0") < F.col("_len") - 2) & (F.col("_len") >= 4))
    f = frame.join(firsts, "case_id")
    cols = tr.context_columns(m.order)
    base = tr.predict_next(f.where((F.col("pos") > F.col("i0")) & (F.col("pos") < F.col("n") - 1)).select("case_id", "pos", "i0", *cols), m)
    cut = tr.predict_next(drop_event(f, F.col("pos") == F.col("i0")).select("case_id", (F.col("pos") + 1).alias("pos"), *cols), m)
    j = base.join(cut.select("case_id", "pos", F.col("dist").alias("q")), ["case_id", "pos"])
    kl = sparse.divergence("dist", "q")
    return j.groupBy(distance_bucket(F.col("pos") - F.col("i0")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(kl)).alias("kl"))


def worst_suffixes(pairs: DataFrame, k: int = 3, min_len: int = 3) -> DataFrame:
    """The k prefixes with the least similar continuation among true suffixes of at least ``min_len`` events."""
    s = pairs.where(F.size("true") >= min_len).withColumn("sim", rnd(me.dl_similarity("pred", "true")))
    return s.orderBy("sim", "case_id", "pos").limit(k).select(
        "case_id", "pos", "sim", F.array_join("pred", ",").alias("pred"), F.array_join("true", ",").alias("true"))

