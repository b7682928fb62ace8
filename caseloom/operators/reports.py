"""Comparison tables over tidy metric rows (run, model, metric, value[, lo, hi, seed])."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import rnd
from caseloom.session import lookup_side


def model_rows(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per (run, model): a column per metric, plus its population deviation over seeds."""
    g = metrics.groupBy("run", "model")
    cols = []
    for n in names:
        v = F.when(F.col("metric") == n, F.col("value"))
        cols += [rnd(F.avg(v)).alias(n), rnd(F.stddev_pop(v)).alias(f"{n}_std")]
    return g.agg(*cols, F.count_distinct("seed").alias("n_seeds"))


def relative_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(y - x) / |x| per key; null where x is 0."""
    a = before.select(*keys, F.col("value").alias("x"))
    b = after.select(*keys, F.col("value").alias("y"))
    return a.join(b, keys).select(*keys, rnd("x").alias("x"), rnd("y").alias("y"),
                                  rnd(F.when(F.col("x") != 0, (F.col("y") - F.col("x")) / F.abs("x"))).alias("change"))


def fold_report(folds: DataFrame, published: DataFrame) -> DataFrame:
    """Mean and population deviation over folds per (model, metric), next to published values where known."""
    m = folds.groupBy("model", "metric").agg(rnd(F.avg("value")).alias("mean"), rnd(F.stddev_pop("value")).alias("std"), F.count(F.lit(1)).alias("n_folds"))
    return m.join(lookup_side(published, "published"), "metric", "left")


def add_sources(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
