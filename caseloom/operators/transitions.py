"""k-order transition tables with back-off: next label, waiting time, remaining time, intervals.

Counts are aggregated once per (context of the highest order, next label); lower orders are sums of
those few rows, so the facts are shuffled once, already combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.operators import sparse
from caseloom.operators.encode import Prepared
from caseloom.operators.ranking import exact_quantiles
from caseloom.session import lookup_side

REM_BUCKETS = 10


def context_columns(order: int) -> list[str]:
    """Label-id columns of the longest context, oldest first."""
    return [f"id{j}" for j in range(order - 1, 0, -1)] + (["act"] if order else [])


def context_key(order: int, k: int) -> Column:
    """Text key of the k most recent labels; null when the case has fewer than k events."""
    if k == 0:
        return F.lit("")
    cols = [F.col(c).cast("string") for c in context_columns(order)[order - k:]]
    return F.when(cols[0].isNotNull(), F.concat_ws(">", *cols))


def explode_contexts(df: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """One row per order 0..k with its context key (orders the case is too short for are dropped)."""
    ctx = F.array(*[F.struct(F.lit(k).alias("k"), context_key(order, k).alias("ctx")) for k in range(order + 1)])
    return df.select(*keep, F.explode(ctx).alias("_c")).select(*keep, "_c.k", "_c.ctx").where(F.col("ctx").isNotNull())


def transition_counts(train: DataFrame, order: int, weight: Column | None = None) -> DataFrame:
    """(k, ctx, y, n): next-label counts per context of every order."""
    w = F.sum(weight) if weight is not None else F.count(F.lit(1))
    base = train.where(F.col("y_id").isNotNull()).groupBy(*context_columns(order), "y_id").agg(w.alias("n"))
    return explode_contexts(base, order, ["y_id", "n"]).groupBy("k", "ctx", F.col("y_id").alias("y")).agg(F.sum("n").alias("n"))


def smooth(counts: DataFrame, size: int, alpha: float) -> DataFrame:
    """(k, ctx, total, dist): smoothed distribution per context, listing the classes that follow it (see ``sparse``)."""
    g = counts.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("y", "n"))).alias("_p"))
    return g.select("k", "ctx", "total", sparse.smoothed(F.col("_p"), F.col("total"), size, alpha).alias("dist"))


def floor_vectors(counts: DataFrame, size: int, floor: float = 1e-6) -> DataFrame:
    """(k, ctx, dist): shares of the classes that follow a context, ``floor`` for all others, scaled to sum to one."""
    g = counts.groupBy("k", "ctx").agg(F.sum("n").alias("_t"), F.sort_array(F.collect_list(F.struct("y", "n"))).alias("_p"))
    return g.select("k", "ctx", sparse.floored(F.col("_p"), F.col("_t"), size, floor).alias("dist"))


@dataclass
class TransitionModel:
    order: int
    alpha: float
    size: int
    counts: DataFrame  # k, ctx, y, n
    probs: DataFrame  # k, ctx, total, dist
    waits: DataFrame  # k, ctx, ldt array<q10, median, q90> of log1p seconds
    remains: DataFrame  # act, posb, rem_med
    remain_all: DataFrame  # one row: global median


def fit(train: DataFrame, size: int, order: int = 2, alpha: float = 0.1) -> TransitionModel:
    counts = transition_counts(train, order)
    return TransitionModel(order, alpha, size, counts, smooth(counts, size, alpha),
                           fit_waits(train, order), fit_remaining(train), fit_remaining_all(train))


def fit_prepared(p: Prepared, alpha: float = 0.1) -> TransitionModel:
    return fit(p.part("train"), p.size, p.order, alpha)


def fit_waits(train: DataFrame, order: int, qs=(0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of the log waiting time per context; with log1p taken first, as for the targets."""
    long = explode_contexts(train.where(F.col("y_ldt").isNotNull()), order, ["y_ldt"])
    return exact_quantiles(long, ["k", "ctx"], "y_ldt", list(qs), "ldt")


def _rem_rows(train: DataFrame) -> DataFrame:
    return train.where(F.col("y_rem").isNotNull()).select("act", F.least("pos", F.lit(REM_BUCKETS)).alias("posb"), "y_rem")


def fit_remaining(train: DataFrame) -> DataFrame:
    q = exact_quantiles(_rem_rows(train), ["act", "posb"], "y_rem", [0.5], "_q")
    return q.select("act", "posb", F.col("_q")[0].alias("rem_med"))


def fit_remaining_all(train: DataFrame) -> DataFrame:
    return exact_quantiles(_rem_rows(train), [], "y_rem", [0.5], "_q").select(F.col("_q")[0].alias("rem_all"))


def _full_key(order: int) -> Column:
    """The context a row actually has: up to ``order`` labels, fewer at the start of a case."""
    return F.concat_ws(">", *[F.col(c).cast("string") for c in context_columns(order)])


def _lookup_backoff(df: DataFrame, table: DataFrame, order: int, value: str, out: str) -> DataFrame:
    """Longest context present in ``table`` wins.

    Back-off is resolved once per *distinct* context (every order joined in one go, ``max_by`` keeps the
    longest hit); the rows then need a single join on their context.
    """
    cols = context_columns(order)
    keyed = df.withColumn("_key", _full_key(order))
    need = explode_contexts(keyed.select("_key", *cols).distinct(), order, ["_key"])
    best = need.join(table.select("k", "ctx", value), ["k", "ctx"]).groupBy("_key").agg(
        F.max_by(value, "k").alias(out), F.max("k").alias(f"{out}_k"))
    res = keyed.join(lookup_side(best, "contexts"), "_key", "left").drop("_key")
    return res.withColumn(f"{out}_k", F.coalesce(f"{out}_k", F.lit(-1)))


def predict_next(df: DataFrame, m: TransitionModel) -> DataFrame:
    """Add ``dist`` and the context order used; unseen everywhere means uniform.

    ``probs`` lists all classes; it is an expression on ``dist`` and costs nothing where it is not read.
    """
    out = _lookup_backoff(df, m.probs, m.order, "dist", "dist").withColumnRenamed("dist_k", "probs_k")
    return with_probs(out.withColumn("dist", F.coalesce("dist", sparse.uniform(m.size))))


def with_probs(df: DataFrame) -> DataFrame:
    return df.withColumn("probs", sparse.dense("dist"))


def predict_mean(df: DataFrame, models: list[TransitionModel]) -> DataFrame:
    """Add ``dist``, the mean forecast of several models, and ``mean_entropy`` of the single ones.

    Forecasts depend on the context alone, so models are looked up and mixed once per *distinct* context.
    """
    order = max(m.order for m in models)
    cols = context_columns(order)
    keyed = df.withColumn("_ck", _full_key(order))
    each = keyed.select("_ck", *cols).distinct()
    for i, m in enumerate(models):
        each = predict_next(each, m).drop("probs", "probs_k").withColumnRenamed("dist", f"_d{i}")
    all_ = F.array(*[F.col(f"_d{i}") for i in range(len(models))])
    mean = each.select("_ck", sparse.mixture(all_).alias("dist"), (sum([sparse.entropy(f"_d{i}") for i in range(len(models))], F.lit(0.0)) / len(models)).alias("mean_entropy"))
    return with_probs(keyed.join(lookup_side(mean, "mean-forecasts"), "_ck").drop("_ck"))


def predict_wait(df: DataFrame, m: TransitionModel) -> DataFrame:
    """Median waiting seconds and the 10-90 % interval per context."""
    out = _lookup_backoff(df, m.waits, m.order, "ldt", "_w")
    return out.withColumns({"dt_lo": F.expm1(F.col("_w")[0]), "dt_hat": F.expm1(F.col("_w")[1]), "dt_hi": F.expm1(F.col("_w")[2])}).drop("_w", "_w_k")


def predict_remaining(df: DataFrame, m: TransitionModel) -> DataFrame:
    key = df.withColumn("posb", F.least("pos", F.lit(REM_BUCKETS)))
    out = key.join(lookup_side(m.remains, "remaining"), ["act", "posb"], "left")
    return out.withColumn("rem_hat", F.coalesce("rem_med", m.remain_all.agg(F.max("rem_all").alias("v")).scalar(), F.lit(0.0))).drop("posb", "rem_med")


def compact(df: DataFrame, order: int, by: list[str] | None = None) -> DataFrame:
    """Scorable prefixes as (context, y, w): predictions depend on nothing else, so facts shrink before any join."""
    return df.where(F.col("y_id").isNotNull()).groupBy(*(by or []), *context_columns(order), "y_id").agg(F.count(F.lit(1)).alias("w"))


# ------------------------------------------------------------------ remaining-time distribution
def fit_laplace(train: DataFrame) -> DataFrame:
    """(act, posb, mu, b): Laplace fit of log1p remaining seconds; b has the floor exp(-1)."""
    rows = _rem_rows(train).withColumn("lr", F.log1p("y_rem"))
    mu = exact_quantiles(rows, ["act", "posb"], "lr", [0.5], "_q").select("act", "posb", F.col("_q")[0].alias("mu"))
    dev = rows.join(lookup_side(mu, "laplace"), ["act", "posb"])
    return dev.groupBy("act", "posb").agg(F.max("mu").alias("mu"), F.greatest(F.avg(F.abs(F.col("lr") - F.col("mu"))), F.exp(F.lit(-1.0))).alias("b"))


def laplace_sf(mu, b, x) -> Column:
    """P(X > x) of a Laplace(mu, b) variable."""
    mu, b, x = (F.col(c) if isinstance(c, str) else c for c in (mu, b, x))
    z = (x - mu) / b
    return F.when(x < mu, 1 - 0.5 * F.exp(z)).otherwise(0.5 * F.exp(-z))


# ------------------------------------------------------------------ class distributions
def ensemble(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distribution over the forecasts of each key; their number is that of the models."""
    return preds.groupBy(*keys).agg(F.collect_list("dist").alias("_d")).select(*keys, sparse.mixture(F.col("_d")).alias("dist"))


def argmax_table(m: TransitionModel) -> DataFrame:
    """(k, ctx, best): greedy next label per context, lowest id on ties."""
    return m.probs.select("k", "ctx", sparse.argmax("dist").alias("best"))


def component_counts(train: DataFrame, vocab: DataFrame, family: str, order: int = 1) -> DataFrame:
    """(component, y, n): next-label counts by component of the current label."""
    from caseloom.functions.columns import decompose_activity

    base = train.where(F.col("y_id").isNotNull()).groupBy("activity", "y_id").agg(F.count(F.lit(1)).alias("n"))
    return base.select(F.explode(decompose_activity("activity", family)).alias("component"), F.col("y_id").alias("y"), "n").groupBy(
        "component", "y").agg(F.sum("n").alias("n"))


def predict_components(df: DataFrame, m: TransitionModel, comp: DataFrame, family: str) -> DataFrame:
    """Back-off that passes through label components: a label never seen in training is still scored by
    the mean of its known components' distributions before falling back to order 0."""
    from caseloom.functions.columns import UNK, decompose_activity

    dist = smooth(comp.select(F.lit(1).alias("k"), F.col("component").alias("ctx"), "y", "n"), m.size, m.alpha)
    labels = df.where(F.col("act") == UNK).select("activity").distinct()
    parts = labels.select("activity", F.explode(decompose_activity("activity", family)).alias("ctx"))
    known = parts.join(lookup_side(dist.select("ctx", "dist"), "components"), "ctx")
    per = ensemble(known, ["activity"]).withColumnRenamed("dist", "_comp")
    out = predict_next(df, m).join(lookup_side(per, "unseen"), "activity", "left")
    return with_probs(out.withColumn("dist", F.when((F.col("act") == UNK) & F.col("_comp").isNotNull(), F.col("_comp")).otherwise(F.col("dist"))).drop("_comp"))


