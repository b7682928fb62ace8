"""Evaluation metrics as weighted aggregates.

Scored tables carry ``y_id``, optionally ``w``, and a forecast: ``dist`` (see ``sparse``) or, from learners, dense ``probs``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from caseloom.functions import pyfuncs
from caseloom.functions.pyfuncs import by_value
from caseloom.functions.columns import EOS, first_argmax, prefix_bucket, rnd
from caseloom.operators import sparse
from caseloom.operators.ranking import average_rank, exact_quantiles
from caseloom.session import stage_if_large

TEMPERATURES = [0.3 + 0.7 * i / 14 for i in range(15)] + [1.0 + 3.0 * i / 30 for i in range(31)]


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def clip(p: Column, eps: float = 1e-12) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0))


def entropy(probs: Column, bits: bool = False) -> Column:
    log = F.log2 if bits else F.ln
    return -_sum(F.transform(probs, lambda p: p * log(clip(p))))


def score(df: DataFrame) -> DataFrame:
    """Per-row quantities every metric needs: p_y, pred, conf, correct, rank of the truth, entropy, Brier."""
    if "w" not in df.columns:
        df = df.withColumn("w", F.lit(1))
    if "dist" in df.columns:  # no list of all classes
        df = df.withColumns({"p_y": sparse.prob("dist", "y_id"), "pred": sparse.argmax("dist")})
        return df.withColumns({
            "nll": -F.ln(clip(F.col("p_y"))), "conf": sparse.top("dist"), "rank_y": sparse.rank("dist", "y_id"), "entropy": sparse.entropy("dist"),
            "brier": sparse.over("dist", lambda p: p * p) - 2 * F.col("p_y") + 1, "correct": (F.col("pred") == F.col("y_id")).cast("double")})
    p = F.col("probs")
    py = F.element_at(p, F.col("y_id") + 1)
    # classes placed before the truth: larger probability, or equal with a lower index
    ahead = F.size(F.filter(p, lambda x, i: (x > py) | ((x == py) & (i < F.col("y_id")))))
    return df.withColumns({
        "p_y": py, "nll": -F.ln(clip(py)), "pred": first_argmax(p), "conf": F.array_max(p), "rank_y": ahead,
        "entropy": entropy(p), "brier": _sum(F.transform(p, lambda x: x * x)) - 2 * py + 1,
    }).withColumn("correct", (F.col("pred") == F.col("y_id")).cast("double"))


def wavg(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c * F.col("w")) / F.sum("w")


def next_label(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = F.col("w")
    hit = F.sum(F.when((F.col("pred") == EOS) & (F.col("y_id") == EOS), w).otherwise(0))
    true_eos, pred_eos = F.sum(F.when(F.col("y_id") == EOS, w).otherwise(0)), F.sum(F.when(F.col("pred") == EOS, w).otherwise(0))
    return scored.groupBy(*(by or [])).agg(
        F.sum("w").alias("n"), rnd(wavg("nll")).alias("nll"), rnd(wavg("correct")).alias("accuracy"),
        rnd(wavg((F.col("rank_y") < 3).cast("double"))).alias("top3_accuracy"),
        rnd(hit / F.greatest(true_eos, F.lit(1))).alias("eos_recall"), rnd(hit / F.greatest(pred_eos, F.lit(1))).alias("eos_precision"),
        rnd(wavg("brier")).alias("brier"), rnd(wavg(F.col("entropy") / F.ln(F.lit(2.0)))).alias("entropy_bits"))


def macro_f1(scored: DataFrame) -> DataFrame:
    """Mean F1 over classes present in truth or prediction; works on the confusion counts."""
    conf = scored.groupBy("pred", "y_id").agg(F.sum("w").alias("n"))
    ok = F.col("pred") == F.col("y_id")
    sides = F.explode(F.array(
        F.struct(F.col("y_id").alias("cls"), F.when(ok, F.col("n")).otherwise(0).alias("tp"), F.when(ok, 0).otherwise(F.col("n")).alias("miss")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(ok, 0).otherwise(F.col("n")).alias("miss"))))
    per = conf.select(sides.alias("s")).select("s.*").groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("miss").alias("miss"))
    return per.agg(rnd(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("miss")))).alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def reliability(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Reliability table of the top-1 confidence."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(wavg("conf").alias("confidence"), wavg("correct").alias("accuracy"), F.sum("w").alias("n"))


def ece(scored: DataFrame, bins: int = 15) -> DataFrame:
    r = reliability(scored, bins)
    return r.agg(rnd(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def temper(probs: Column, t: Column) -> Column:
    z = F.transform(probs, lambda p: F.ln(clip(p)) / t)
    e = sparse.bind(z, lambda x: sparse.bind(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return sparse.bind(e, lambda x: sparse.bind(_sum(x), lambda s: F.transform(x, lambda v: v / s)))


def temperature_curve(scored: DataFrame) -> DataFrame:
    """(i, t, nll) over the fixed grid; the grid is an array literal, so nothing is joined."""
    grid = F.posexplode(F.array(*[F.lit(t) for t in TEMPERATURES])).alias("i", "t")
    if "dist" in scored.columns:
        rows = scored.select("dist", "y_id", "w", grid)
        nll = sparse.log_scale("dist", "t") - F.ln(clip(sparse.prob("dist", "y_id"))) / F.col("t")
    else:
        rows = scored.select("probs", "y_id", "w", grid)
        z = F.transform(F.col("probs"), lambda p: F.ln(clip(p)) / F.col("t"))
        nll = sparse.bind(z, lambda x: sparse.bind(F.array_max(x), lambda m: m + F.ln(_sum(F.transform(x, lambda v: F.exp(v - m))))) - F.element_at(x, F.col("y_id") + 1))
    return rows.withColumn("nll", nll).groupBy("i", "t").agg(wavg("nll").alias("nll"))


def fit_temperature(scored: DataFrame) -> DataFrame:
    """One row: the temperature with the smallest validation NLL, first on ties."""
    return temperature_curve(scored).agg(F.min_by("t", F.struct(F.round("nll", 12), "i")).alias("temperature"))


def apply_temperature(df: DataFrame, temperature: DataFrame) -> DataFrame:
    t = temperature.agg(F.max("temperature").alias("t")).scalar()
    df = df.withColumn("_t", t)
    if "dist" in df.columns:
        df = df.withColumn("dist", sparse.temper("dist", "_t"))
        return df.withColumn("probs", sparse.dense("dist")).drop("_t")
    return df.withColumn("probs", temper(F.col("probs"), F.col("_t"))).drop("_t")


def by_prefix_length(scored: DataFrame) -> DataFrame:
    return scored.groupBy(prefix_bucket(F.col("pos") + 1).alias("bucket")).agg(
        F.sum("w").alias("n"), rnd(wavg("correct")).alias("accuracy"), rnd(wavg("nll")).alias("nll"))


# ------------------------------------------------------------------ time
def time_errors(df: DataFrame, pred: str, true: str) -> DataFrame:
    e = df.where(F.col(true).isNotNull()).withColumn("_e", F.abs(F.col(pred) - F.col(true)) / 3600)
    med = exact_quantiles(e, [], "_e", [0.5], "_m").agg(F.max(F.col("_m")[0]).alias("m")).scalar()
    return e.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("_e")).alias("mae_h"), rnd(F.max(med)).alias("medae_h"),
                 rnd(F.avg(F.abs(F.log1p(F.greatest(F.col(pred), F.lit(0.0))) - F.log1p(true)))).alias("mae_log1p"))


def interval(df: DataFrame, lo: str, hi: str, true: str) -> DataFrame:
    rows = df.where(F.col(true).isNotNull())
    inside = ((F.col(true) >= F.col(lo)) & (F.col(true) <= F.col(hi))).cast("double")
    return rows.agg(rnd(F.avg(inside)).alias("coverage"), rnd(F.avg(F.col(hi) - F.col(lo)) / 3600).alias("width_h"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sequences
def _dl_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(tuple(x), tuple(y)) for x, y in zip(a, b)]
    index: dict = {}
    at = [index.setdefault(p, len(index)) for p in pairs]
    return pd.Series(pyfuncs.similarities(list(index))[at] if at else [], dtype="float64")


def _medoid_batch(samples: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(pyfuncs.medoids(list(samples)), columns=["medoid", "mean_pair"])


def dl_similarity(a, b) -> Column:
    """Normalised Damerau-Levenshtein similarity of two id arrays, in Arrow batches; a repeated pair is scored once per batch,
    and the pairs of a batch are scored together."""
    return F.pandas_udf(by_value(_dl_batch), T.DoubleType())(a, b)


def pair_similarity(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pred, true, w, sim): different pairs with their weight, each scored once."""
    pairs = df.groupBy(*(by or []), "pred", "true").agg(F.count(F.lit(1)).alias("w"))
    return pairs.withColumn("sim", dl_similarity("pred", "true"))


def similarity_by_length(df: DataFrame) -> DataFrame:
    pairs = pair_similarity(df.withColumn("bucket", prefix_bucket(F.col("pos") + 1)), ["bucket"])
    return pairs.groupBy("bucket").agg(rnd(wavg("sim")).alias("similarity"), F.sum("w").alias("n"))


def medoid(samples) -> Column:
    """struct<medoid, mean_pair> of a short array of id arrays."""
    out = T.StructType([T.StructField("medoid", T.IntegerType()), T.StructField("mean_pair", T.DoubleType())])
    return F.pandas_udf(by_value(_medoid_batch), out)(samples)


def suffix_report(df: DataFrame, max_len: int, terminal_ids: list[int]) -> DataFrame:
    """Similarity, exact match, termination and coherence of predicted suffixes (``pred``/``true`` id arrays)."""
    s = pair_similarity(df)
    head = F.slice("pred", 1, F.greatest(F.size("pred") - 1, F.lit(0)))
    cont = F.exists(head, lambda a: a.isin(terminal_ids))
    return s.agg(
        F.sum("w").alias("n"), rnd(wavg("sim")).alias("similarity"), rnd(wavg((F.col("pred") == F.col("true")).cast("double"))).alias("exact"),
        rnd(wavg((F.size("pred") < max_len).cast("double"))).alias("terminated"), rnd(wavg(cont.cast("double"))).alias("post_terminal"),
        rnd(wavg(F.size("pred"))).alias("len_pred"), rnd(wavg(F.size("true"))).alias("len_true"))


def step_errors(df: DataFrame, steps: int = 15) -> DataFrame:
    """Error rate at each step of the continuation, over rows long enough on both sides."""
    n = F.least(F.size("pred"), F.size("true"))
    flags = F.zip_with(F.slice("pred", 1, n), F.slice("true", 1, n), lambda a, b: (a != b).cast("double"))
    long = df.select(F.posexplode(flags).alias("step", "err")).where(F.col("step") < steps)
    return long.groupBy("step").agg(rnd(F.avg("err")).alias("err"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ binary scorers
def binary_report(df: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """AUROC, average precision, log loss, accuracy at 0.5 and majority accuracy from (score, positives, total) counts.

    Rows collapse to distinct scores first; both areas come from running sums over those counts, which
    ``sequence`` splits when a group has very many distinct scores.  Groups with one class get null areas.
    """
    from caseloom.operators import sequence as S

    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    c = src.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    c = stage_if_large(c.withColumn("np", -F.col("p")), "scores")
    run = S.sequence(c, {"cum_pos": S.running_sum("pos"), "cum_n": S.running_sum("n")}, case=keys, order=("np",))
    tot = c.groupBy(*keys).agg(F.sum("pos").alias("tp"), F.sum("n").alias("tn"))
    run = run.join(tot, keys)
    neg_below = (F.col("tn") - F.col("cum_n")) - (F.col("tp") - F.col("cum_pos"))  # negatives with a smaller score
    ties = F.col("n") - F.col("pos")
    cp = clip(F.col("p"), 1e-6)
    cp = F.least(cp, F.lit(1 - 1e-6))
    ll = -(F.col("pos") * F.ln(cp) + (F.col("n") - F.col("pos")) * F.ln(1 - cp))
    right = F.when(F.col("p") > 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    both = (F.max("tp") > 0) & (F.max("tp") < F.max("tn"))
    out = run.groupBy(*keys).agg(
        F.max("tn").alias("n"), rnd(F.max("tp") / F.max("tn")).alias("pos_rate"),
        rnd(F.when(both, F.sum(F.col("pos") * (neg_below + 0.5 * ties)) / (F.max("tp") * (F.max("tn") - F.max("tp"))))).alias("auroc"),
        rnd(F.when(both, F.sum(F.col("pos") / F.col("tp") * (F.col("cum_pos") / F.col("cum_n"))))).alias("avg_precision"),
        rnd(F.when(both, F.sum(ll) / F.max("tn"))).alias("log_loss"), rnd(F.when(both, F.sum(right) / F.max("tn"))).alias("accuracy"),
        rnd(F.when(both, F.greatest(F.max("tp"), F.max("tn") - F.max("tp")) / F.max("tn"))).alias("majority"))
    return out if by else out.drop("_all")


def spearman(df: DataFrame, x: str, y: str, name: str = "rho") -> DataFrame:
    """Correlation of average ranks."""
    r = average_rank(average_rank(df, [], x, "_rx"), [], y, "_ry")
    return r.agg(rnd(F.corr("_rx", "_ry")).alias(name), F.count(F.lit(1)).alias("n"))
