"""Uses of the forecasts: abstention, epistemic uncertainty, breach risk, anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import rnd
from caseloom.operators import metrics as me, transitions as tr
from caseloom.operators.ranking import exact_quantiles, global_rank

COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.5, 0.3)
TENTHS = tuple(i / 10 for i in range(1, 11))


def selective(scored: DataFrame) -> DataFrame:
    """Accuracy on the most certain share of rows (ascending entropy, row key on ties), one row per coverage.

    ``mean10`` is the mean accuracy over ten even coverages.
    """
    r = global_rank(scored.withColumn("_e", F.round("entropy", 9)), ["_e", "case_id", "pos"], total="total")

    def acc(c: float):
        k = F.floor(F.max("total") * F.lit(c))
        inside = F.col("rank") < F.floor(F.col("total") * F.lit(c))
        return F.sum(F.when(inside, F.col("correct")).otherwise(0.0)) / k

    wide = r.agg(*[acc(c).alias(f"c{i}") for i, c in enumerate(COVERAGES)], *[acc(c).alias(f"t{i}") for i, c in enumerate(TENTHS)])
    mean10 = sum([F.col(f"t{i}") for i in range(1, 10)], F.col("t0")) / 10
    rows = F.inline(F.array(*[F.struct(F.lit(int(round(c * 100))).alias("coverage"), rnd(F.col(f"c{i}")).alias("accuracy")) for i, c in enumerate(COVERAGES)]))
    return wide.select(rnd(mean10).alias("mean10"), rows)


def epistemic(mean: DataFrame) -> DataFrame:
    """Scored rows of :func:`transitions.predict_mean` with the mutual information: entropy of the mean minus mean entropy."""
    return me.score(mean).withColumn("mi", F.col("entropy") - F.col("mean_entropy")).drop("mean_entropy")


def uncertainty_report(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("entropy")).alias("entropy"), rnd(F.avg("mi")).alias("mi"),
        rnd(F.avg(F.when(F.col("correct") == 0, F.col("mi")))).alias("mi_wrong"), rnd(F.avg(F.when(F.col("correct") == 1, F.col("mi")))).alias("mi_right"))


def breach_thresholds(train: DataFrame) -> DataFrame:
    """(label, limit): median and 90th percentile of the remaining seconds of the train part."""
    q = exact_quantiles(train, [], "y_rem", [0.5, 0.9], "q")
    return q.select(F.inline(F.array(F.struct(F.lit("median").alias("label"), F.col("q")[0].alias("limit")),
                                     F.struct(F.lit("p90").alias("label"), F.col("q")[1].alias("limit")))))


def breach_risk(test: DataFrame, fits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """P(remaining > limit) per test row, fit and threshold.  ``fits`` has (scorer, act, posb, mu, b)."""
    limits = thresholds.agg(F.collect_list(F.struct("label", "limit")).alias("t")).scalar()  # two rows
    rows = test.where(F.col("y_rem").isNotNull() & (F.col("pos") < F.col("n") - 1))
    rows = rows.select("case_id", "pos", "act", F.least("pos", F.lit(tr.REM_BUCKETS)).alias("posb"), "y_rem").withColumn("_t", limits)
    rows = rows.select("case_id", "pos", "act", "posb", "y_rem", F.inline("_t"))
    j = rows.join(fits, ["act", "posb"])
    return j.select("case_id", "pos", "scorer", "label", (F.col("y_rem") > F.col("limit")).cast("int").alias("y"),
                    tr.laplace_sf("mu", "b", F.log1p("limit")).alias("p"))


def breach_report(risk: DataFrame) -> DataFrame:
    """AUROC and Brier per (label, scorer)."""
    p = risk.withColumn("p", F.round("p", 9))
    brier = p.groupBy("label", "scorer").agg(rnd(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"))
    return me.binary_report(p, ["label", "scorer"]).select("label", "scorer", "n", "pos_rate", "auroc").join(brier, ["label", "scorer"])


def case_scores(scored: DataFrame) -> DataFrame:
    """Anomaly score of a case: its mean next-label NLL."""
    return scored.groupBy("case_id").agg(F.avg("nll").alias("score"), F.count(F.lit(1)).alias("n_scored"))


def most_anomalous(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.withColumn("score", rnd("score")).orderBy(F.desc("score"), "case_id").limit(k)
