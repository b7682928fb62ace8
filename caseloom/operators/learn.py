"""Learners on Spark ML: prefix-feature forecasters and the candidate scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, OneHotEncoder, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import EOS
from caseloom.functions.text import api_calls, api_tokens
from caseloom.operators import encode as en, sequence as S
from caseloom.operators.encode import Prepared
from caseloom.operators.metrics import binary_report
from caseloom.session import materialize

MIN_TARGETS = 50
TIME = ["f_dt", "f_elapsed", "f_hour_sin", "f_hour_cos", "f_wd_sin", "f_wd_cos", "f_pos"]


# ------------------------------------------------------------------ prefix features
def bag_names(size: int) -> list[str]:
    return [f"bag_{i}" for i in range(EOS + 1, size)]


def prefix_features(p: Prepared, frame: DataFrame, scalers: DataFrame) -> DataFrame:
    """Last labels, running label counts and time features per prefix."""
    f = S.sequence(frame, {f"bag_{i}": S.running_sum((F.col("act") == i).cast("long")) for i in range(EOS + 1, p.size)})
    f = en.time_features(f, scalers, p.schema)
    return f.withColumn("last1", F.coalesce("id1", F.lit(0)))


@dataclass
class PrefixLearner:
    """Next-label classifier and two optional log-time regressors over one feature vector."""

    size: int
    features: PipelineModel
    label: object
    wait: object | None
    remain: object | None

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``probs`` (class-complete), ``dt_hat`` and ``rem_hat`` seconds."""
        out = self.label.transform(self.features.transform(df))
        arr = vector_to_array(F.col("probability"))
        floor = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.greatest(F.coalesce(F.try_element_at(arr, i + 1), F.lit(0.0)), F.lit(1e-6)))
        total = F.aggregate(floor, F.lit(0.0), lambda a, b: a + b)
        out = out.withColumn("probs", F.transform(floor, lambda x: x / total)).drop("probability", "rawPrediction", "prediction")
        for model, name in ((self.wait, "dt_hat"), (self.remain, "rem_hat")):
            if model is None:
                out = out.withColumn(name, F.lit(0.0))
            else:
                out = model.transform(out).withColumn(name, F.greatest(F.expm1("prediction"), F.lit(0.0))).drop("prediction")
        return out.drop("features", "oh_act", "oh_last")


def fit_prefix_learner(p: Prepared, train: DataFrame, max_iter: int = 30, trees: int = 10) -> PrefixLearner:
    """Fit on a feature frame (see :func:`prefix_features`)."""
    hot = OneHotEncoder(inputCols=["act", "last1"], outputCols=["oh_act", "oh_last"], handleInvalid="keep")
    vec = VectorAssembler(inputCols=["oh_act", "oh_last", *bag_names(p.size), *TIME], outputCol="features")
    feats = Pipeline(stages=[hot, vec]).fit(train)
    x = materialize(feats.transform(train).select("features", "y_id", "y_ldt", "y_rem"), "features")
    label = LogisticRegression(labelCol="y_id", maxIter=max_iter, family="multinomial", regParam=1e-4).fit(x.where(F.col("y_id").isNotNull()))

    def regress(target: Column):
        rows = x.withColumn("t", target).where(F.col("t").isNotNull())
        if rows.limit(MIN_TARGETS).count() < MIN_TARGETS:
            return None
        return GBTRegressor(labelCol="t", lossType="absolute", maxIter=trees, maxDepth=4, seed=0).fit(rows)

    return PrefixLearner(p.size, feats, label, regress(F.col("y_ldt")), regress(F.log1p("y_rem")))


def rollout(p: Prepared, learner: PrefixLearner, prefixes: DataFrame, scalers: DataFrame, max_len: int) -> DataFrame:
    """Greedy continuation of all prefixes in lock step: one scoring call per generated event.

    ``prefixes`` is a feature frame; the state of a row is its last labels, label counts and clock, so no
    history is carried along.  The frontier is written after each step.
    """
    alive = prefixes.withColumns({"pred": F.array().cast("array<int>"), "_alive": F.lit(True)})
    done = None
    for _ in range(max_len):
        s = learner.score(alive)
        nxt = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
        s = s.withColumn("_n", nxt).withColumn("_alive", F.col("_n") != EOS)
        moved = {
            "last1": F.col("act"), "id1": F.col("act"), "act": F.col("_n"), "pos": F.col("pos") + 1, "dt_s": F.col("dt_hat"),
            "elapsed_s": F.col("elapsed_s") + F.col("dt_hat"), "ts": F.timestamp_add("MICROSECOND", F.round(F.col("dt_hat") * 1e6).cast("long"), F.col("ts")),
            **{f"bag_{i}": F.col(f"bag_{i}") + (F.col("_n") == i).cast("long") for i in range(EOS + 1, p.size)},
        }
        keep = s.withColumn("pred", F.when(F.col("_alive"), F.concat("pred", F.array("_n"))).otherwise(F.col("pred")))
        keep = materialize(keep.drop("probs", "rem_hat"), "front")
        ended = keep.where(~F.col("_alive")).select("case_id", "pos0", "pred")
        done = ended if done is None else done.unionByName(ended)
        nextf = keep.where("_alive").withColumns(moved).drop("_n", "dt_hat", *TIME)
        alive = en.time_features(nextf, scalers, p.schema)
    return done.unionByName(alive.select("case_id", "pos0", "pred"))


# ------------------------------------------------------------------ candidate scorer
HEADS = ["valid", "success", "progress", "regress"]
NUMERIC = ["n_lines", "k_chars", "n_calls", "completes", "had_error", "step", "repeats", "prev_errors", "reads_docs", "reads_passwords", "logs_in", "prints"]


def numeric_features(df: DataFrame) -> DataFrame:
    """The twelve numeric features of a candidate code in its context."""
    c = F.coalesce("code", F.lit(""))
    flag = lambda *words: F.greatest(*[c.contains(w).cast("double") for w in words]) if len(words) > 1 else c.contains(words[0]).cast("double")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return df.withColumns({
        "n_lines": (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("double"), "k_chars": F.least(F.length(c), F.lit(4000)) / 1000.0,
        "n_calls": F.size(api_calls("code")).cast("double"), "completes": flag("complete_task"), "had_error": (F.col("last_error") != "").cast("double"),
        "step": F.col("step_index") / 10.0, "repeats": (strip(F.coalesce("last_code", F.lit(""))) == strip(c)).cast("double"), "prev_errors": F.col("n_prev_errors") / 5.0,
        "reads_docs": flag("show_api_doc", "show_api_descriptions", "show_app_descriptions"), "reads_passwords": flag("show_account_passwords"),
        "logs_in": flag(".login("), "prints": flag("print("),
    })


def char_ngrams(c: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside words; each word is padded with one space on both sides."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))))
    return F.concat(*[grams(n) for n in range(lo, hi + 1)])


def featurizer(dim: int = 1 << 18) -> Pipeline:
    """Six hashed, L2-normalised blocks and the numeric features as one vector.  Stateless: nothing is fitted."""
    stages, blocks = [], []

    def block(name: str, tokens: str):
        stages.extend([HashingTF(inputCol=tokens, outputCol=f"{name}_tf", numFeatures=dim), Normalizer(inputCol=f"{name}_tf", outputCol=f"{name}_v")])
        blocks.append(f"{name}_v")

    stages += [
        RegexTokenizer(inputCol="code", outputCol="code_w1", pattern=r"[A-Za-z_][A-Za-z0-9_]*|[=()\[\].,:]", gaps=False), NGram(n=2, inputCol="code_w1", outputCol="code_w2"),
        RegexTokenizer(inputCol="last_error", outputCol="err_w1", pattern=r"\b\w\w+\b", gaps=False), NGram(n=2, inputCol="err_w1", outputCol="err_w2"),
        RegexTokenizer(inputCol="last_observation", outputCol="obs_w1", pattern=r"\b\w\w+\b", gaps=False),
    ]
    from pyspark.ml.feature import SQLTransformer

    stages.append(SQLTransformer(statement="SELECT *, concat(code_w1, code_w2) AS code_w, concat(err_w1, err_w2) AS err_w FROM __THIS__"))
    for name, tokens in (("code", "code_w"), ("chars", "chars"), ("api", "apis"), ("err", "err_w"), ("obs", "obs_w1"), ("cross", "cross")):
        block(name, tokens)
    stages.append(VectorAssembler(inputCols=[*blocks, *NUMERIC], outputCol="features"))
    return Pipeline(stages=stages)


def candidate_features(df: DataFrame, dim: int = 1 << 18) -> DataFrame:
    """``features`` for rows with code, last_error, last_observation, last_code, step_index, n_prev_errors."""
    d = numeric_features(df).withColumns({"chars": char_ngrams(F.col("code")), "apis": api_tokens("code")})
    tag = F.when(F.col("last_error") != "", "|err1").otherwise("|err0")
    d = d.withColumn("cross", F.transform("apis", lambda t: F.concat(t, tag)))
    return featurizer(dim).fit(d).transform(d)


def fit_heads(train: DataFrame, reg: float = 1e-3, max_iter: int = 30) -> dict[str, object]:
    """One class-balanced logistic model per head; a head whose labels have one class is skipped."""
    c = train.agg(*[F.count(f"label_{h}").alias(f"n_{h}") for h in HEADS], *[F.sum(f"label_{h}").alias(f"p_{h}") for h in HEADS]).first()
    models = {}
    for h in HEADS:
        n, pos = c[f"n_{h}"], c[f"p_{h}"] or 0
        if 0 < pos < n:
            w = F.when(F.col(f"label_{h}") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
            rows = train.where(F.col(f"label_{h}").isNotNull()).withColumn("_w", w)
            models[h] = LogisticRegression(labelCol=f"label_{h}", weightCol="_w", regParam=reg, maxIter=max_iter).fit(rows)
    return models


def score_heads(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """Adds ``s_<head>`` probabilities; missing heads become null."""
    for h in HEADS:
        if h in models:
            df = models[h].transform(df).withColumn(f"s_{h}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        else:
            df = df.withColumn(f"s_{h}", F.lit(None).cast("double"))
    return df


def head_report(scored: DataFrame) -> DataFrame:
    """Held-out metrics per head."""
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(f"label_{h}").alias("y"), F.col(f"s_{h}").alias("p")) for h in HEADS]))
    return binary_report(scored.select(cells.alias("c")).select("c.*").where("y IS NOT NULL AND p IS NOT NULL"), ["head"])


