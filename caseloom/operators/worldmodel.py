"""Transition model over episode cases, used to score candidate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import UNK, rnd
from caseloom.functions.text import action_activity
from caseloom.operators import encode as en, metrics as me, rollout as ro, sparse, transitions as tr
from caseloom.operators.encode import Prepared
from caseloom.operators.traces import OUTCOME_FAIL, OUTCOME_OK
from caseloom.schema import EventLog
from caseloom.session import lookup_side

AGENT = EventLog("episodes", "UTC", "agent", {"activity": ("activity",), "event_cat": ("error_type", "n_calls", "prev_error"), "case_cat": ("benchmark",)},
                 endings=(OUTCOME_OK, OUTCOME_FAIL))


def _label_ids(df: DataFrame, vocab: DataFrame, label: str, out: str) -> DataFrame:
    v = lookup_side(vocab.select(F.col("value").alias("_label"), F.col("id").alias(out)), "vocab")
    return df.join(v, F.col(label) == F.col("_label"), "left").drop("_label")


def _before_step(p: Prepared, candidates: DataFrame) -> DataFrame:
    """Candidates with the label context of the moment before their step (the start event precedes step 0)."""
    cols = tr.context_columns(p.order)
    at = p.frame.select(F.col("case_id").alias("episode_id"), F.col("pos").cast("int").alias("step_index"), *cols)
    base = F.substring_index(action_activity("code", F.lit(None).cast("string")), "|", 1)
    c = candidates.select("episode_id", "step_index", "cand", base.alias("base")).join(at, ["episode_id", "step_index"])
    c = c.withColumns({"_ok": F.concat("base", F.lit("|ok")), "_err": F.concat("base", F.lit("|err"))})
    return _label_ids(_label_ids(c, p.vocab, "_ok", "ok_id"), p.vocab, "_err", "err_id").drop("_ok", "_err")


def candidate_scores(p: Prepared, m: tr.TransitionModel, candidates: DataFrame) -> DataFrame:
    """``valid``: chance that the call succeeds given that it is made; ``plausible``: chance that it is made next.

    A call never seen in training gets 0.5 and the unknown label's mass.
    """
    c = tr.predict_next(_before_step(p, candidates), m)
    at = lambda i: sparse.prob("dist", F.coalesce(F.col(i), F.lit(0)))
    po, pe = F.when(F.col("ok_id").isNull(), 0.0).otherwise(at("ok_id")), F.when(F.col("err_id").isNull(), 0.0).otherwise(at("err_id"))
    unseen = F.col("ok_id").isNull() & F.col("err_id").isNull()
    return c.withColumns({
        "valid": F.when(unseen, 0.5).otherwise((po + 1e-6) / (po + pe + 2e-6)),
        "plausible": F.when(unseen, sparse.prob("dist", F.lit(UNK))).otherwise(po + pe)})


def success_scores(p: Prepared, m: tr.TransitionModel, candidates: DataFrame, n: int = 8, max_len: int = 30, seed: int = 0) -> DataFrame:
    """``success``: share of sampled continuations after a successful call that reach the success outcome; ``score``: the product."""
    c = candidate_scores(p, m, candidates).drop("dist", "probs", "probs_k")
    cols = tr.context_columns(p.order)
    moved = {a: F.col(b) for a, b in zip(cols[:-1], cols[1:])}
    start = c.select(F.concat_ws("#", "episode_id", "cand").alias("case_id"), F.col("step_index").alias("pos"), "episode_id", "cand", "valid", "plausible",
                     *[moved[a].alias(a) for a in cols[:-1]], F.coalesce("ok_id", F.lit(UNK)).alias(cols[-1]))
    goal = p.vocab.where(F.col("value") == OUTCOME_OK).agg(F.max("id").alias("i")).scalar()
    s = ro.sample(start, m, max_len, n, seed).withColumn("_goal", goal)
    hit = F.coalesce(F.array_contains("suffix", F.col("_goal")), F.lit(False)).cast("double")
    g = s.groupBy("episode_id", F.col("pos").alias("step_index"), "cand").agg(F.avg(hit).alias("success"), F.max("valid").alias("valid"), F.max("plausible").alias("plausible"))
    return g.withColumn("score", F.col("valid") * F.col("plausible") * F.col("success"))


def hybrid(scores: DataFrame, token_scores: DataFrame) -> DataFrame:
    """World-model score times the token-level scorer's validity (and success where it has that head)."""
    j = scores.join(token_scores, ["episode_id", "step_index", "cand"])
    return j.withColumn("score", F.col("score") * F.col("s_valid") * F.coalesce("s_success", F.lit(1.0)))


def report(p: Prepared, m: tr.TransitionModel) -> DataFrame:
    """Held-out top-1 next action, AUROC of predicting errors of the true next call, AUROC of the outcome at the last real step."""
    t = p.part("test").where((F.col("pos") < F.col("n") - 1) & F.col("y_id").isNotNull())
    t = tr.predict_next(t, m)
    label = en.inverse_lookup(t, p.vocab, "y_id", "y_label").withColumn("base", F.substring_index("y_label", "|", 1))
    v = label.withColumns({"_ok": F.concat("base", F.lit("|ok")), "_err": F.concat("base", F.lit("|err"))})
    v = _label_ids(_label_ids(v, p.vocab, "_ok", "ok_id"), p.vocab, "_err", "err_id")
    at = lambda i: sparse.prob("dist", F.coalesce(F.col(i), F.lit(UNK)))
    po, pe = at("ok_id"), at("err_id")
    valid = v.where(~F.col("base").startswith("outcome.")).select(
        F.lit("validity").alias("what"), F.col("y_label").endswith("|err").cast("int").alias("y"), F.round(pe / (po + pe + 1e-9), 9).alias("p"))
    goal = p.vocab.where(F.col("value") == OUTCOME_OK).agg(F.max("id").alias("i")).scalar()
    final = t.where(F.col("pos") == F.col("n") - 2).withColumn("_g", goal)
    outcome = final.select(F.lit("outcome").alias("what"), (F.col("last_act") == OUTCOME_OK).cast("int").alias("y"),
                           F.round(sparse.prob("dist", F.coalesce(F.col("_g"), F.lit(UNK))), 9).alias("p"))
    auc = me.binary_report(valid.unionByName(outcome), ["what"]).select("what", "n", "auroc")
    top = t.agg(rnd(F.avg((sparse.argmax("dist") == F.col("y_id")).cast("double"))).alias("a"), F.count(F.lit(1)).alias("b")).agg(F.first(F.struct("a", "b")).alias("s")).scalar()
    return auc.withColumn("_t", top).select("what", F.col("_t.a").alias("next_top1"), F.col("_t.b").alias("n_steps"), "n", "auroc")
