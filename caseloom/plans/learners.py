"""Learner queries M8, M9, T16, T17, T24 hybrid."""

from pyspark.sql import functions as F

from caseloom.functions.columns import rnd
from caseloom.operators import encode as en, learn as le, metrics as me, reports as rp, splits as sp, traces as tc
from caseloom.plans import episodes as ep
from caseloom.plans.models import prepared
from caseloom.plans.registry import query
from caseloom.plans.traces import _CTX, _EX2, CALLS, FULL, examples
from caseloom.session import materialize


def learner(spark, d, **kw):
    p = prepared(spark, d)
    scalers = materialize(en.fit_scalers(p.part("train")), "scalers")
    feats = materialize(le.prefix_features(p, p.frame, scalers), "prefix_features")
    return p, scalers, feats, le.fit_prefix_learner(p, feats.where("split = 'train'"), **kw)


@query("m8_prefix_learner")
def m8(spark, d):
    p, _, feats, m = learner(spark, d, max_iter=15, trees=5)
    s = m.score(feats.where("split = 'test'"))
    nll = me.next_label(me.score(s.where(F.col("y_id").isNotNull())))
    err = s.agg(rnd(F.avg(F.abs(F.col("dt_hat") - F.expm1("y_ldt"))) / 3600).alias("dt_mae_h"),
                rnd(F.avg(F.when(F.col("pos") < F.col("n") - 1, F.abs(F.col("rem_hat") - F.col("y_rem")))) / 3600).alias("rem_mae_h")).agg(F.first(F.struct("dt_mae_h", "rem_mae_h")).alias("e")).scalar()
    return nll.withColumn("_e", err).select("n", "nll", "accuracy", "top3_accuracy", F.col("_e.dt_mae_h").alias("dt_mae_h"), F.col("_e.rem_mae_h").alias("rem_mae_h"))


@query("m9_learner_rollout")
def m9(spark, d):
    p, scalers, feats, m = learner(spark, d, max_iter=10, trees=3)
    start = feats.where("split = 'test'").withColumn("pos0", F.col("pos"))
    out = le.rollout(p, m, start, scalers, 4)
    return out.select("case_id", F.col("pos0").alias("pos"), F.array_join("pred", ",").alias("pred"))


@query("t16_numeric_features", FULL.rstrip() + _CTX + _EX2 + f""", x AS (SELECT * FROM ex1 UNION ALL SELECT * FROM ex2) SELECT example_id, CAST(length(code) - length(replace(code, chr(10), '')) + 1 AS DOUBLE) AS n_lines, least(length(code), 4000) / 1000.0::DOUBLE AS k_chars, CAST(len({CALLS}) AS DOUBLE) AS n_calls,
 CASE WHEN contains(code, 'complete_task') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS completes, CASE WHEN last_error <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS had_error, step_index / 10.0::DOUBLE AS step, CASE WHEN last_code = code THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS repeats, n_prev_errors / 5.0::DOUBLE AS prev_errors,
 CASE WHEN contains(code, 'show_api_doc') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reads_docs, 0.0::DOUBLE AS reads_passwords, CASE WHEN contains(code, '.login(') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS logs_in, CASE WHEN contains(code, 'print(') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prints FROM x""")
def t16(spark, d):
    return le.numeric_features(rp.add_sources(list(examples(spark, d)))).select("example_id", *le.NUMERIC)


def scored_examples(spark, d, dim=1 << 12):
    ex = sp.split_groups(rp.add_sources(list(examples(spark, d))), "group_id")
    feats = materialize(le.candidate_features(ex, dim).select(
        "example_id", "episode_id", "step_index", F.col("candidate_index").alias("cand"), "part", *[f"label_{h}" for h in le.HEADS], "features"), "candidate_features")
    models = le.fit_heads(feats.where("part = 'train'"), max_iter=10)
    return le.score_heads(feats.where("part = 'heldout'"), models)


query("t16_hashed_features")(lambda s, d: le.candidate_features(rp.add_sources(list(examples(s, d)))).select(
    "example_id", F.expr("size(code_w)").alias("n_code"), F.expr("size(chars)").alias("n_chars"), F.expr("size(cross)").alias("n_cross")))
query("t17_candidate_scorer")(lambda s, d: le.head_report(scored_examples(s, d)))


@query("t24_hybrid_choice")
def t24h(spark, d):
    from caseloom.operators import transitions as tr, worldmodel as wm
    from caseloom.plans.traces import trace_prepared

    p = trace_prepared(spark, d)
    world = wm.candidate_scores(p, tr.fit_prepared(p), ep.candidates(spark, d))
    world = world.select("episode_id", "step_index", "cand", (F.col("valid") * F.col("plausible")).alias("score"))
    token = scored_examples(spark, d).select("episode_id", "step_index", "cand", "s_valid", "s_success")
    return tc.choose(wm.hybrid(world, token))
