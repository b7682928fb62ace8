"""Metric queries V1-V18, J9, J10."""

from pyspark.sql import functions as F

from caseloom.functions.columns import hash_unit, rnd
from caseloom.operators import bootstrap as bo, frame as fr, metrics as me, rollout as ro, transitions as tr
from caseloom.operators.ranking import exact_quantiles
from caseloom.plans import modelsql as ms, sqltext as q
from caseloom.plans.models import _REM, _WAIT, fitted, recursive, rollout_sql, sample_sql, SAMPLES, SAMPLE_STEPS
from caseloom.plans.registry import query
from caseloom.sources import tables as t

S = ms.test_scores("a")
ONE = "CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
RIGHT = ONE.format("pred = y_id")


def scored(spark, d, part="test", seed=0, log="clicks", by=None):
    """Scored prefixes, reduced to (context, y, weight) first."""
    p, m = fitted(spark, d, seed, log)
    return me.score(tr.predict_next(tr.compact(p.part(part), p.order, by), m))


query("v1_nll", S + "SELECT count(*) AS n, round(avg(-ln(greatest(p_y, 1e-12))), 6) AS nll FROM s")(
    lambda s, d: me.next_label(scored(s, d)).select("n", "nll"))
query("v2_accuracy", S + f"SELECT count(*) AS n, round(avg({RIGHT}), 6) AS accuracy, round(avg({ONE.format('rank_y < 3')}), 6) AS top3_accuracy FROM s")(
    lambda s, d: me.next_label(scored(s, d)).select("n", "accuracy", "top3_accuracy"))
query("v3_macro_f1", S + """, f AS (SELECT v.id, count(*) FILTER (pred = v.id AND y_id = v.id) AS tp, count(*) FILTER (pred = v.id AND y_id <> v.id) AS fp, count(*) FILTER (pred <> v.id AND y_id = v.id) AS fn FROM s CROSS JOIN v GROUP BY 1)
SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS n_classes FROM f WHERE tp + fp + fn > 0""")(
    lambda s, d: me.macro_f1(scored(s, d)))
query("v4_eos", ms.test_scores("b") + "SELECT round(count(*) FILTER (pred = 2 AND y_id = 2) / greatest(count(*) FILTER (y_id = 2), 1), 6) AS eos_recall, round(count(*) FILTER (pred = 2 AND y_id = 2) / greatest(count(*) FILTER (pred = 2), 1), 6) AS eos_precision FROM s")(
    lambda s, d: me.next_label(scored(s, d, log="orders")).select("eos_recall", "eos_precision"))
REL = ", rb AS (SELECT least(floor(conf * 15), 14)::INTEGER AS bin, avg(conf) AS confidence, avg(" + RIGHT + ") AS accuracy, count(*) AS n FROM s GROUP BY 1) "
query("v5_reliability", S + REL + "SELECT bin, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, n FROM rb")(
    lambda s, d: me.reliability(scored(s, d)).select("bin", rnd("confidence").alias("confidence"), rnd("accuracy").alias("accuracy"), "n"))
query("v5_ece", S + REL + "SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM rb")(
    lambda s, d: me.ece(scored(s, d)))
query("v6_brier", S + "SELECT round(avg(sq - 2 * p_y + 1), 6) AS brier FROM s")(
    lambda s, d: me.next_label(scored(s, d)).select("brier"))
query("v7_entropy", S + "SELECT round(avg(ent) / ln(2.0::DOUBLE), 6) AS entropy_bits FROM s")(
    lambda s, d: me.next_label(scored(s, d)).select("entropy_bits"))

GRID = "gr AS (SELECT i, CASE WHEN i < 15 THEN 0.3::DOUBLE + 0.7::DOUBLE * i / 14 ELSE 1.0::DOUBLE + 3.0::DOUBLE * (i - 15) / 30 END AS t FROM range(46) r(i))"
VAL = ms.model() + ", " + ms.scored("split = 'val'")
CURVE = ", " + GRID + """, zz AS (SELECT case_id, pos, i, t, max(CASE WHEN cls = y_id THEN ln(p) / t END) AS zy, max(ln(p) / t) AS mx, max(ln(p) / t) + ln(sum(exp(ln(p) / t - m0 / t))) AS lse
 FROM (SELECT *, max(ln(p)) OVER (PARTITION BY case_id, pos) AS m0 FROM pd) CROSS JOIN gr GROUP BY ALL), cv AS MATERIALIZED (SELECT i, t, avg(lse - zy) AS nll FROM zz GROUP BY ALL) """
query("j9_temperature_curve", VAL + CURVE + "SELECT i, round(t, 9) AS t, round(nll, 6) AS nll FROM cv")(
    lambda s, d: me.temperature_curve(scored(s, d, "val")).select("i", rnd("t", 9).alias("t"), rnd("nll").alias("nll")))
query("v8_temperature", VAL + CURVE + "SELECT round(arg_min(t, (round(nll, 12), i)), 9) AS temperature FROM cv")(
    lambda s, d: me.fit_temperature(scored(s, d, "val")).select(rnd("temperature", 9).alias("temperature")))


def _suffixed(sql: str, tag: str, names=("bc", "pd", "s")) -> str:
    """The same sub-queries under other names."""
    import re

    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{n}{tag}", sql)
    return sql


@query("v8_calibrated", VAL + CURVE + ", tp AS (SELECT arg_min(t, (round(nll, 12), i)) AS t FROM cv), " + _suffixed(ms.scored("split = 'test'"), "2") + """,
cp AS (SELECT case_id, pos, y_id, cls, exp(ln(p) / t) / sum(exp(ln(p) / t)) OVER (PARTITION BY case_id, pos) AS p FROM pd2, tp),
cs AS (SELECT case_id, pos, y_id, max(CASE WHEN cls = y_id THEN p END) AS p_y, arg_min(cls, (-round(p, 12), cls)) AS pred, max(p) AS conf, sum(p * p) AS sq FROM cp GROUP BY ALL),
rb AS (SELECT least(floor(conf * 15), 14) AS bin, avg(conf) AS c, avg(CASE WHEN pred = y_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a, count(*) AS n FROM cs GROUP BY 1)
SELECT (SELECT round(avg(-ln(greatest(p_y, 1e-12))), 6) FROM cs) AS nll, (SELECT round(avg(sq - 2 * p_y + 1), 6) FROM cs) AS brier, (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM rb) AS ece""")
def v8c(spark, d):
    p, m = fitted(spark, d)
    val = me.score(tr.predict_next(tr.compact(p.part("val"), p.order), m))
    test = tr.predict_next(tr.compact(p.part("test"), p.order), m)
    cal = me.score(me.apply_temperature(test, me.fit_temperature(val)))
    e = me.ece(cal).agg(F.max("ece").alias("e")).scalar()
    return me.next_label(cal).select("nll", "brier", e.alias("ece"))


_DT = ms.model() + _WAIT + ms.best_context("split = 'test' AND y_ldt IS NOT NULL", "wt")
_DT += ", dt AS (SELECT exp(md) - 1 AS hat, exp(lo) - 1 AS l, exp(hi) - 1 AS h, exp(y_ldt) - 1 AS tru FROM bc JOIN wt ON wt.k = bc.k AND wt.ctx = bc.ctx) "


def waits(spark, d):
    p, m = fitted(spark, d)
    return p, tr.predict_wait(p.part("test").where(F.col("y_ldt").isNotNull()), m).withColumn("dt_true", F.expm1("y_ldt"))


query("v9_wait_errors", _DT + "SELECT count(*) AS n, round(avg(abs(hat - tru)) / 3600, 6) AS mae_h, round(median(abs(hat - tru) / 3600), 6) AS medae_h, round(avg(abs(ln(1 + greatest(hat, 0)) - ln(1 + tru))), 6) AS mae_log1p FROM dt")(
    lambda s, d: me.time_errors(waits(s, d)[1], "dt_hat", "dt_true"))


@query("v9_naive_baseline", _DT + ", nv AS (SELECT median(exp(y_ldt) - 1) AS m FROM e WHERE split = 'val' AND y_ldt IS NOT NULL) SELECT round(avg(abs(m - tru)) / 3600, 6) AS naive_mae_h FROM dt, nv")
def v9n(spark, d):
    from caseloom.plans.models import prepared

    p = prepared(spark, d)
    val = p.part("val").where(F.col("y_ldt").isNotNull()).withColumn("v", F.expm1("y_ldt"))
    med = exact_quantiles(val, [], "v", [0.5]).agg(F.max(F.col("q")[0]).alias("m")).scalar()
    te = p.part("test").where(F.col("y_ldt").isNotNull()).withColumn("_m", med)
    return te.agg(rnd(F.avg(F.abs(F.col("_m") - F.expm1("y_ldt"))) / 3600).alias("naive_mae_h"))


query("v10_interval", _DT + f"SELECT round(avg({ONE.format('tru >= l AND tru <= h')}), 6) AS coverage, round(avg(h - l) / 3600, 6) AS width_h, count(*) AS n FROM dt")(
    lambda s, d: me.interval(waits(s, d)[1].withColumn("dt_true", F.expm1("y_ldt")), "dt_lo", "dt_hi", "dt_true"))


@query("v11_remaining_errors", ms.model() + _REM + ", rp AS (SELECT coalesce(rm.med, (SELECT med FROM rg), 0) AS hat, e.y_rem AS tru FROM e LEFT JOIN rm ON rm.act = e.act AND rm.posb = least(e.pos, 10) WHERE split = 'test' AND e.y_rem IS NOT NULL AND e.pos < e.n - 1) SELECT count(*) AS n, round(avg(abs(hat - tru)) / 3600, 6) AS mae_h, round(median(abs(hat - tru) / 3600), 6) AS medae_h FROM rp")
def v11(spark, d):
    p, m = fitted(spark, d)
    rows = p.part("test").where(F.col("pos") < F.col("n") - 1)
    return me.time_errors(tr.predict_remaining(rows, m), "rem_hat", "y_rem").select("n", "mae_h", "medae_h")


# ------------------------------------------------------------------ continuations
MAX_LEN = 50
TEXT = "array_to_string(list_transform({}, lambda x: chr(65 + x)), '')"
_TRUE = f"""tv AS MATERIALIZED (SELECT p.case_id, p.pos, p.id1, p.act, list(x.act ORDER BY x.pos) AS tru FROM e p JOIN e x ON x.case_id = p.case_id AND x.pos > p.pos WHERE p.split = 'test' AND p.complete AND p.pos < p.n - 1 GROUP BY ALL),
gp AS MATERIALIZED (SELECT tv.case_id, tv.pos, suffix AS pred, tru FROM tv JOIN rx ON rx.s2 = tv.act AND rx.s1 IS NOT DISTINCT FROM tv.id1) """
GREEDY = recursive(ms.model("b") + rollout_sql(MAX_LEN)) + ", " + _TRUE
SIM = f"CASE WHEN len(pred) = 0 AND len(tru) = 0 THEN 1.0::DOUBLE ELSE 1 - damerau_levenshtein({TEXT.format('pred')}, {TEXT.format('tru')}) / greatest(len(pred), len(tru)) END"


def true_suffixes(p):
    f = p.part("test")
    pick = f.where(F.col("complete") & (F.col("pos") < F.col("n") - 1))
    s = fr.suffixes(f, pick, "act")
    return pick, s.withColumnRenamed("suffix", "true")


def greedy_pairs(spark, d):
    """(case_id, pos, pred, true) for every prefix of the complete test cases of the order log."""
    p, m = fitted(spark, d, log="orders")
    pick, truth = true_suffixes(p)
    out = ro.greedy(pick.select("case_id", "pos", "n", "id1", "act", "y_id"), m, MAX_LEN)
    return p, m, out.join(truth, ["case_id", "pos"])


query("v12_similarity", GREEDY + f"SELECT case_id, pos, round({SIM}, 6) AS sim FROM gp")(
    lambda s, d: greedy_pairs(s, d)[2].select("case_id", "pos", rnd(me.dl_similarity("pred", "true")).alias("sim")))


@query("v13_suffix_report", GREEDY + f""", tm AS (SELECT list(id) AS ids FROM v WHERE value LIKE 'F|%')
SELECT count(*) AS n, round(avg({SIM}), 6) AS similarity, round(avg({ONE.format('pred = tru')}), 6) AS exact, round(avg({ONE.format(f'len(pred) < {MAX_LEN}')}), 6) AS terminated,
 round(avg({ONE.format('len(list_intersect(pred[1:len(pred) - 1], ids)) > 0')}), 6) AS post_terminal, round(avg(len(pred)), 6) AS len_pred, round(avg(len(tru)), 6) AS len_true FROM gp, tm""")
def v13(spark, d):
    from caseloom.schema import ORDERS

    p, m, pairs = greedy_pairs(spark, d)
    terminal = [r["id"] for r in p.vocab.where(F.col("value").isin(list(ORDERS.endings))).select("id").collect()]  # a handful of label ids
    return me.suffix_report(pairs, MAX_LEN, terminal)


query("v14_step_errors", GREEDY + f", st2 AS (SELECT unnest(range(least(len(pred), len(tru)))) AS step, pred, tru FROM gp) SELECT step::INTEGER AS step, round(avg({ONE.format('pred[step + 1] <> tru[step + 1]')}), 6) AS err, count(*) AS n FROM st2 WHERE step < 15 GROUP BY 1")(
    lambda s, d: me.step_errors(greedy_pairs(s, d)[2]))
BUCKET = "CASE WHEN pos + 1 = 1 THEN '1' WHEN pos + 1 = 2 THEN '2' WHEN pos + 1 = 3 THEN '3' WHEN pos + 1 <= 5 THEN '4-5' WHEN pos + 1 <= 10 THEN '6-10' WHEN pos + 1 <= 20 THEN '11-20' ELSE '21-10000' END"
query("v14_similarity_by_length", GREEDY + f"SELECT {BUCKET} AS bucket, round(avg({SIM}), 6) AS similarity, count(*) AS n FROM gp GROUP BY 1")(
    lambda s, d: me.similarity_by_length(greedy_pairs(s, d)[2]))


_SS = SIM.replace("pred", "suffix")
_PAIR = f"CASE WHEN len(x.suffix) = 0 AND len(y.suffix) = 0 THEN 1.0::DOUBLE ELSE 1 - damerau_levenshtein({TEXT.format('x.suffix')}, {TEXT.format('y.suffix')}) / greatest(len(x.suffix), len(y.suffix)) END"


@query("v15_sampled_consensus", recursive(ms.model("b") + sample_sql()) + ", " + _TRUE.split("\ngp AS")[0] + f""" ss AS MATERIALIZED (SELECT sx.*, tru, {_SS} AS sim FROM sx JOIN tv USING (case_id, pos)),
pw AS (SELECT x.case_id, x.pos, x.sample, sum({_PAIR}) AS tot FROM ss x JOIN ss y ON x.case_id = y.case_id AND x.pos = y.pos AND x.sample <> y.sample GROUP BY ALL),
md AS (SELECT case_id, pos, arg_min(sample, (-round(tot, 12), sample)) AS medoid FROM pw GROUP BY ALL)
SELECT count(*) AS n, round(avg(m), 6) AS mean_sim, round(avg(ex), 6) AS any_exact, round(avg(msim), 6) AS medoid_sim, round(avg(mex), 6) AS medoid_exact, round(avg(mt), 6) AS medoid_terminated FROM (
 SELECT ss.case_id, ss.pos, avg(sim) AS m, max({ONE.format('suffix = tru')}) AS ex, max(CASE WHEN sample = medoid THEN sim END) AS msim, max(CASE WHEN sample = medoid AND suffix = tru THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mex,
 max(CASE WHEN sample = medoid AND len(suffix) < {SAMPLE_STEPS} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mt FROM ss JOIN md USING (case_id, pos) GROUP BY ALL)""")
def v15(spark, d):
    p, m = fitted(spark, d, log="orders")
    pick, truth = true_suffixes(p)
    s = ro.sample(pick.select("case_id", "pos", "id1", "act"), m, SAMPLE_STEPS, SAMPLES, seed=1)
    c = ro.consensus(s.select("case_id", "pos", "sample", "suffix"), truth).join(truth, ["case_id", "pos"])
    return c.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("mean_sim")).alias("mean_sim"), rnd(F.avg("any_exact")).alias("any_exact"), rnd(F.avg("medoid_sim")).alias("medoid_sim"),
                 rnd(F.avg((F.col("medoid_suffix") == F.col("true")).cast("double"))).alias("medoid_exact"),
                 rnd(F.avg((F.size("medoid_suffix") < SAMPLE_STEPS).cast("double"))).alias("medoid_terminated"))


@query("v16_by_prefix_length", S + f"SELECT {BUCKET} AS bucket, count(*) AS n, round(avg({RIGHT}), 6) AS accuracy, round(avg(-ln(greatest(p_y, 1e-12))), 6) AS nll FROM s GROUP BY 1")
def v16(spark, d):
    return me.by_prefix_length(scored(spark, d, by=["pos"]))


# ------------------------------------------------------------------ bootstrap, binary scorers
N_BOOT = 200
_BOOT = S + f""", g AS (SELECT case_id, sum(-ln(greatest(p_y, 1e-12))) AS sm, count(*) AS c, row_number() OVER (ORDER BY case_id) - 1 AS idx, count(*) OVER () AS ng FROM s GROUP BY case_id),
dr AS (SELECT b, {q.hash60(0, "(b || ':' || idx)")} % ng AS j FROM g CROSS JOIN range({N_BOOT}) r(b)), rp AS (SELECT b, sum(sm) / sum(c) AS m FROM dr JOIN g ON g.idx = dr.j GROUP BY b) """


def case_nll(spark, d):
    p, m = fitted(spark, d)
    return me.score(tr.predict_next(p.part("test").where(F.col("y_id").isNotNull()).select("case_id", "pos", "id1", "act", "y_id"), m))


query("v17_bootstrap", _BOOT + "SELECT (SELECT round(avg(-ln(greatest(p_y, 1e-12))), 6) FROM s) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(*) AS n_boot FROM rp")(
    lambda s, d: bo.bootstrap_mean(case_nll(s, d), "nll", n_boot=N_BOOT))
query("v17_bootstrap_poisson")(lambda s, d: bo.bootstrap_mean_poisson(case_nll(s, d), "nll", n_boot=N_BOOT))
query("v17_bootstrap_split")(lambda s, d: bo.split_bootstrap_mean(case_nll(s, d), "nll"))
query("v17_bootstrap_split_median")(lambda s, d: bo.split_bootstrap_median(t.orders(s, d), "ev_price"))
query("v17_bootstrap_median", q.with_(q.B_RAW) + f""", cs AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS idx, count(*) OVER () AS ng FROM (SELECT DISTINCT case_id FROM b_raw)),
dr AS (SELECT b, {q.hash60(0, "(b || ':' || idx)")} % ng AS j FROM cs CROSS JOIN range(20) r(b)), rp AS (SELECT b, median(ev_price) AS m FROM dr JOIN cs ON cs.idx = dr.j JOIN b_raw USING (case_id) GROUP BY b)
SELECT (SELECT round(median(ev_price), 6) FROM b_raw) AS median, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, count(*) AS n_boot FROM rp""")(
    lambda s, d: bo.bootstrap_median(t.orders(s, d), "ev_price", n_boot=20))


@query("v18_binary_report", f"""WITH sc AS (SELECT source, quality AS y, round({q.unit(3, 'doc_id')} * 20 + 6 * quality) / 30 AS p FROM labels JOIN documents USING (doc_id)),
th AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1), cu AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn FROM th), to_ AS (SELECT sum(pos) AS tp, sum(n) AS tn FROM th)
SELECT max(tn)::BIGINT AS n, round(max(tp) / max(tn), 6) AS pos_rate,
 round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) FROM sc a JOIN sc b ON a.y = 1 AND b.y = 0), 6) AS auroc,
 round(sum(pos / tp * (cp / cn)), 6) AS avg_precision, (SELECT round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) FROM sc) AS log_loss,
 (SELECT round(avg({ONE.format('(p > 0.5) = (y = 1)')}), 6) FROM sc) AS accuracy, round(max(greatest(tp, tn - tp)) / max(tn), 6) AS majority FROM cu, to_""")
def v18(spark, d):
    lab = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    p = F.round(hash_unit(3, "doc_id") * 20 + 6 * F.col("quality")) / 30
    return me.binary_report(lab.select(F.col("quality").alias("y"), p.alias("p")))


query("j10_split_replicates")(lambda s, d: bo.split_replicates(case_nll(s, d), "nll").select("b", rnd("m").alias("m"), "cases"))


@query("j10_bootstrap_replicates", _BOOT + "SELECT b, round(m, 6) AS m FROM rp")
def j10(spark, d):
    return bo.replicates(case_nll(spark, d), "nll", n_boot=N_BOOT).select(F.col("b"), rnd("m").alias("m"))
