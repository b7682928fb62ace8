"""Failure analysis F1-F6, uses Q1-Q4, report tables R1-R5, P16."""

from pyspark.sql import functions as F

from caseloom.functions.columns import rnd
from caseloom.operators import downstream as ds, encode as en, failure as fa, frame as fr, metrics as me, reports as rp, splits as sp, transitions as tr
from caseloom.plans import modelsql as ms, sqltext as q
from caseloom.plans.evaluation import GREEDY, MAX_LEN, ONE, SIM, case_nll, greedy_pairs
from caseloom.plans.models import LAPLACE, _REM, fitted, m14, prepared, recursive, seed_models, seed_predictions, seeds_sql, sf_sql, rollout_sql
from caseloom.plans.registry import query
from caseloom.schema import ORDERS, get_schema
from caseloom.session import literal_table
from caseloom.sources import tables as t
from caseloom.plans.registry import ORACLE

query("f1_derailment", GREEDY + f""", w AS (SELECT list_transform(range(1, least(len(pred), len(tru)) + 1), lambda i: CASE WHEN pred[i] <> tru[i] THEN 1 ELSE 0 END) AS w FROM gp), z AS (SELECT w, list_position(w, 1) AS fw FROM w),
r AS (SELECT list_avg(w[fw + 1:]) AS r FROM z WHERE fw > 0 AND fw < len(w)) SELECT count(*) AS n, round(avg(r), 6) AS error_after, round(avg({ONE.format('r > 0.5')}), 6) AS derailed FROM r""")(
    lambda s, d: fa.derailment(greedy_pairs(s, d)[2]))
query("f2_loops", GREEDY + f"SELECT count(*) AS n, round(avg({ONE.format('len(list_filter(range(1, len(pred) - 1), lambda i: pred[i] = pred[i + 1] AND pred[i + 1] = pred[i + 2])) > 0')}), 6) AS loop_share FROM gp")(
    lambda s, d: fa.loop_share(greedy_pairs(s, d)[2]))


@query("f3_monotonicity", ms.model() + _REM + f""", rp AS (SELECT e.case_id, e.pos, e.n, complete, coalesce(rm.med, (SELECT med FROM rg), 0) AS h FROM e LEFT JOIN rm ON rm.act = e.act AND rm.posb = least(e.pos, 10) WHERE split = 'test' AND complete AND n > 2),
l AS (SELECT case_id, h, lag(h) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM rp), c AS (SELECT case_id, avg({ONE.format('h <= b')}) AS m FROM l WHERE b IS NOT NULL GROUP BY 1) SELECT round(avg(m), 6) AS monotone, count(*) AS n_cases FROM c""")
def f3(spark, d):
    p, m = fitted(spark, d)
    return fa.remaining_monotonicity(tr.predict_remaining(p.part("test"), m))


_DB = "CASE WHEN {0} <= 2 THEN '1-2' WHEN {0} <= 5 THEN '3-5' WHEN {0} <= 10 THEN '6-10' ELSE '11+' END"


@query("f4_distance_accuracy", ms.test_scores() + f""", ds AS (SELECT case_id, pos, n, max(CASE WHEN activity = 'error' THEN pos END) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM e WHERE split = 'test')
SELECT CASE WHEN l IS NULL THEN 'none' ELSE {_DB.format('(pos - l)')} END AS bucket, count(*) AS n, round(avg({ONE.format('pred = y_id')}), 6) AS accuracy FROM s JOIN ds USING (case_id, pos) WHERE pos < n - 1 GROUP BY 1""")
def f4(spark, d):
    p, m = fitted(spark, d)
    s = me.score(tr.predict_next(p.part("test"), m))
    return fa.accuracy_by_distance(s, fa.is_informative(words=["error"]))


@query("f5_forgetting", ms.model() + """, fi AS (SELECT case_id, min(CASE WHEN activity = 'error' THEN pos END) AS i0, count(*) AS ln FROM e WHERE split = 'test' GROUP BY 1),
fo AS (SELECT * FROM fi WHERE i0 > 0 AND i0 < ln - 2 AND ln >= 4),
bs AS (SELECT case_id, pos, i0, id1, act FROM e JOIN fo USING (case_id) WHERE pos > i0 AND pos < n - 1),
ct AS (SELECT case_id, row_number() OVER w AS pos, lag(act) OVER w AS id1, act FROM e JOIN fo USING (case_id) WHERE pos <> i0 WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
rs AS (SELECT DISTINCT id1, act FROM (SELECT id1, act FROM bs UNION ALL SELECT id1, act FROM ct)),
rk AS (SELECT id1, act, CASE WHEN t2.ctx IS NOT NULL THEN 2 WHEN t1.ctx IS NOT NULL THEN 1 ELSE 0 END AS k, CASE WHEN t2.ctx IS NOT NULL THEN t2.ctx WHEN t1.ctx IS NOT NULL THEN t1.ctx ELSE '' END AS ctx FROM rs
 LEFT JOIN tot t2 ON t2.k = 2 AND t2.ctx = id1 || '>' || act LEFT JOIN tot t1 ON t1.k = 1 AND t1.ctx = CAST(act AS VARCHAR)),
kl AS (SELECT bs.case_id, bs.pos, any_value(bs.pos - i0) AS dist, sum(p1.p * (ln(p1.p + 1e-9) - ln(p2.p + 1e-9))) AS kl FROM bs JOIN ct ON ct.case_id = bs.case_id AND ct.pos = bs.pos
 JOIN rk r1 ON r1.act = bs.act AND r1.id1 IS NOT DISTINCT FROM bs.id1 JOIN rk r2 ON r2.act = ct.act AND r2.id1 IS NOT DISTINCT FROM ct.id1
 JOIN pr p1 ON p1.k = r1.k AND p1.ctx = r1.ctx JOIN pr p2 ON p2.k = r2.k AND p2.ctx = r2.ctx AND p2.cls = p1.cls GROUP BY 1, 2)
SELECT """ + _DB.format("dist") + " AS bucket, count(*) AS n, round(avg(kl), 6) + 0.0 AS kl FROM kl GROUP BY 1")
def f5(spark, d):
    p, m = fitted(spark, d)
    return fa.forgetting(p.part("test"), m, fa.is_informative(words=["error"])).withColumn("kl", F.col("kl") + 0.0)


@query("f6_worst_suffixes", GREEDY + f"SELECT case_id, pos, round({SIM}, 6) AS sim, array_to_string(pred, ',') AS pred, array_to_string(tru, ',') AS \"true\" FROM gp WHERE len(tru) >= 3 ORDER BY 3, 1, 2 LIMIT 3")
def f6(spark, d):
    return fa.worst_suffixes(greedy_pairs(spark, d)[2])


# ------------------------------------------------------------------ uses
_EN = seeds_sql() + """, es AS MATERIALIZED (SELECT case_id, pos, any_value(len) AS len, y_id, max(CASE WHEN cls = y_id THEN p END) AS p_y, arg_min(cls, (-round(p, 12), cls)) AS pred, -sum(p * ln(greatest(p, 1e-12))) AS ent FROM en GROUP BY case_id, pos, y_id),
hs AS MATERIALIZED (SELECT case_id, pos, avg(h) AS h FROM (SELECT model_id, case_id, pos, -sum(p * ln(greatest(p, 1e-12))) AS h FROM sp_ GROUP BY ALL) GROUP BY ALL) """


def ensemble_rows(spark, d):
    p, preds = seed_predictions(spark, d)
    return p, preds, ds.epistemic(preds)


_COV = ", ".join(f"({c}, {c / 100}::DOUBLE)" for c in (100, 90, 80, 70, 50, 30))


@query("q1_selective", _EN + f""", rk AS (SELECT {ONE.format('pred = y_id')} AS ok, row_number() OVER (ORDER BY round(ent, 9), case_id, pos) - 1 AS r, count(*) OVER () AS n FROM es),
te AS (SELECT avg(a) AS m FROM (SELECT c, sum(ok) / floor(any_value(n) * (c / 10::DOUBLE)) AS a FROM rk CROSS JOIN range(1, 11) x(c) WHERE r < floor(n * (c / 10::DOUBLE)) GROUP BY c))
SELECT coverage, round(sum(ok) / floor(any_value(n) * f), 6) AS accuracy, round(any_value(m), 6) AS mean10 FROM rk CROSS JOIN (VALUES {_COV}) v(coverage, f) CROSS JOIN te WHERE r < floor(n * f) GROUP BY coverage, f""")
def q1(spark, d):
    return ds.selective(ensemble_rows(spark, d)[2])


@query("q2_epistemic", _EN + f", j AS (SELECT es.*, ent - h AS mi, pred = y_id AS ok FROM es JOIN hs USING (case_id, pos)) SELECT count(*) AS n, round(avg(ent), 6) AS entropy, round(avg(mi), 6) AS mi, round(avg(mi) FILTER (NOT ok), 6) AS mi_wrong, round(avg(mi) FILTER (ok), 6) AS mi_right FROM j")
def q2(spark, d):
    return ds.uncertainty_report(ensemble_rows(spark, d)[2])


def _lp(i: str, where: str) -> str:
    x = LAPLACE.lstrip(", ").replace("FROM trn WHERE", f"FROM e WHERE {where} AND")
    for n in ("lr", "mu", "lp"):
        x = x.replace(f"{n} AS (", f"{n}{i} AS (").replace(f"{n} AS MATERIALIZED", f"{n}{i} AS MATERIALIZED").replace(f"FROM {n} ", f"FROM {n}{i} {n} ").replace(f"JOIN {n} ", f"JOIN {n}{i} {n} ")
    return x


_THIRDS = [f"split = 'train' AND {q.hash60(11, 'case_id')} % 3 = {i}" for i in range(3)]


@query("q3_breach_risk", q.with_(ms.encoded("a"), _lp("x", "split = 'train'")) + f""", th AS (SELECT 'median' AS label, quantile_cont(y_rem, 0.5) AS lim FROM e WHERE split = 'train' UNION ALL SELECT 'p90', quantile_cont(y_rem, 0.9) FROM e WHERE split = 'train'),
rk AS (SELECT label, CASE WHEN y_rem > lim THEN 1 ELSE 0 END AS y, round({sf_sql('ln(1 + lim)')}, 9) AS p FROM e JOIN lpx ON lpx.act = e.act AND lpx.posb = least(e.pos, 10) CROSS JOIN th WHERE split = 'test' AND y_rem IS NOT NULL AND e.pos < e.n - 1),
au AS (SELECT a.label, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auroc FROM rk a JOIN rk b ON a.label = b.label AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT label, 'single' AS scorer, count(*) AS n, round(avg(y), 6) AS pos_rate, round(any_value(auroc), 6) AS auroc, round(avg((p - y) * (p - y)), 6) AS brier FROM rk LEFT JOIN au USING (label) GROUP BY 1""")
def q3(spark, d):
    p = prepared(spark, d)
    fits = tr.fit_laplace(p.part("train")).withColumn("scorer", F.lit("single"))
    return ds.breach_report(ds.breach_risk(p.part("test"), fits, ds.breach_thresholds(p.part("train"))))


@query("q3_breach_ensemble", q.with_(ms.encoded("a"), *[_lp(str(i), w) for i, w in enumerate(_THIRDS)]) + f""", th AS (SELECT 'median' AS label, quantile_cont(y_rem, 0.5) AS lim FROM e WHERE split = 'train' UNION ALL SELECT 'p90', quantile_cont(y_rem, 0.9) FROM e WHERE split = 'train'),
lps AS (SELECT * FROM lp0 UNION ALL SELECT * FROM lp1 UNION ALL SELECT * FROM lp2),
rs AS (SELECT e.case_id, e.pos, label, CASE WHEN y_rem > lim THEN 1 ELSE 0 END AS y, avg({sf_sql('ln(1 + lim)')}) AS p0 FROM e JOIN lps ON lps.act = e.act AND lps.posb = least(e.pos, 10) CROSS JOIN th WHERE split = 'test' AND y_rem IS NOT NULL AND e.pos < e.n - 1 GROUP BY ALL),
rk AS (SELECT label, y, round(p0, 9) AS p FROM rs),
au AS (SELECT a.label, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auroc FROM rk a JOIN rk b ON a.label = b.label AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT label, 'ensemble' AS scorer, count(*) AS n, round(avg(y), 6) AS pos_rate, round(any_value(auroc), 6) AS auroc, round(avg((p - y) * (p - y)), 6) AS brier FROM rk LEFT JOIN au USING (label) GROUP BY 1""")
def q3e(spark, d):
    from caseloom.functions.columns import hash_order

    p = prepared(spark, d)
    train = p.part("train").withColumn("_s", hash_order(11, "case_id") % 3)
    fits = rp.add_sources([tr.fit_laplace(train.where(F.col("_s") == i)).withColumn("scorer", F.lit(str(i))) for i in range(3)])
    risk = ds.breach_risk(p.part("test"), fits, ds.breach_thresholds(p.part("train")))
    mean = risk.groupBy("case_id", "pos", "label", "y").agg(F.avg("p").alias("p")).withColumn("scorer", F.lit("ensemble"))
    return ds.breach_report(mean)


_SC = _EN + ", cs AS (SELECT case_id, avg(-ln(greatest(p_y, 1e-12))) AS score, count(*) AS n_scored, any_value(len) AS len FROM es GROUP BY 1) "


@query("q4_anomalies", _SC + "SELECT case_id, round(score, 6) AS score, n_scored FROM cs ORDER BY 2 DESC, 1 LIMIT 10")
def q4(spark, d):
    return ds.most_anomalous(ds.case_scores(ensemble_rows(spark, d)[2]))


_RANK = "(SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM x)"


@query("q4_spearman_length", _SC + f", x AS (SELECT round(score, 9) AS a, len AS b FROM cs) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM {_RANK}")
def q4s(spark, d):
    _, preds, rows = ensemble_rows(spark, d)
    lens = preds.groupBy("case_id").agg(F.max("n").alias("len"))
    c = ds.case_scores(rows).withColumn("score", F.round("score", 9)).join(lens, "case_id")
    return me.spearman(c.select("score", "len"), "score", "len")


@query("q4_spearman_models", _SC + ", " + ms.fitted() + ", " + ms.scored("split = 'test'") + f", ws AS (SELECT case_id, avg(-ln(greatest(p_y, 1e-12))) AS w FROM s GROUP BY 1), x AS (SELECT round(score, 9) AS a, round(w, 9) AS b FROM cs JOIN ws USING (case_id)) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM {_RANK}")
def q4m(spark, d):
    p, preds, rows = ensemble_rows(spark, d)
    whole = ds.case_scores(me.score(tr.predict_next(p.part("test").where(F.col("y_id").isNotNull()), tr.fit_prepared(p))))
    a = ds.case_scores(rows).select("case_id", F.round("score", 9).alias("a"))
    return me.spearman(a.join(whole.select("case_id", F.round("score", 9).alias("b")), "case_id").select("a", "b"), "a", "b")


# ------------------------------------------------------------------ report tables
def metric_rows(spark, d, log, split_name, order, seed=0):
    """Tidy (run, model, metric, value, seed) rows of one fitted model."""
    ev = t.read_log(spark, d, log)
    schema = get_schema(log)
    if split_name == "random":
        p = en.prepare(sp.assign_random(ev, seed), schema, order=order)
    else:
        p = en.prepare(ev, schema, sp.split_chronological(fr.case_table(ev, schema)), order=order)
    m = tr.TransitionModel(order, 0.1, p.size, None, tr.smooth(tr.transition_counts(p.part("train"), order), p.size, 0.1), None, None, None)
    s = me.score(tr.predict_next(tr.compact(p.part("test"), order), m))
    r = s.agg(me.wavg("nll").alias("nll"), me.wavg("correct").alias("accuracy"))
    return r.unpivot([], ["nll", "accuracy"], "metric", "value").select(
        F.lit(f"{log}_{split_name}").alias("run"), F.lit(f"order{order}").alias("model"), "metric", "value", F.lit(seed).alias("seed"))


def metric_sql(x, seed, order, chrono=False, where="split = 'train'"):
    """(nll, accuracy) of an order-``order`` model as a sub-select."""
    base = ms.encoded(x, seed)
    if chrono:
        base = base.replace(q.split_cte(x, seed), q.cases(x) + f""",
ch0 AS (SELECT case_id, row_number() OVER (ORDER BY first_us, case_id) - 1 AS rank, count(*) OVER () AS nc FROM {x}_cases),
{x}_split AS (SELECT case_id, CASE WHEN rank < floor(nc * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(nc * 0.7::DOUBLE) + floor(nc * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ch0)""")
    fit = ms.fitted(where)
    if order < 2:
        fit = fit.replace(" UNION ALL SELECT y_id, y_ldt, 2, id1 || '>' || act FROM trn WHERE id1 IS NOT NULL", "")
    return f"({q.with_(base, fit)}, {ms.scored(chr(39).join(['split = ', 'test', '']))} SELECT avg(-ln(greatest(p_y, 1e-12))) AS nll, avg({ONE.format('pred = y_id')}) AS accuracy FROM s)"


@query("r1_model_rows", "WITH x AS (" + " UNION ALL ".join(f"SELECT 'orders_random' AS run, 'order{k}' AS model, {s} AS seed, * FROM {metric_sql('b', s, k)}" for k in (1, 2) for s in (0, 1)) + ") SELECT run, model, round(avg(nll), 6) AS nll, round(stddev_pop(nll), 6) AS nll_std, round(avg(accuracy), 6) AS accuracy, round(stddev_pop(accuracy), 6) AS accuracy_std, count(DISTINCT seed) AS n_seeds FROM x GROUP BY 1, 2")
def r1(spark, d):
    rows = [metric_rows(spark, d, "orders", "random", k, s) for k in (1, 2) for s in (0, 1)]
    return rp.model_rows(rp.add_sources(rows), ["nll", "accuracy"])


def attribute_frame(p, spark, d):
    """Label contexts replaced by (attribute, label) contexts."""
    tr_ = p.part("train").select("ev_k")
    return en.lookup(p.frame.drop("id1"), en.fit_vocab(tr_, "ev_k", 5, en.CAT_SPECIALS), "ev_k", "id1")


_ATTR = q.with_(ms.encoded("a").replace("lag(act) OVER w AS id1", "kid AS id1").replace("coalesce(v.id, 1) AS act FROM", "coalesce(v.id, 1) AS act, coalesce(vk.id, 1) AS kid FROM").replace("LEFT JOIN v ON f.activity = v.value)", "LEFT JOIN v ON f.activity = v.value LEFT JOIN vk ON vk.value = f.ev_k)").replace(
    "vs AS (", "kr AS (SELECT ev_k FROM a_raw JOIN a_split USING (case_id) WHERE split = 'train'), vk AS (SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) + 1 AS INTEGER) AS id FROM (SELECT ev_k AS value, count(*) AS n FROM kr GROUP BY 1) WHERE n >= 5),\nvs AS ("), ms.fitted())


def _masked(sql: str) -> str:
    return sql.replace("id1 || '>' || act WHEN", "1 || '>' || act WHEN").replace("t2.ctx = id1 || '>' || act", "t2.ctx = 1 || '>' || act")


_P16 = _ATTR + ", " + ms.scored("split = 'test'") + ", " + _masked(ms.scored("split = 'test'")).replace("bc AS", "bcm AS").replace("FROM bc JOIN pr ON pr.k = bc.k AND pr.ctx = bc.ctx", "FROM bcm bc JOIN pr ON pr.k = bc.k AND pr.ctx = bc.ctx").replace("pd AS", "pdm AS").replace("FROM pd)", "FROM pdm)").replace("s AS MATERIALIZED (SELECT case_id, pos, y_id, max", "sm AS MATERIALIZED (SELECT case_id, pos, y_id, max")


@query("p16_attribute_masking", _P16 + "SELECT 'clicks' AS run, round((SELECT avg(-ln(greatest(p_y, 1e-12))) FROM s), 6) AS x, round((SELECT avg(-ln(greatest(p_y, 1e-12))) FROM sm), 6) AS y, round(((SELECT avg(-ln(greatest(p_y, 1e-12))) FROM sm) - (SELECT avg(-ln(greatest(p_y, 1e-12))) FROM s)) / abs((SELECT avg(-ln(greatest(p_y, 1e-12))) FROM s)), 6) AS change")
def p16(spark, d):
    p = prepared(spark, d)
    f = attribute_frame(p, spark, d)
    m = tr.TransitionModel(2, 0.1, p.size, None, tr.smooth(tr.transition_counts(f.where("split = 'train'"), 2), p.size, 0.1), None, None, None)
    test = f.where("split = 'test'")
    nll = lambda x: me.score(tr.predict_next(tr.compact(x, 2), m)).agg(me.wavg("nll").alias("value")).withColumn("run", F.lit("clicks"))
    return rp.relative_change(nll(test), nll(test.withColumn("id1", F.lit(en.UNK))), ["run"])


@query("r2_greedy_and_exact", GREEDY + f"SELECT 'orders_random' AS run, round(avg({SIM}), 6) AS similarity, round(avg({ONE.format(f'len(pred) < {MAX_LEN}')}), 6) AS terminated FROM gp")
def r2(spark, d):
    pairs = greedy_pairs(spark, d)[2].withColumn("sim", me.dl_similarity("pred", "true"))
    return pairs.agg(rnd(F.avg("sim")).alias("similarity"), rnd(F.avg((F.size("pred") < MAX_LEN).cast("double"))).alias("terminated")).withColumn("run", F.lit("orders_random"))


@query("r3_split_shift", f"WITH x AS (SELECT * FROM {metric_sql('b', 0, 2)}), y AS (SELECT * FROM {metric_sql('b', 0, 2, True)}), a AS (UNPIVOT x ON nll, accuracy INTO NAME metric VALUE v), b AS (UNPIVOT y ON nll, accuracy INTO NAME metric VALUE v) SELECT 'order2' AS model, metric, round(a.v, 6) AS x, round(b.v, 6) AS y, round((b.v - a.v) / abs(a.v), 6) AS change FROM a JOIN b USING (metric)")
def r3(spark, d):
    return rp.relative_change(metric_rows(spark, d, "orders", "random", 2), metric_rows(spark, d, "orders", "chrono", 2), ["model", "metric"])


@query("r4_transfer_rows", ORACLE["m14_transfer"].replace("SELECT mode, count(*) AS n, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM py GROUP BY 1", ", mo AS (SELECT mode, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM py GROUP BY 1) SELECT max(CASE WHEN mode = 'zero_shot' THEN nll END) AS zero_shot, max(CASE WHEN mode = 'few_shot_refit' THEN nll END) AS refit, max(CASE WHEN mode = 'few_shot_scratch' THEN nll END) AS scratch FROM mo"))
def r4(spark, d):
    v = lambda m: F.max(F.when(F.col("mode") == m, F.col("nll")))
    return m14(spark, d).agg(v("zero_shot").alias("zero_shot"), v("few_shot_refit").alias("refit"), v("few_shot_scratch").alias("scratch"))


def _fold_sql(fold: int, k: int = 3) -> str:
    n, f = f"n", f"CASE WHEN rank < (n % {k}) * (n // {k} + 1) THEN rank // (n // {k} + 1) ELSE n % {k} + (rank - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"
    cte = f"""fr AS (SELECT case_id, row_number() OVER (ORDER BY {q.hash60(0, 'case_id')}, case_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM b_raw)), ff AS (SELECT case_id, {f} AS fold FROM fr),
fo AS (SELECT case_id, row_number() OVER (ORDER BY {q.hash60(1000 + fold, 'case_id')}, case_id) - 1 AS r2, count(*) OVER () AS n2 FROM ff WHERE fold <> {fold}),
b_split AS (SELECT case_id, CASE WHEN r2 < floor(n2 * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM fo UNION ALL SELECT case_id, 'test' FROM ff WHERE fold = {fold})"""
    return metric_sql("b", 0, 2).replace(q.split_cte("b", 0), cte).replace(q.TERMINAL["b"], "true")


@query("r5_fold_report", "WITH x AS (" + " UNION ALL ".join(f"SELECT {f} AS fold, * FROM {_fold_sql(f)}" for f in range(3)) + "), u AS (UNPIVOT x ON nll, accuracy INTO NAME metric VALUE v) SELECT 'order2' AS model, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_folds, CASE WHEN metric = 'accuracy' THEN 0.75::DOUBLE END AS published FROM u GROUP BY metric")
def r5(spark, d):
    rows = []
    for f in range(3):
        ev = t.orders(spark, d)
        p = en.prepare(ev, ORDERS, sp.split_cv(ev, f, 3), assume_complete=True)
        m = tr.TransitionModel(2, 0.1, p.size, None, tr.smooth(tr.transition_counts(p.part("train"), 2), p.size, 0.1), None, None, None)
        s = me.score(tr.predict_next(tr.compact(p.part("test"), 2), m))
        r = s.agg(me.wavg("nll").alias("nll"), me.wavg("correct").alias("accuracy")).unpivot([], ["nll", "accuracy"], "metric", "value")
        rows.append(r.withColumn("model", F.lit("order2")))
    return rp.fold_report(rp.add_sources(rows), literal_table(spark, [("accuracy", 0.75)], "metric string, published double"))


@query("k2_most_errors", q.with_(q.A_RAW) + "SELECT case_id, count(*) AS n FROM a_raw WHERE activity = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def k2(spark, d):
    from caseloom.operators.ranking import top_k

    ev = t.clicks(spark, d).where(F.col("activity") == "error")
    return top_k(ev.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), F.col("case_id"))


@query("k3_coverage_cut", "SELECT 'cheap 30%' AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r < floor(n * 0.3::DOUBLE)")
def k3(spark, d):
    from caseloom.operators.ranking import global_rank

    o = t.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    r = global_rank(o, ["o_totalprice", "o_orderkey"], total="total")
    return r.where(F.col("rank") < F.floor(F.col("total") * 0.3)).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean")).withColumn("part", F.lit("cheap 30%"))
