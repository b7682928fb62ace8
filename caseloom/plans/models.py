"""Model queries M1-M7, M10-M15, J4."""

from pyspark.sql import functions as F

from caseloom.functions.columns import rnd
from caseloom.operators import encode as en, metrics as me, rollout as ro, sparse, splits as sp, transitions as tr
from caseloom.plans import modelsql as ms, sqltext as q
from caseloom.plans.registry import query
from caseloom.schema import CLICKS, DIALOGS, ORDERS
from caseloom.session import lookup_side
from caseloom.sources import tables as t


def prepared(spark, d, seed=0, log="clicks", **kw):
    schema = {"clicks": CLICKS, "orders": ORDERS, "dialogs": DIALOGS}[log]
    ev = t.read_log(spark, d, log)
    return en.prepare(sp.assign_random(ev, seed), schema, **kw)


def fitted(spark, d, seed=0, log="clicks", **kw):
    p = prepared(spark, d, seed, log, **kw)
    return p, tr.fit_prepared(p)


def join_text(col, n=8):
    return F.array_join(F.transform(col, lambda x: F.format_string(f"%.{n}f", x)), ",")


@query("m1_transitions", ms.model() + "SELECT cnt.k, cnt.ctx, y, cnt.n, total::BIGINT AS total, round(p, 8) AS p FROM cnt JOIN tot USING (k, ctx) JOIN pr ON pr.k = cnt.k AND pr.ctx = cnt.ctx AND pr.cls = y")
def m1(spark, d):
    p, m = fitted(spark, d)
    return m.counts.join(m.probs, ["k", "ctx"]).select("k", "ctx", "y", "n", "total", rnd(sparse.prob("dist", "y"), 8).alias("p"))


@query("m2_backoff", ms.model() + ", " + ms.best_context("split = 'test'") + "SELECT case_id, pos, bc.k, cls, round(p, 8) AS p FROM bc JOIN pr ON pr.k = bc.k AND pr.ctx = bc.ctx")
def m2(spark, d):
    p, m = fitted(spark, d)
    out = tr.predict_next(p.part("test"), m)
    return out.select("case_id", "pos", F.col("probs_k").alias("k"), F.posexplode("probs").alias("cls", "p")).withColumn("p", rnd("p", 8))


_WAIT = ", wt AS MATERIALIZED (SELECT k, ctx, quantile_cont(y_ldt, 0.1) AS lo, quantile_cont(y_ldt, 0.5) AS md, quantile_cont(y_ldt, 0.9) AS hi FROM cx WHERE y_ldt IS NOT NULL GROUP BY ALL), "


@query("m3_wait_median", ms.model() + _WAIT + ms.best_context("split = 'test'", "wt") + "SELECT case_id, pos, round(exp(md) - 1, 4) AS dt_hat FROM bc JOIN wt ON wt.k = bc.k AND wt.ctx = bc.ctx")
def m3(spark, d):
    p, m = fitted(spark, d)
    return tr.predict_wait(p.part("test"), m).select("case_id", "pos", rnd("dt_hat", 4).alias("dt_hat"))


_REM = ", rr AS (SELECT act, least(pos, 10) AS posb, y_rem FROM trn WHERE y_rem IS NOT NULL), rm AS (SELECT act, posb, median(y_rem) AS med FROM rr GROUP BY ALL), rg AS (SELECT median(y_rem) AS med FROM rr) "


@query("m4_remaining_median", ms.model() + _REM + "SELECT case_id, pos, round(coalesce(rm.med, (SELECT med FROM rg), 0), 4) AS rem_hat FROM e LEFT JOIN rm ON rm.act = e.act AND rm.posb = least(e.pos, 10) WHERE split = 'test'")
def m4(spark, d):
    p, m = fitted(spark, d)
    return tr.predict_remaining(p.part("test"), m).select("case_id", "pos", rnd("rem_hat", 4).alias("rem_hat"))


def rollout_sql(limit: int) -> str:
    """Greedy continuation per distinct context as a recursive query."""
    return f""", am AS MATERIALIZED (SELECT k, ctx, arg_min(cls, (-p, cls)) AS best FROM pr GROUP BY ALL),
st AS (SELECT DISTINCT id1, act FROM e WHERE split = 'test'),
ro AS (SELECT id1 AS s1, act AS s2, id1, act, CAST([] AS INTEGER[]) AS suffix, 0 AS step, false AS fin FROM st
 UNION ALL SELECT s1, s2, act, nx, CASE WHEN nx = 2 THEN suffix ELSE list_append(suffix, nx) END, step + 1, nx = 2 FROM (SELECT ro.*, coalesce(a2.best, a1.best, a0.best) AS nx FROM ro
  LEFT JOIN am a2 ON a2.k = 2 AND a2.ctx = ro.id1 || '>' || ro.act LEFT JOIN am a1 ON a1.k = 1 AND a1.ctx = CAST(ro.act AS VARCHAR) LEFT JOIN am a0 ON a0.k = 0 WHERE step < {limit} AND NOT fin)),
rx AS MATERIALIZED (SELECT s1, s2, suffix FROM ro QUALIFY row_number() OVER (PARTITION BY s1, s2 ORDER BY step DESC) = 1)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("m5_greedy_rollout", recursive(ms.model("c") + rollout_sql(50)) + "SELECT case_id, pos, array_to_string(suffix, ',') AS suffix FROM e JOIN rx ON rx.s2 = e.act AND rx.s1 IS NOT DISTINCT FROM e.id1 WHERE split = 'test'")
def m5(spark, d):
    p, m = fitted(spark, d, log="dialogs")
    out = ro.greedy(p.part("test").select("case_id", "pos", "id1", "act"), m, 50)
    return out.select("case_id", "pos", F.array_join("pred", ",").alias("suffix"))


SAMPLE_STEPS, SAMPLES = 30, 5


def sample_sql(limit: int = SAMPLE_STEPS, n: int = SAMPLES) -> str:
    u = q.unit(1, "(case_id || ':' || pos || ':' || sample || ':' || step)")
    return f""", cu AS MATERIALIZED (SELECT k, ctx, cls, sum(p) OVER (PARTITION BY k, ctx ORDER BY cls) AS c FROM pr),
hk AS MATERIALIZED (SELECT DISTINCT k, ctx FROM pr),
ro AS (SELECT case_id, pos, sample, id1, act, CAST([] AS INTEGER[]) AS suffix, 0 AS step, false AS fin FROM e CROSS JOIN (SELECT unnest(range({n})) AS sample) WHERE split = 'test'
 UNION ALL SELECT case_id, pos, sample, act, nx, CASE WHEN nx = 2 THEN suffix ELSE list_append(suffix, nx) END, step + 1, nx = 2 FROM (
  SELECT r.case_id, r.pos, r.sample, r.act, r.suffix, r.step, least(count(*) FILTER (c <= u), (SELECT sz - 1 FROM vs))::INTEGER AS nx FROM (
   SELECT ro.*, {u} AS u, CASE WHEN h2.ctx IS NOT NULL THEN 2 WHEN h1.ctx IS NOT NULL THEN 1 ELSE 0 END AS k, CASE WHEN h2.ctx IS NOT NULL THEN id1 || '>' || act WHEN h1.ctx IS NOT NULL THEN CAST(act AS VARCHAR) ELSE '' END AS ctx
   FROM ro LEFT JOIN hk h2 ON h2.k = 2 AND h2.ctx = ro.id1 || '>' || ro.act LEFT JOIN hk h1 ON h1.k = 1 AND h1.ctx = CAST(ro.act AS VARCHAR) WHERE step < {limit} AND NOT fin) r
  JOIN cu ON cu.k = r.k AND cu.ctx = r.ctx GROUP BY ALL)),
sx AS MATERIALIZED (SELECT case_id, pos, sample, suffix FROM ro QUALIFY row_number() OVER (PARTITION BY case_id, pos, sample ORDER BY step DESC) = 1)
"""


def sampled(spark, d, log="dialogs"):
    p, m = fitted(spark, d, log=log)
    return p, ro.sample(p.part("test").select("case_id", "pos", "id1", "act"), m, SAMPLE_STEPS, SAMPLES, seed=1)


@query("m6_sampled_rollout", recursive(ms.model("c") + sample_sql()) + "SELECT case_id, pos, sample, array_to_string(suffix, ',') AS suffix FROM sx")
def m6(spark, d):
    _, s = sampled(spark, d)
    return s.select("case_id", "pos", "sample", F.array_join("suffix", ",").alias("suffix"))


@query("m7_floor_vector", ms.model() + """, z AS (SELECT cx0.k, cx0.ctx, v.id AS cls, coalesce(cnt.n / total, 1e-6) AS p FROM tot cx0 CROSS JOIN v LEFT JOIN cnt ON cnt.k = cx0.k AND cnt.ctx = cx0.ctx AND cnt.y = v.id)
SELECT k, ctx, cls, round(p / sum(p) OVER (PARTITION BY k, ctx), 8) AS p FROM z""")
def m7(spark, d):
    p, m = fitted(spark, d)
    return tr.floor_vectors(m.counts, m.size).select("k", "ctx", F.posexplode(sparse.dense("dist")).alias("cls", "p")).withColumn("p", rnd("p", 8))


@query("m10_wait_interval", ms.model() + _WAIT + ms.best_context("split = 'test'", "wt") + "SELECT case_id, pos, round(exp(lo) - 1, 4) AS dt_lo, round(exp(hi) - 1, 4) AS dt_hi FROM bc JOIN wt ON wt.k = bc.k AND wt.ctx = bc.ctx")
def m10(spark, d):
    p, m = fitted(spark, d)
    return tr.predict_wait(p.part("test"), m).select("case_id", "pos", rnd("dt_lo", 4).alias("dt_lo"), rnd("dt_hi", 4).alias("dt_hi"))


LAPLACE = """, lr AS (SELECT act, least(pos, 10) AS posb, ln(1 + y_rem) AS lr FROM trn WHERE y_rem IS NOT NULL), mu AS (SELECT act, posb, median(lr) AS mu FROM lr GROUP BY ALL),
lp AS MATERIALIZED (SELECT lr.act, lr.posb, any_value(mu) AS mu, greatest(avg(abs(lr - mu)), exp(-1)) AS b FROM lr JOIN mu USING (act, posb) GROUP BY ALL) """


def sf_sql(x: str) -> str:
    return f"CASE WHEN {x} < mu THEN 1 - 0.5 * exp(({x} - mu) / b) ELSE 0.5 * exp(-(({x} - mu) / b)) END"


@query("m11_survival", ms.model() + LAPLACE + f"SELECT case_id, pos, round(mu, 6) AS mu, round(b, 6) AS b, round({sf_sql('ln(1 + 86400.0)')}, 6) AS p_over_day FROM e JOIN lp ON lp.act = e.act AND lp.posb = least(e.pos, 10) WHERE split = 'test'")
def m11(spark, d):
    p = prepared(spark, d)
    lp = tr.fit_laplace(p.part("train"))
    out = p.part("test").withColumn("posb", F.least("pos", F.lit(10))).join(lookup_side(lp, "laplace"), ["act", "posb"])
    return out.select("case_id", "pos", rnd("mu").alias("mu"), rnd("b").alias("b"), rnd(tr.laplace_sf("mu", "b", F.log1p(F.lit(86400.0)))).alias("p_over_day"))


@query("m12_component_backoff")
def m12(spark, d):
    """Strict chronological split of the order log on composite labels; unseen labels pass through their components."""
    from caseloom.operators import frame as fr

    ev = t.orders(spark, d).withColumn("activity", F.concat_ws("|", "activity", "case_segment"))
    split = sp.split_chronological(fr.case_table(ev, ORDERS))
    p = en.prepare(ev, ORDERS, split)
    m = tr.fit_prepared(p)
    comp = tr.component_counts(p.part("train"), p.vocab, "status")
    out = tr.predict_components(p.part("test"), m, comp, "status")
    return out.select("case_id", "pos", F.col("act"), F.posexplode("probs").alias("cls", "p")).withColumn("p", rnd("p", 8))


def seed_models(spark, d, n=3):
    """Models fitted on n hash-disjoint thirds of the training cases, and the shared test part."""
    from caseloom.functions.columns import hash_order

    p = prepared(spark, d)
    train = p.part("train").withColumn("_s", hash_order(11, "case_id") % n)
    return p, [tr.fit(train.where(F.col("_s") == i), p.size) for i in range(n)]


def seed_predictions(spark, d, n=3):
    """The mean forecast of the models for every test row with a next label."""
    p, ms_ = seed_models(spark, d, n)
    test = p.part("test").where(F.col("y_id").isNotNull()).select("case_id", "pos", "n", "y_id", *tr.context_columns(p.order))
    return p, tr.predict_mean(test, ms_)


def seeds_sql(n: int = 3) -> str:
    """``sp_``: per (model, prefix, class) probability for models on thirds of the training cases; ``en``: their mean."""
    body, parts = [], []
    for i in range(n):
        f = ms.fitted(f"split = 'train' AND {q.hash60(11, 'case_id')} % {n} = {i}")
        b = ms.best_context("split = 'test' AND y_id IS NOT NULL")
        chunk = f + ",\n" + b
        for name in ("trn", "cx", "cnt", "tot", "pr", "bc"):
            import re
            chunk = re.sub(rf"\b{name}\b", f"{name}{i}", chunk)
        body.append(chunk)
        parts.append(f"SELECT {i} AS model_id, bc{i}.case_id, bc{i}.pos, bc{i}.n AS len, bc{i}.y_id, cls, p FROM bc{i} JOIN pr{i} ON pr{i}.k = bc{i}.k AND pr{i}.ctx = bc{i}.ctx")
    return q.with_(ms.encoded("a"), *body, "sp_ AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")",
                   "en AS MATERIALIZED (SELECT case_id, pos, len, y_id, cls, avg(p) AS p FROM sp_ GROUP BY ALL)")


@query("m13_ensemble", seeds_sql() + "SELECT case_id, pos, cls, round(p, 8) AS p FROM en")
def m13(spark, d):
    _, out = seed_predictions(spark, d)
    return out.select("case_id", "pos", F.posexplode("probs").alias("cls", "p")).withColumn("p", rnd("p", 8))


_FEW = f"(SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY {q.hash60(9, 'case_id')}, case_id) - 1 AS r, count(*) OVER () AS n FROM a_split WHERE split = 'train') WHERE r < greatest(floor(n * 0.05::DOUBLE), 20))"
_SRC = f"{q.hash60(13, 'case_id')} % 2"


@query("m14_transfer", q.with_(ms.encoded("a")) + f""", sa AS (SELECT {{cols}} FROM e WHERE split = 'train' AND NOT case_id IN {_FEW} AND y_id IS NOT NULL), fw AS (SELECT {{cols}} FROM e WHERE case_id IN {_FEW} AND y_id IS NOT NULL),
w AS (SELECT *, 1.0::DOUBLE AS wt, 'zero_shot' AS mode FROM sa UNION ALL SELECT *, 0.25::DOUBLE, 'few_shot_refit' FROM sa UNION ALL SELECT *, 1.0::DOUBLE, 'few_shot_refit' FROM fw UNION ALL SELECT *, 1.0::DOUBLE, 'few_shot_scratch' FROM fw),
cx AS (SELECT mode, y_id, wt, 0 AS k, '' AS ctx FROM w UNION ALL SELECT mode, y_id, wt, 1, CAST(act AS VARCHAR) FROM w UNION ALL SELECT mode, y_id, wt, 2, id1 || '>' || act FROM w WHERE id1 IS NOT NULL),
cnt AS MATERIALIZED (SELECT mode, k, ctx, y_id AS y, sum(wt) AS n FROM cx GROUP BY ALL), tot AS MATERIALIZED (SELECT mode, k, ctx, sum(n) AS total FROM cnt GROUP BY ALL),
te AS (SELECT e.*, m.mode FROM e CROSS JOIN (SELECT DISTINCT mode FROM tot) m WHERE split = 'test' AND y_id IS NOT NULL),
bk AS (SELECT te.mode, te.case_id, te.pos, te.y_id, coalesce(t2.k, t1.k, 0) AS k, coalesce(t2.ctx, t1.ctx, '') AS ctx FROM te LEFT JOIN tot t2 ON t2.mode = te.mode AND t2.k = 2 AND t2.ctx = te.id1 || '>' || te.act LEFT JOIN tot t1 ON t1.mode = te.mode AND t1.k = 1 AND t1.ctx = CAST(te.act AS VARCHAR)),
py AS (SELECT bk.mode, (coalesce(cnt.n, 0) + 0.1::DOUBLE) / (tot.total + 0.1::DOUBLE * (SELECT sz FROM vs)) AS p FROM bk JOIN tot ON tot.mode = bk.mode AND tot.k = bk.k AND tot.ctx = bk.ctx LEFT JOIN cnt ON cnt.mode = bk.mode AND cnt.k = bk.k AND cnt.ctx = bk.ctx AND cnt.y = bk.y_id)
SELECT mode, count(*) AS n, round(avg(-ln(greatest(p, 1e-12))), 6) AS nll FROM py GROUP BY 1""".replace("{cols}", "case_id, id1, act, y_id"))
def m14(spark, d):
    p = prepared(spark, d)
    train = p.part("train")
    few = sp.few_shot(train, 0.05, 20, seed=9)
    few = lookup_side(few, "few")
    source, small = train.join(few, "case_id", "left_anti"), train.join(few, "case_id", "left_semi")
    cs, cf = tr.transition_counts(source, p.order), tr.transition_counts(small, p.order)
    both = cs.withColumn("n", F.col("n") * 0.25).unionByName(cf.withColumn("n", F.col("n") * 1.0)).groupBy("k", "ctx", "y").agg(F.sum("n").alias("n"))
    test = tr.compact(p.part("test"), p.order)
    out = None
    for mode, counts in (("zero_shot", cs), ("few_shot_refit", both), ("few_shot_scratch", cf)):
        m = tr.TransitionModel(p.order, 0.1, p.size, counts, tr.smooth(counts, p.size, 0.1), None, None, None)
        r = me.score(tr.predict_next(test, m)).agg(F.sum("w").alias("n"), rnd(me.wavg("nll")).alias("nll")).withColumn("mode", F.lit(mode))
        out = r if out is None else out.unionByName(r)
    return out


@query("m15_seed_sweep", q.with_("x AS (" + " UNION ALL ".join(
    f"SELECT * FROM ({ms.model('a', s)}, {ms.scored(chr(39).join(['split = ', 'test', '']))} SELECT {s} AS seed, avg(-ln(greatest(p_y, 1e-12))) AS nll, avg(CASE WHEN pred = y_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM s)" for s in (0, 1)) + ")")
    + "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM (UNPIVOT x ON nll, accuracy INTO NAME metric VALUE v) GROUP BY 1")
def m15(spark, d):
    rows = None
    for seed in (0, 1):
        p, m = fitted(spark, d, seed=seed)
        s = me.score(tr.predict_next(tr.compact(p.part("test"), p.order), m))
        r = s.agg(me.wavg("nll").alias("nll"), me.wavg("correct").alias("accuracy"))
        r = r.unpivot([], ["nll", "accuracy"], "metric", "value").withColumn("seed", F.lit(seed))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("metric").agg(rnd(F.avg("value")).alias("mean"), rnd(F.stddev_pop("value")).alias("std"), F.count(F.lit(1)).alias("n"))


@query("j4_backoff_order", ms.model() + ", " + ms.best_context("split = 'test'") + "SELECT k, count(*) AS n FROM bc GROUP BY 1")
def j4(spark, d):
    p, m = fitted(spark, d)
    return tr.predict_next(p.part("test"), m).groupBy(F.col("probs_k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
