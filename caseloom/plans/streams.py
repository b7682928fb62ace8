"""Event-log files S1 and streaming queries ST1-ST3."""

from pyspark.sql import functions as F

from caseloom.functions.columns import hash_unit, rnd
from caseloom.operators import encode as en, splits as sp, traces as tc, transitions as tr
from caseloom.plans import episodes as ep, modelsql as ms, sqltext as q
from caseloom.plans.models import _REM, _WAIT
from caseloom.plans.registry import query
from caseloom.plans.traces import MASKED_SQL, _WS, EPI, ERRS, ST, corrupted, masked_candidates
from caseloom.schema import CLICKS
from caseloom.session import scratch_path
from caseloom.sources import episodes as se, tables as t, xes
from caseloom.streaming import online as on


def export_xes(spark, d, name="clicks"):
    """The click log as event-log files written by Spark; a trace holds at most 4096 consecutive event ids of a case."""
    ev = t.clicks(spark, d)
    attr = lambda k, v: F.struct(F.lit(k).alias("_key"), v.cast("string").alias("_value"))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    e = F.struct(F.col("event_idx").alias("o"), F.array(attr("concept:name", F.col("ev_type")), attr("k", F.col("ev_k"))).alias("string"),
                 F.array(attr("time:timestamp", iso)).alias("date"), F.array(attr("value", F.col("ev_value"))).alias("float"))
    ev = ev.withColumn("trace", F.concat("case_id", F.lit("-"), F.floor(F.col("event_idx") / 4096).cast("string")))
    traces = ev.groupBy("trace").agg(F.transform(F.sort_array(F.collect_list(e)), lambda x: x.dropFields("o")).alias("event"))
    traces = traces.select(F.array(attr("concept:name", F.col("trace"))).alias("string"), "event")
    path = scratch_path(spark, f"xes-{name}")
    traces.write.format("xml").option("rowTag", "trace").option("rootTag", "log").save(path)
    return path


@query("s1_event_log_files", q.with_(q.A_RAW) + "SELECT case_id || '-' || (event_idx // 4096) AS case_id, row_number() OVER (PARTITION BY case_id, event_idx // 4096 ORDER BY event_idx) - 1 AS event_idx, us, activity, ev_k, ev_value FROM a_raw")
def s1(spark, d):
    raw = xes.read_events(spark, export_xes(spark, d), "clicks")
    e = xes.project(raw, ["concept:name", "k", "value"], [])
    return e.select("case_id", "event_idx", "us", F.col("ev_concept:name").alias("activity"), "ev_k", F.col("ev_value").cast("double").alias("ev_value"))


def replay(spark, d, batches=4):
    """The click log as a stream of files in arrival order."""
    ev = t.clicks(spark, d).select("case_id", "event_idx", "us", "activity")
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    path = on.in_batches(ev, [lo + (hi - lo) * i // batches for i in range(1, batches)], "us", "replay")
    return on.event_stream(spark, path, ev.schema)


@query("st1_online_features", q.with_(q.frame("a")) + "SELECT case_id, event_idx, pos, prev1, prev2, dt_s, elapsed_s, false AS late FROM a")
def st1(spark, d):
    out = on.run_available(on.online_features(replay(spark, d)), "online")
    return spark.read.parquet(out).select("case_id", "event_idx", "pos", "prev1", "prev2", "dt_s", "elapsed_s", "late")


DELAY_S, TURNS = 2 * 86_400, 4


def shuffled_arrival(spark, d):
    """The click log in ``TURNS`` parts by an arrival time up to a day after the event, and a last row that tells the time."""
    ev = t.clicks(spark, d).select("case_id", "event_idx", "us", "activity")
    lo, hi = ev.agg(F.min("us"), F.max("us")).first()
    at = F.col("us") + (hash_unit(5, "event_idx") * 86_400_000_000).cast("long")
    edges = [lo + (hi - lo) * i // TURNS for i in range(1, TURNS)]
    turn = sum([(at >= e).cast("int") for e in edges], F.lit(0))
    parts = [ev.where(turn == i) for i in range(TURNS)]
    return [*parts, on.clock_row(ev, hi + 2 * DELAY_S * 1_000_000)]


def event_time_run(spark, d, label, after=lambda f: f):
    out = on.run_in_turns(shuffled_arrival(spark, d), label, lambda s: after(on.event_time_features(s, f"{DELAY_S} seconds")))
    return spark.read.parquet(out)


@query("st1_event_time_features", q.with_(q.frame("a")) + "SELECT case_id, event_idx, pos, prev1, prev2, dt_s, elapsed_s, false AS late FROM a")
def st1e(spark, d):
    return event_time_run(spark, d, "event-time").select("case_id", "event_idx", "pos", "prev1", "prev2", "dt_s", "elapsed_s", "late")


@query("st1_online_forecasts", ms.model() + _WAIT + ms.best_context("act >= 0", "wt") + _REM + """SELECT bc.case_id, bc.event_idx, round(exp(lo) - 1, 4) AS dt_lo, round(exp(md) - 1, 4) AS dt_hat, round(exp(hi) - 1, 4) AS dt_hi,
 round(coalesce(rm.med, (SELECT med FROM rg), 0), 4) AS rem_hat FROM bc JOIN wt ON wt.k = bc.k AND wt.ctx = bc.ctx LEFT JOIN rm ON rm.act = bc.act AND rm.posb = least(bc.pos, 10)""")
def st1f(spark, d):
    p = en.prepare(sp.assign_random(t.clicks(spark, d)), CLICKS)
    m = tr.fit_prepared(p)
    out = event_time_run(spark, d, "forecasts", lambda f: on.online_forecasts(f, p.vocab, m).select("case_id", "event_idx", "dt_lo", "dt_hat", "dt_hi", "rem_hat"))
    return out.select("case_id", "event_idx", *[rnd(c, 4).alias(c) for c in ("dt_lo", "dt_hat", "dt_hi", "rem_hat")])


@query("st1_online_predictions", ms.model() + ", " + ms.best_context("act >= 0") + "SELECT case_id, event_idx, cls, round(p, 8) AS p FROM bc JOIN pr ON pr.k = bc.k AND pr.ctx = bc.ctx")
def st1p(spark, d):
    ev = t.clicks(spark, d)
    p = en.prepare(sp.assign_random(ev), CLICKS)
    m = tr.fit_prepared(p)
    out = on.run_available(on.online_predictions(on.online_features(replay(spark, d)), p.vocab, m).select("case_id", "event_idx", "probs"), "online-pred")
    return spark.read.parquet(out).select("case_id", "event_idx", F.posexplode("probs").alias("cls", "p")).withColumn("p", rnd("p", 8))


@query("st2_world_state", ST.rstrip() + _WS + "SELECT episode_id, kind, key, value FROM wl WHERE value IS NOT NULL")
def st2(spark, d):
    steps = ep.steps(spark, d)
    path = on.in_batches(steps, [2, 4], "turn", "steps")
    stream = on.event_stream(spark, path, steps.schema)
    out = on.run_available(on.world_state_stream(stream), "world", "update", on.latest_table)
    latest = on.read_latest(spark, out, ["episode_id", "kind", "key"])
    state = latest.select("episode_id", "kind", "key", F.col("_v.v").alias("value"), "since", "place").where(F.col("value").isNotNull())
    return tc.newest_notes(state).drop("since", "place")


@query("st3_episode_sink", EPI.rstrip() + ", " + ERRS + " SELECT CASE WHEN errors = '' THEN 'episodes' ELSE 'invalid' END AS sink, count(*) AS n FROM er GROUP BY 1")
def st3(spark, d):
    path = scratch_path(spark, "inbox")
    corrupted(spark, d).write.json(path)
    stream = on.event_stream(spark, path, se.EPISODE + ", _corrupt string", fmt="json", files_per_batch=4)
    out = on.run_available(stream, "sink", on_batch=on.episode_sink)
    part = lambda s: spark.read.schema(se.EPISODE).json(f"{out}/{s}/*").select(F.lit(s).alias("sink"))
    return part("episodes").unionByName(part("invalid")).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query("st3_masked_documents", MASKED_SQL)
def st3m(spark, d):
    path = scratch_path(spark, "inbox")
    corrupted(spark, d).write.json(path)
    stream = on.event_stream(spark, path, se.EPISODE + ", _corrupt string", fmt="json", files_per_batch=4)
    out = on.run_available(stream, "sink", on_batch=lambda folder: on.episode_sink(folder, "s"))
    return masked_candidates(spark, f"{out}/episodes/*", f"{out}/invalid/*")
