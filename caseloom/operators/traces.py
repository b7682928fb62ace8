"""Operators over agent traces in flat form: a step table and a candidate table.

``steps``: episode_id, step_index, code, error_type, error_message, tool_result, passes, failures, done, ...
``candidates``: episode_id, step_index, cand, code, counterfactual outcome, usage, scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import rnd
from caseloom.functions import records as rec
from caseloom.functions.text import DESCRIPTION_CALL, DOC_CALL, NOTE_CALL, TOKEN_ASSIGN, TOKEN_FIELD, action_activity, api_calls, call_app, implied_apps
from caseloom.operators import sequence as S
from caseloom.session import lookup_side

EPISODE, STEP = ["episode_id"], ["episode_id", "step_index"]
# Apps that do not count as productive work, outcome labels, start label.
META_APPS = ["api_docs", "supervisor"]
OUTCOME_OK, OUTCOME_FAIL, START = "outcome.success|ok", "outcome.failure|ok", "start.episode|ok"
BUILDER_VERSION = "2"


def group_key() -> Column:
    return F.coalesce("scenario_id", "task_id")


# ------------------------------------------------------------------ episodes as cases
def episode_events(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Event log of episodes: a start event, one event per step, an outcome event, with a monotone clock."""
    s = S.sequence(steps, {"_prev": S.lag("error_type")}, case=EPISODE, order=("step_index",))
    none = F.lit("none")
    mid = s.select(
        "episode_id", (F.col("step_index") + 1).cast("long").alias("event_idx"), F.col("step_us").alias("raw_us"),
        action_activity("code", F.col("error_type")).alias("activity"), F.coalesce("error_type", none).alias("ev_error_type"),
        F.least(F.size(api_calls("code")), F.lit(5)).cast("string").alias("ev_n_calls"), F.coalesce("_prev", none).alias("ev_prev_error"))
    lasts = steps.groupBy("episode_id").agg(F.max("step_index").alias("_n"), F.max_by("step_us", "step_index").alias("_us"), F.max_by(F.struct(F.col("error_type").alias("e")), "step_index").alias("_e"))
    e = episodes.join(lasts, "episode_id")
    start = e.select("episode_id", F.lit(0).cast("long").alias("event_idx"), F.col("started_us").alias("raw_us"), F.lit(START).alias("activity"),
                     none.alias("ev_error_type"), F.lit("0").alias("ev_n_calls"), none.alias("ev_prev_error"))
    outcome = F.when(F.coalesce("success", F.lit(False)), OUTCOME_OK).otherwise(OUTCOME_FAIL)
    end = e.select("episode_id", (F.col("_n") + 2).cast("long").alias("event_idx"), F.coalesce("ended_us", "_us").alias("raw_us"), outcome.alias("activity"),
                   none.alias("ev_error_type"), F.lit("0").alias("ev_n_calls"), F.coalesce(F.col("_e")["e"], none).alias("ev_prev_error"))
    ev = start.unionByName(mid).unionByName(end)
    ev = S.sequence(ev, {"us": S.running_max("raw_us")}, case=EPISODE, order=("event_idx",))
    return ev.withColumn("case_id", F.col("episode_id")).drop("raw_us")


# ------------------------------------------------------------------ training examples
def dense_reward(steps: DataFrame, initial: int = 0) -> DataFrame:
    """Change of the passed-check count step over step."""
    s = S.sequence(steps, {"_p": S.lag("passes")}, case=EPISODE, order=("step_index",))
    return s.withColumn("reward", (F.col("passes") - F.coalesce("_p", F.lit(initial))).cast("double")).drop("_p")


def example_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), 1, 16)


def step_context(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Steps with what the agent knew before acting: last observation, error, code, and the number of earlier errors."""
    err = F.col("error_type").isNotNull().cast("long")
    s = S.sequence(steps, {
        "_obs": S.lag("tool_result"), "last_error": S.lag("error_message"), "last_code": S.lag("code"),
        "n_prev_errors": S.running_sum(err, inclusive=False)}, case=EPISODE, order=("step_index",))
    e = episodes.select("episode_id", "instruction", "success", "schema_version")
    s = s.join(e, "episode_id")
    return s.withColumns({
        "last_observation": F.coalesce("_obs", "instruction", F.lit("")), "last_error": F.coalesce("last_error", F.lit("")), "last_code": F.coalesce("last_code", F.lit(""))}).drop("_obs")


_EXAMPLE = ["example_id", "group_id", "episode_id", "step_index", "candidate_index", "source", "code", "label_valid", "label_success", "label_progress", "label_regress",
            "instruction", "last_observation", "last_error", "last_code", "n_prev_errors", "schema_version", "builder_version"]


def _regress(gain: Column, done: Column, failures: Column) -> Column:
    """1 when checks were lost or a finished state still fails, 0 otherwise; null when the gain is not known."""
    early = F.coalesce(done, F.lit(False)) & (F.coalesce(failures, F.lit(0)) > 0)
    return F.when(gain.isNotNull(), ((gain < 0) | early).cast("int"))


def executed_examples(context: DataFrame) -> DataFrame:
    has_code = F.coalesce("code", F.lit("")) != ""
    c = context.withColumns({
        "example_id": example_id("episode_id", "step_index", "chosen_index"), "group_id": group_key(), "candidate_index": F.col("chosen_index"), "source": F.lit("executed"),
        "label_valid": (F.col("error_type").isNull() & has_code).cast("int"), "label_success": F.col("success").cast("int"),
        "label_progress": (F.col("reward") > 0).cast("int"), "label_regress": _regress(F.col("reward"), F.col("done"), F.col("failures")),
        "builder_version": F.lit(BUILDER_VERSION)})
    return c.select(*_EXAMPLE)


def counterfactual_examples(candidates: DataFrame, context: DataFrame) -> DataFrame:
    """Examples for recorded outcomes of candidates that were not executed."""
    ctx = context.select(*STEP, "chosen_index", "instruction", "last_observation", "last_error", "last_code", "n_prev_errors", "schema_version")
    c = candidates.where("has_cf").join(ctx, STEP).where(F.col("cand") != F.col("chosen_index"))
    delta, has_code = F.col("passes_after") - F.col("passes_before"), F.coalesce("code", F.lit("")) != ""
    c = c.withColumns({
        "example_id": example_id("episode_id", "step_index", "cand"), "group_id": group_key(), "candidate_index": F.col("cand"), "source": F.lit("counterfactual"),
        "label_valid": (F.col("cf_error").isNull() & has_code).cast("int"), "label_success": F.lit(None).cast("int"),
        "label_progress": (delta > 0).cast("int"), "label_regress": _regress(delta, F.col("cf_done"), F.col("failures_after")),
        "builder_version": F.lit(BUILDER_VERSION)})
    return c.select(*_EXAMPLE)


def dataset_stats(examples: DataFrame) -> DataFrame:
    return examples.agg(
        F.count(F.lit(1)).alias("n_examples"), F.count_distinct("episode_id").alias("n_episodes"), F.count_distinct("group_id").alias("n_groups"),
        rnd(F.avg("label_valid")).alias("pos_rate"), rnd(F.avg("label_progress")).alias("progress_rate"), rnd(F.avg("label_regress")).alias("regress_rate"),
        F.count_if(F.col("source") == "counterfactual").alias("n_counterfactual"))


# ------------------------------------------------------------------ cost and totals
def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``cost_usd``; a model without a price costs nothing.  ``prices``: model_id, p_in, p_out, p_write, p_read per million."""
    j = usage.join(lookup_side(prices, "prices"), "model_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cost = (F.col("input_tokens") * z("p_in") + F.col("output_tokens") * z("p_out") + F.col("cache_write_tokens") * z("p_write") + F.col("cache_read_tokens") * z("p_read")) / 1e6
    return j.withColumn("cost_usd", cost).drop("p_in", "p_out", "p_write", "p_read")


def totals(costed: DataFrame, steps: DataFrame) -> DataFrame:
    """Usage and validity rolled up candidate -> step -> episode."""
    use = costed.groupBy("episode_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"))
    st = steps.groupBy("episode_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("error_type").isNotNull()).alias("invalid_actions"))
    return st.join(use, "episode_id", "left")


# ------------------------------------------------------------------ gates and ranking
def schema_violations(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """(episode_id, step_index, cand, call): API calls absent from the published (app, api) pairs."""
    calls = candidates.select(*STEP, "cand", F.explode(api_calls("code")).alias("call"))
    known = published.select(F.concat_ws(".", "app", "api").alias("call")).distinct()
    return calls.join(lookup_side(known, "schema"), "call", "left_anti").select(*STEP, "cand", "call")


def productive(code) -> Column:
    return F.exists(api_calls(code), lambda c: ~call_app(c).isin(META_APPS))


def progress_so_far(steps: DataFrame) -> DataFrame:
    """Steps with ``worked``: an earlier error-free step made a productive call."""
    ok = (F.col("error_type").isNull() & productive("code")).cast("int")
    return S.sequence(steps, {"_w": S.running_max(ok, inclusive=False)}, case=EPISODE, order=("step_index",)).withColumn("worked", F.coalesce("_w", F.lit(0)) == 1).drop("_w")


def gate_flags(candidates: DataFrame, steps: DataFrame, published: DataFrame) -> DataFrame:
    """Candidates with ``unknown_call`` and ``premature`` flags and their union ``bad``."""
    bad_calls = schema_violations(candidates, published).select(*STEP, "cand").distinct().withColumn("unknown_call", F.lit(True))
    c = candidates.join(progress_so_far(steps).select(*STEP, "worked"), STEP)
    c = c.withColumn("premature", F.col("code").contains("complete_task") & ~F.col("worked"))
    c = c.join(bad_calls, [*STEP, "cand"], "left").withColumn("unknown_call", F.coalesce("unknown_call", F.lit(False)))
    return c.withColumn("bad", F.col("unknown_call") | F.col("premature"))


def score_modes() -> dict[str, Column]:
    v, s, p, r = (F.col(f"s_{x}") for x in ("valid", "success", "progress", "regress"))
    return {"valid": v, "success": F.coalesce(s, v), "product": v * F.coalesce(s, F.lit(1.0)),
            "progress": F.when(p.isNotNull(), v * (0.5 + p) * (1.0 - F.coalesce(r, F.lit(0.0)))).otherwise(v * F.coalesce(s, F.lit(1.0)))}


def choose(scored: DataFrame, score: str = "score", min_margin: float = 0.0) -> DataFrame:
    """Best candidate per step, earliest on ties; the first one is kept unless it is beaten by the margin."""
    first = F.struct((-F.col(score)).alias("s"), F.col("cand").alias("k"))
    g = scored.groupBy(*STEP).agg(F.min(first).alias("_b"), F.min_by(score, "cand").alias("_s0"), F.min("cand").alias("_k0"))
    pick = F.when(-F.col("_b.s") - F.col("_s0") < min_margin, F.col("_k0")).otherwise(F.col("_b.k"))
    return g.select(*STEP, pick.alias("chosen"), (pick != F.col("_k0")).alias("overrode_first"))


def gated_choice(flagged: DataFrame, score: str = "score") -> DataFrame:
    """Choose among candidates that pass the gates; with none or all passing, among all of them."""
    order = F.struct((-F.col(score)).alias("s"), F.col("cand").alias("k"))
    g = flagged.groupBy(*STEP).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.min(order).alias("_all"), F.min(F.when(~F.col("bad"), order)).alias("_ok"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("cand")))), ",").alias("rejected"))
    every = (F.col("n_bad") == 0) | (F.col("n_bad") == F.col("n"))
    return g.select(*STEP, F.when(every, F.col("_all.k")).otherwise(F.col("_ok.k")).alias("chosen"), "rejected", (F.col("n_bad") == F.col("n")).alias("fallback"))


def lookahead_score() -> Column:
    s = 2.0 * (F.col("passes_after") - F.col("passes_before")) - F.col("cf_error").isNotNull().cast("double")
    s = s - F.when(F.col("cf_done") & (F.col("failures_after") > 0), 3.0).otherwise(0.0)
    return F.when(F.col("has_cf"), s).otherwise(-10.0)


# ------------------------------------------------------------------ world state
FACT = ["episode_id", "step_index", "place", "kind", "key", "value"]
KINDS = ("app", "api", "signature", "auth", "entity", "error", "note")


def facts(steps: DataFrame, keep_errors: int = 120, keep_note: int = 160) -> DataFrame:
    """State changes of each step (``FACT``), numbered by ``place`` inside the step; a null value clears the key.

    Kinds: apps and calls seen, signatures and calls read from documentation, the variable of a login token, the summary of
    the last productive call's records, errors per call (cleared by a later result) and notes.
    """
    ok = F.col("error_type").isNull()
    calls = api_calls("code")
    world = F.filter(calls, lambda c: call_app(c) != "api_docs")
    useful = F.filter(calls, lambda c: ~call_app(c).isin(META_APPS))
    target = F.try_element_at(useful, F.lit(-1))
    found = lambda rule, i: F.regexp_extract_all("code", F.lit(rule), F.lit(i))
    one = lambda rule, i: F.when(F.col("code").rlike(rule) & ok, F.regexp_extract("code", rule, i))
    s = steps.where(F.col("code") != "").select(*STEP, "code", "error_type", "error_message", world.alias("world"), F.when(ok, target).alias("target"), F.when(ok & target.isNotNull(), F.col("tool_result")).alias("result"),
                                                F.when(one(DOC_CALL, 1).isNotNull(), F.concat(one(DOC_CALL, 1), F.lit("."), one(DOC_CALL, 2))).alias("documented"), one(DESCRIPTION_CALL, 1).alias("described"), "tool_result")
    s = s.withColumns({"entity": rec.record_summary("result"), "signature": F.when(F.col("documented").isNotNull(), rec.signature("tool_result")),
                       "listed": F.when(F.col("described").isNotNull(), rec.listed_names("tool_result"))})
    row = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.cast("string").alias("value"))
    empty = F.lit("")
    null = F.lit(None).cast("string")
    pairs = lambda rule: F.arrays_zip(found(rule, 1).alias("var"), found(rule, 2).alias("app"))
    tokens = F.when(F.size(found(TOKEN_FIELD, 1)) > 0, pairs(TOKEN_FIELD)).otherwise(pairs(TOKEN_ASSIGN))  # the token itself goes before any login
    notes = F.transform(found(NOTE_CALL, 2), lambda n: F.substring(F.trim(n), 1, keep_note))
    parts = [
        F.transform("world", lambda c: row("app", call_app(c), empty)),
        F.transform("world", lambda c: row("api", c, empty)),
        F.transform(F.coalesce("listed", F.array().cast("array<string>")), lambda n: row("api", F.concat("described", F.lit("."), n), empty)),
        F.when(F.col("signature").isNotNull(), F.array(row("signature", F.col("documented"), F.col("signature")))).otherwise(F.array()),
        F.when(~ok, F.transform("world", lambda c: row("error", c, F.substring("error_message", 1, keep_errors)))).otherwise(F.array()),
        F.when(ok, F.transform(tokens, lambda t: row("auth", t["app"], t["var"]))).otherwise(F.array()),
        F.transform(F.filter(notes, lambda n: n != ""), lambda n: row("note", n, empty)),
        F.when(F.col("entity").isNotNull(), F.array(row("entity", F.col("target"), F.to_json("entity")), row("error", F.col("target"), null))).otherwise(F.array()),
    ]
    return s.select(*STEP, F.posexplode(F.concat(*parts)).alias("place", "_f")).select(*STEP, "place", "_f.*")


def seed_facts(episodes: DataFrame, published: DataFrame) -> DataFrame:
    """What is known before the first step (step -1): apps that the task text implies, their published calls, and login signatures.

    ``episodes``: episode_id, task_instruction; ``published``: app, api, signature (null where no documentation is given).
    """
    known = lookup_side(published.select(F.col("app").alias("_app"), "api", "signature"), "published")
    implied = episodes.select("episode_id", F.explode(implied_apps("task_instruction")).alias("app")).join(known, F.col("app") == F.col("_app"))
    row = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.cast("string").alias("value"))
    call = F.concat_ws(".", "app", "api")
    login = F.when((F.col("api") == "login") & F.col("signature").isNotNull(), F.array(row("signature", call, F.col("signature")))).otherwise(F.array())
    rows = F.concat(F.array(row("app", F.col("app"), F.lit("")), row("api", call, F.lit(""))), login)
    return implied.select("episode_id", F.lit(-1).alias("step_index"), F.posexplode(rows).alias("place", "_f")).select(*STEP, "place", "_f.*").distinct()


def fact_order() -> Column:
    """Order in which facts of a key count: the latest wins, but a note keeps the place of its first occurrence."""
    back = F.when(F.col("kind") == "note", -1).otherwise(1)
    return F.struct((back * F.col("step_index")).alias("s"), (back * F.col("place")).alias("p"))


def newest_notes(state: DataFrame, max_notes: int = 12) -> DataFrame:
    """``state`` (with ``since`` and ``place``) with only the newest notes of each episode."""
    from pyspark.sql import Window as W

    newest = F.row_number().over(W.partitionBy("episode_id", "kind").orderBy(F.desc("since"), F.desc("place")))
    notes = state.where("kind = 'note'").withColumn("_r", newest).where(F.col("_r") <= max_notes).drop("_r")
    return state.where("kind <> 'note'").unionByName(notes)


def world_state(facts_: DataFrame, max_notes: int = 12) -> DataFrame:
    """Latest value per key at the end of each episode; cleared errors are gone, only the newest notes stay."""
    at = fact_order()
    g = facts_.groupBy("episode_id", "kind", "key").agg(F.max_by(F.struct(F.col("value").alias("v")), at).alias("_v"), F.max(at).alias("_at"))
    g = g.select("episode_id", "kind", "key", F.col("_v")["v"].alias("value"), F.abs("_at.s").alias("since"), F.abs("_at.p").alias("place"))
    return newest_notes(g.where(F.col("value").isNotNull()), max_notes)


def world_intervals(facts_: DataFrame, max_notes: int = 12) -> DataFrame:
    """(episode_id, kind, key, value, valid_from, valid_to): what holds after step ``valid_from`` and before the end of ``valid_to``.

    An interval ends where its key changes or is cleared, a note's where ``max_notes`` newer ones stand; ``valid_to`` is null
    while it holds.  Of several changes in one step the last by ``place`` counts.
    """
    rest = S.sequence(facts_.where("kind <> 'note'"), {"valid_to": S.lead("step_index")}, case=["episode_id", "kind", "key"], order=("step_index", "place"))
    firsts = facts_.where("kind = 'note'").groupBy("episode_id", "kind", "key").agg(F.min(F.struct("step_index", "place", "value")).alias("_f"))
    firsts = firsts.select("episode_id", "kind", "key", "_f.*")
    notes = S.sequence(firsts, {"valid_to": S.lead("step_index", max_notes)}, case=EPISODE, order=("step_index", "place"))
    both = rest.select(*FACT, "valid_to").unionByName(notes.select(*FACT, "valid_to")).withColumnRenamed("step_index", "valid_from")
    holds = F.col("value").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    return both.where(holds).select("episode_id", "kind", "key", "value", "valid_from", "valid_to")


def state_at(intervals: DataFrame, at: DataFrame) -> DataFrame:
    """The state after each step of ``at`` (episode_id, step_index): one row per key that holds there."""
    j = at.select(*STEP).join(intervals, "episode_id")
    return j.where((F.col("valid_from") <= F.col("step_index")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("step_index")))).drop("valid_from", "valid_to")


def state_sizes(intervals: DataFrame, steps: DataFrame) -> DataFrame:
    """Number of keys of each kind after every step, as running sums of starts and ends: no row per step and key."""
    ends = intervals.where(F.col("valid_to").isNotNull()).select("episode_id", F.col("valid_to").alias("step_index"), "kind", F.lit(-1).alias("d"))
    moves = intervals.select("episode_id", F.col("valid_from").alias("step_index"), "kind", F.lit(1).alias("d")).unionByName(ends)
    moves = moves.unionByName(steps.select(*STEP, F.lit(None).cast("string").alias("kind"), F.lit(0).alias("d")))
    per = moves.groupBy(*STEP).agg(F.max(F.col("kind").isNull().cast("int")).alias("_step"), *[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"_{k}") for k in KINDS])
    run = S.sequence(per, {f"n_{k}": S.running_sum(f"_{k}") for k in KINDS}, case=EPISODE, order=("step_index",))
    return run.where("_step = 1").select(*STEP, *[F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


# ------------------------------------------------------------------ run comparison
def run_summary(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per run: task and scenario completion, validity, length, time, cost, terminations, overrides."""
    over = steps.groupBy("episode_id").agg(F.count_if("overrode_first").alias("overrides"), F.count_if(F.col("error_type").isNotNull()).alias("invalid"))
    e = episodes.join(over, "episode_id", "left").fillna(0, ["overrides", "invalid"]).withColumn("ok", F.coalesce("success", F.lit(False)))
    scen = e.groupBy("run_id", group_key().alias("g")).agg(F.bool_and("ok").alias("all_ok")).groupBy("run_id").agg(rnd(F.avg(F.col("all_ok").cast("double"))).alias("sgc"))
    runs = e.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_episodes"), rnd(F.avg(F.col("ok").cast("double"))).alias("tgc"),
        rnd(F.sum("invalid") / F.greatest(F.sum("n_steps"), F.lit(1))).alias("invalid_rate"), rnd(F.sum("n_steps") / F.count(F.lit(1))).alias("mean_steps"),
        rnd(F.avg("wall_s")).alias("mean_wall_s"), rnd(F.avg("cost_usd")).alias("mean_cost_usd"),
        *[F.count_if(F.col("termination_reason") == t).alias(f"n_{t}") for t in ("completed", "max_steps", "error", "budget")],
        rnd(F.sum("overrides") / F.greatest(F.sum("n_steps"), F.lit(1))).alias("override_rate"))
    return runs.join(scen, "run_id")


def over_runs(summary: DataFrame, metrics: list[str]) -> DataFrame:
    long = summary.unpivot(["run_id"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    # the inputs carry six digits, so the spread is reported with four
    return long.groupBy("metric").agg(rnd(F.avg("value"), 4).alias("mean"), rnd(F.stddev_pop("value"), 4).alias("std"), F.count(F.lit(1)).alias("n_runs"))


def fatal_first_step(steps: DataFrame) -> DataFrame:
    """Episodes whose first step failed at the model for billing or authentication reasons."""
    # fixed values: words of such messages
    words = ["credit balance", "authentication", "invalid x-api-key", "permission"]
    m = F.lower("error_message")
    hit = m.contains(words[0])
    for w in words[1:]:
        hit = hit | m.contains(w)
    return steps.where((F.col("step_index") == 0) & (F.col("error_type") == "llm_error") & hit).select("episode_id")


