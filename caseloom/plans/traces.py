"""Agent-trace queries S5-S9, T1-T29, J5-J8, J12, J13, V19."""

from pyspark.sql import functions as F

from caseloom.functions import text as tx
from caseloom.functions.columns import hash_order, rnd
from caseloom.functions.entities import redact
from caseloom.operators import encode as en, metrics as me, reports as rp, splits as sp, traces as tc, transitions as tr, worldmodel as wm
from caseloom.plans import episodes as ep, modelsql as ms, sqltext as q
from caseloom.plans.registry import query
from caseloom.session import literal_table, lookup_side, scratch_path
from caseloom.sources import episodes as se
from caseloom.sources.tables import table

ST, CD, EPI = q.with_(ep.STEP_SQL), q.with_(ep.CAND_SQL), q.with_(ep.BASE_SQL, ep.EP_SQL)
SE_ = q.with_(ep.STEP_SQL, ep.EP_SQL)
API = r"apis\.([a-z_]+)\.([a-z_]+)\("
APP_L, API_L = f"regexp_extract_all(code, '{API}', 1)", f"regexp_extract_all(code, '{API}', 2)"
CALLS = f"list_transform(list_zip({APP_L}, {API_L}), lambda z: z[1] || '.' || z[2])"
ONE = "CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def corrupted(spark, d):
    """Documents with broken indexes, choices and versions by rule."""
    s = ep.steps(spark, d)
    bad = (hash_order("bad", "conv_id") % 9 == 0) & (F.col("step_index") == 0)
    gap = (hash_order("gap", "conv_id") % 11 == 0) & (F.col("step_index") > 0)
    s = s.withColumns({"order_index": F.col("step_index"), "chosen_index": F.when(bad, 7).otherwise(F.col("chosen_index")),
                       "step_index": F.when(gap, F.col("step_index") + 1).otherwise(F.col("step_index"))})
    return se.nest(s, ep.candidates(spark, d), ep.episodes(spark, d))


def documents(spark, d):
    return se.nest(ep.steps(spark, d), ep.candidates(spark, d), ep.episodes(spark, d))


ERRS = f"""er AS (SELECT ep.episode_id, run_id, array_to_string(list_filter([CASE WHEN {ep.hs('gap', 'conv_id')} % 11 = 0 AND n_steps > 1 THEN 'step_index' END, CASE WHEN {ep.hs('bad', 'conv_id')} % 9 = 0 AND fst THEN 'chosen_index' END,
 CASE WHEN schema_version = '0.9' THEN 'schema_version' END], lambda x: x IS NOT NULL), ',') AS errors FROM ep JOIN (SELECT episode_id, bool_or(step_index = 0) AS fst FROM eb GROUP BY 1) USING (episode_id))"""


@query("s5_read_episodes", SE_ + "SELECT st.episode_id, count(*) AS n_steps, 3 * count(*) AS n_candidates, any_value(ep.success) AS success FROM st JOIN ep USING (episode_id) GROUP BY 1")
def s5(spark, d):
    path = scratch_path(spark, "episodes")
    documents(spark, d).write.json(path)
    back = se.read_episodes(spark, [path])
    n = F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.size(s["candidates"]))
    return back.select("episode_id", F.size("steps").cast("long").alias("n_steps"), n.alias("n_candidates"), F.col("final_eval.success").alias("success"))


@query("s6_example_files", ST + f", g AS (SELECT gid, row_number() OVER (ORDER BY {q.hash60(0, 'gid')}, gid) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(scenario_id, task_id) AS gid FROM st)) SELECT CASE WHEN r < greatest(1, floor(n * 0.25::DOUBLE)) THEN 'heldout' ELSE 'train' END AS part, count(*) AS n FROM st JOIN g ON g.gid = coalesce(scenario_id, task_id) GROUP BY 1")
def s6(spark, d):
    ex = sp.split_groups(examples(spark, d)[0], "group_id")
    return spark.read.parquet(se.write_examples(ex)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("s7_dead_letters", EPI.rstrip() + ", " + ERRS + " SELECT CASE WHEN errors = '' THEN 'episodes' ELSE 'invalid' END AS sink, count(*) AS n FROM er GROUP BY 1")
def s7(spark, d):
    ok, bad = se.write_validated(corrupted(spark, d), scratch_path(spark, "sink"))
    a = se.read_episodes(spark, ok).select(F.lit("episodes").alias("sink"))
    b = se.read_episodes(spark, bad).select(F.lit("invalid").alias("sink"))
    return a.unionByName(b).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query("s8_content_store", CD + f", c AS (SELECT run_id, unnest({CALLS}) AS call FROM cd), d AS (SELECT run_id, split_part(call, '.', 1) AS app, '[' || string_agg(DISTINCT call, ',' ORDER BY call) || ']' AS doc FROM c GROUP BY ALL) SELECT DISTINCT sha256(doc) AS hash, doc FROM d")
def s8(spark, d):
    c = ep.candidates(spark, d).select("run_id", F.explode(tx.api_calls("code")).alias("call"))
    doc = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("call")), ","), F.lit("]"))
    return se.content_store(c.groupBy("run_id", tx.call_app(F.col("call"))).agg(doc.alias("doc")))


_RED = r"(?im)\b\w*(?:password|passwd|secret|api_key|apikey|access_token|auth_token|token|verification_code|otp)\w*\s*=\s*[\"''][^\"''\n]*(?:[\"'']|$)"
_RED1 = r"(?im)\b[\"'']?(?:password|passwd|secret|api_key|apikey|access_token|auth_token|token|verification_code|otp)[\"'']?\s*:\s*[\"''][^\"''\n]*(?:[\"'']|$)"
_RED3 = r"\beyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,})+\b"


def red_count(col):
    return f"(len(regexp_extract_all({col}, '{_RED1}')) + len(regexp_extract_all({col}, '{_RED}')) + len(regexp_extract_all({col}, '{_RED3}')))"


_STEP_ONLY = ep.STEP_SQL[ep.STEP_SQL.index("sp0 AS"):]
_SECRET = r"(?:password|access_token)=''([^'']*)''"
MASKED = (f"CASE WHEN regexp_matches(code, '{_SECRET}') THEN replace(code, '=''' || regexp_extract(code, '{_SECRET}', 1) || '''', "
          f"'=''<REDACTED:' || substr(sha256('s' || regexp_extract(code, '{_SECRET}', 1)), 1, 8) || '>''') ELSE code END")
# code stands in a document twice, as action and inside the raw reply
MASKED_SQL = (q.with_(ep.CAND_SQL, _STEP_ONLY, ep.EP_SQL, ERRS) + f", a AS (SELECT episode_id, 2 * sum({red_count('code')}) AS n FROM cd GROUP BY 1), b AS (SELECT episode_id, sum({red_count('observation')} + {red_count('tool_result')} "
              f"+ coalesce({red_count('error_message')}, 0)) AS n FROM st GROUP BY 1) SELECT cd.episode_id, cand, {MASKED} AS code, CASE WHEN errors = '' THEN 'episodes' ELSE 'invalid' END AS sink, "
              f"(a.n + b.n + {red_count('instruction')})::BIGINT AS n_redactions FROM cd JOIN er USING (episode_id) JOIN ep USING (episode_id) JOIN a USING (episode_id) JOIN b USING (episode_id)")


def masked_candidates(spark, ok, bad):
    """Code of all candidates as the sinks hold it, with the count of each document."""
    part = lambda path, name: spark.read.schema(se.EPISODE).json(path).withColumn("sink", F.lit(name))
    docs = part(ok, "episodes").unionByName(part(bad, "invalid"))
    counts = docs.select("episode_id", "sink", F.col("redaction.n_redactions").cast("long").alias("n_redactions"))
    return se.flatten_candidates(docs).select("episode_id", "cand", "code").join(counts, "episode_id")


@query("s7_masked_documents", MASKED_SQL)
def s7m(spark, d):
    return masked_candidates(spark, *se.write_validated(corrupted(spark, d), scratch_path(spark, "sink"), "s"))


_PRICES = "pz AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for m, a, b, c, e in ep.PRICES) + ") v(model_id, p_in, p_out, p_write, p_read))"
_COST = _PRICES + ", co AS (SELECT cd.*, (input_tokens * coalesce(p_in, 0) + output_tokens * coalesce(p_out, 0) + cache_write_tokens * coalesce(p_write, 0) + cache_read_tokens * coalesce(p_read, 0)) / 1e6 AS cost_usd FROM cd LEFT JOIN pz USING (model_id))"


def prices(spark):
    return literal_table(spark, ep.PRICES, "model_id string, p_in double, p_out double, p_write double, p_read double")


def costed(spark, d):
    return tc.token_cost(ep.candidates(spark, d), prices(spark))


@query("s9_manifest", q.with_(ep.CAND_SQL, ep.EP_SQL, ERRS, _COST) + f", u AS (SELECT episode_id, sum(cost_usd) AS cost, sum({red_count('code')}) AS nr FROM co GROUP BY 1) SELECT run_id, count(*) FILTER (errors = '') AS n_valid, count(*) FILTER (errors <> '') AS n_invalid, round(avg({ONE.format(chr(101)+'rrors = '+chr(39)*2)}), 6) AS validation_rate, round(sum(cost), 6) AS cost_usd, sum(nr)::BIGINT AS n_redactions FROM er JOIN u USING (episode_id) GROUP BY 1")
def s9(spark, d):
    errs = corrupted(spark, d).select("episode_id", "run_id", F.size(se.validation_errors()).alias("n_errors"))
    use = costed(spark, d).groupBy("episode_id").agg(F.sum("cost_usd").alias("cost_usd"), F.sum(redact("code", "s")["n"]).alias("n_redactions"))
    return se.manifest(errs.join(use, "episode_id", "left").fillna(0, ["cost_usd", "n_redactions"]))


@query("t1_flatten", ST + "SELECT episode_id, step_index, 3 AS n_candidates, code, error_type FROM st")
def t1(spark, d):
    return se.flatten_steps(documents(spark, d)).select("episode_id", "step_index", "n_candidates", "code", "error_type")


@query("t1_flatten_candidates", CD + "SELECT episode_id, step_index, cand, code, has_cf, cf_error, passes_after, input_tokens FROM cd")
def t1c(spark, d):
    return se.flatten_candidates(documents(spark, d)).select("episode_id", "step_index", "cand", "code", "has_cf", "cf_error", "passes_after", "input_tokens")


@query("t2_validation", EPI.rstrip() + ", " + ERRS + " SELECT episode_id, errors FROM er")
def t2(spark, d):
    return corrupted(spark, d).select("episode_id", F.array_join(se.validation_errors(), ",").alias("errors"))


@query("t29_validation_rate", EPI.rstrip() + ", " + ERRS + f" SELECT count(*) AS n, round(avg({ONE.format(chr(101)+'rrors = '+chr(39)*2)}), 6) AS rate FROM er")
def t29(spark, d):
    ok = (F.size(se.validation_errors()) == 0).cast("double")
    return corrupted(spark, d).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(ok)).alias("rate"))


@query("t3_redaction_documents", f"SELECT doc_id, {red_count('text')}::BIGINT AS n FROM documents")
def t3(spark, d):
    return table(spark, d, "documents").select("doc_id", redact("text", "s")["n"].alias("n"))


@query("t3_redaction_traces", CD + f"SELECT episode_id, step_index, cand, {red_count('action_raw_')}::BIGINT AS n, 0 AS leaked FROM (SELECT *, CASE WHEN code = '' THEN 'no plan' ELSE 'Thinking.' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' END AS action_raw_ FROM cd)")
def t3t(spark, d):
    r = ep.candidates(spark, d).withColumn("r", redact("action_raw", "s"))
    leak = F.col("r.text").rlike(r"(?i)(password|token)\w*\s*=\s*'(?!<REDACTED:)").cast("int")
    return r.select("episode_id", "step_index", "cand", F.col("r.n").alias("n"), leak.alias("leaked"))


@query("t4_token_cost", q.with_(ep.CAND_SQL, _COST) + "SELECT episode_id, step_index, cand, round(cost_usd, 9) AS cost_usd FROM co")
def t4(spark, d):
    return costed(spark, d).select("episode_id", "step_index", "cand", rnd("cost_usd", 9).alias("cost_usd"))


@query("j12_price_default", q.with_(ep.CAND_SQL, _PRICES) + "SELECT model_id, count(*) AS n, coalesce(max(p_in), 0) AS p_in FROM cd LEFT JOIN pz USING (model_id) GROUP BY 1")
def j12(spark, d):
    return ep.candidates(spark, d).join(lookup_side(prices(spark), "prices"), "model_id", "left").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("p_in"), F.lit(0.0)).alias("p_in"))


FULL = q.with_(ep.CAND_SQL, _STEP_ONLY, ep.EP_SQL)


@query("t5_totals", q.with_(ep.CAND_SQL, _STEP_ONLY, ep.EP_SQL, _COST) + """, u AS (SELECT episode_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 9) AS cost_usd FROM co GROUP BY 1),
s AS (SELECT episode_id, count(*) AS steps, count(*) FILTER (error_type IS NOT NULL) AS invalid_actions FROM st GROUP BY 1) SELECT s.*, u.* EXCLUDE (episode_id), stored_steps = steps AS agrees FROM s JOIN u USING (episode_id) JOIN ep USING (episode_id)""")
def t5(spark, d):
    t = tc.totals(costed(spark, d), ep.steps(spark, d)).withColumn("cost_usd", rnd("cost_usd", 9))
    return t.join(ep.episodes(spark, d).select("episode_id", "stored_steps"), "episode_id").withColumn("agrees", F.col("stored_steps") == F.col("steps")).drop("stored_steps")


@query("t6_code_block", CD + r""", a AS (SELECT episode_id, step_index, cand, CASE WHEN code = '' THEN 'no plan' WHEN cand = 1 AND code LIKE 'x%' THEN '```python' || chr(10) || code WHEN cand = 2 AND code LIKE 'tok%' THEN code ELSE 'Thinking.' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' END AS raw FROM cd),
b AS (SELECT *, regexp_extract_all(raw, '(?s)```(?:python)?\s*\n(.*?)```', 1) AS blocks, trim(raw, ' ' || chr(10)) AS t FROM a)
SELECT episode_id, step_index, cand, CASE WHEN len(blocks) > 0 THEN trim(blocks[-1], ' ' || chr(10)) WHEN (length(t) - length(replace(t, '```', ''))) = 3 THEN NULL WHEN contains(t, 'apis.') OR starts_with(t, 'print(') THEN t END AS code,
 CASE WHEN len(blocks) > 0 THEN NULL WHEN (length(t) - length(replace(t, '```', ''))) = 3 THEN 'truncated_code_block' WHEN contains(t, 'apis.') OR starts_with(t, 'print(') THEN 'no_fence' ELSE 'no_code_block' END AS parse_error FROM b""")
def t6(spark, d):
    c = ep.candidates(spark, d)
    raw = (F.when((F.col("cand") == 1) & F.col("code").startswith("x"), F.concat(F.lit("```python\n"), F.col("code")))
           .when((F.col("cand") == 2) & F.col("code").startswith("tok"), F.col("code")).otherwise(F.col("action_raw")))
    return c.withColumn("raw", raw).withColumn("b", tx.code_block("raw", strict=True)).select("episode_id", "step_index", "cand", "b.code", "b.parse_error")


@query("t7_api_tokens", CD + f"SELECT episode_id, step_index, cand, array_to_string(list_concat({CALLS}, list_transform({APP_L}, lambda a: 'app:' || a)), ' ') AS tokens FROM cd")
def t7(spark, d):
    return ep.candidates(spark, d).select("episode_id", "step_index", "cand", F.array_join(tx.api_tokens("code"), " ").alias("tokens"))


@query("t8_error_class", ST + """SELECT episode_id, step_index, CASE WHEN starts_with(tool_result, 'Execution failed') THEN CASE WHEN contains(tool_result, 'Syntax error') THEN 'syntax_error' WHEN contains(tool_result, 'Response status code is') THEN 'api_error' WHEN contains(tool_result, 'Maximum number of executions') THEN 'budget_error' ELSE 'runtime_error' END END AS type,
 CASE WHEN starts_with(tool_result, 'Execution failed') THEN substr(list_filter(string_split(trim(tool_result, ' ' || chr(10)), chr(10)), lambda l: trim(l) <> '')[-1], 1, 500) END AS message FROM st""")
def t8(spark, d):
    e = tx.classify_error("tool_result")
    return ep.steps(spark, d).select("episode_id", "step_index", e["type"].alias("type"), e["message"].alias("message"))


BASE_ACT = f"CASE WHEN len({CALLS}) > 0 THEN {CALLS}[1] WHEN code <> '' THEN 'python.no_api' ELSE 'none.no_code' END"
query("t9_step_activity", ST + f"SELECT episode_id, step_index, {BASE_ACT} || CASE WHEN error_type IS NULL THEN '|ok' ELSE '|err' END AS activity FROM st")(
    lambda s, d: ep.steps(s, d).select("episode_id", "step_index", tx.action_activity("code", F.col("error_type")).alias("activity")))

G_RAW = ep.STEP_SQL + ", " + ep.EP_SQL + f""", ge AS (SELECT episode_id, 0 AS event_idx, started_us AS u, 'start.episode|ok' AS activity, 'none' AS ev_error_type, '0' AS ev_n_calls, 'none' AS ev_prev_error FROM ep
 UNION ALL SELECT episode_id, step_index + 1, step_us, {BASE_ACT} || CASE WHEN error_type IS NULL THEN '|ok' ELSE '|err' END, coalesce(error_type, 'none'), CAST(least(len({APP_L}), 5) AS VARCHAR), coalesce(lag(error_type) OVER (PARTITION BY episode_id ORDER BY step_index), 'none') FROM st
 UNION ALL SELECT ep.episode_id, l.n + 2, coalesce(ended_us, l.us), CASE WHEN coalesce(success, false) THEN 'outcome.success|ok' ELSE 'outcome.failure|ok' END, 'none', '0', coalesce(l.e, 'none') FROM ep JOIN (SELECT episode_id, max(step_index) AS n, arg_max(step_us, step_index) AS us, (arg_max([error_type], step_index))[1] AS e FROM st GROUP BY 1) l USING (episode_id)),
g_raw AS MATERIALIZED (SELECT *, episode_id AS case_id, max(u) OVER (PARTITION BY episode_id ORDER BY event_idx) AS us FROM ge)"""
q.RAW["g"], q.TERMINAL["g"] = G_RAW, "true"


def trace_events(spark, d):
    return tc.episode_events(ep.steps(spark, d), ep.episodes(spark, d))


query("t10_episode_cases", q.with_(G_RAW) + "SELECT episode_id, event_idx, activity, us, ev_error_type, ev_n_calls, ev_prev_error FROM g_raw")(
    lambda s, d: trace_events(s, d).select("episode_id", "event_idx", "activity", "us", "ev_error_type", "ev_n_calls", "ev_prev_error"))


def examples(spark, d):
    s = tc.dense_reward(ep.steps(spark, d))
    ctx = tc.step_context(s, ep.episodes(spark, d))
    return tc.executed_examples(ctx), tc.counterfactual_examples(ep.candidates(spark, d), ctx)


_CTX = """, rw AS (SELECT *, passes - coalesce(lag(passes) OVER w, 0) AS reward, lag(tool_result) OVER w AS po, lag(error_message) OVER w AS pe, lag(code) OVER w AS pc, coalesce(sum(CASE WHEN error_type IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS npe FROM st WINDOW w AS (PARTITION BY episode_id ORDER BY step_index)),
cx1 AS (SELECT rw.*, instruction, success, coalesce(po, instruction, '') AS last_observation, coalesce(pe, '') AS last_error, coalesce(pc, '') AS last_code FROM rw JOIN ep USING (episode_id)),
ex1 AS (SELECT substr(sha256(episode_id || ':' || step_index || ':' || chosen_index), 1, 16) AS example_id, coalesce(scenario_id, task_id) AS group_id, episode_id, step_index, chosen_index AS candidate_index, 'executed' AS source, code, CASE WHEN error_type IS NULL AND code <> '' THEN 1 ELSE 0 END AS label_valid,
 CASE WHEN success THEN 1 WHEN NOT success THEN 0 END AS label_success, CASE WHEN reward > 0 THEN 1 ELSE 0 END AS label_progress, CASE WHEN reward < 0 OR (done AND failures > 0) THEN 1 ELSE 0 END AS label_regress, last_observation, last_error, last_code, npe AS n_prev_errors FROM cx1) """
_EXC = ["example_id", "group_id", "episode_id", "step_index", "candidate_index", "source", "code", "label_valid", "label_success", "label_progress", "label_regress", "last_observation", "last_error", "last_code", "n_prev_errors"]
_EX2 = """, ex2 AS (SELECT substr(sha256(cd.episode_id || ':' || cd.step_index || ':' || cand), 1, 16) AS example_id, coalesce(cd.scenario_id, cd.task_id) AS group_id, cd.episode_id, cd.step_index, cand AS candidate_index, 'counterfactual' AS source, cd.code, CASE WHEN cf_error IS NULL AND cd.code <> '' THEN 1 ELSE 0 END AS label_valid,
 CAST(NULL AS INTEGER) AS label_success, CASE WHEN passes_after > passes_before THEN 1 ELSE 0 END AS label_progress, CASE WHEN passes_after < passes_before OR (cf_done AND failures_after > 0) THEN 1 ELSE 0 END AS label_regress, last_observation, last_error, last_code, npe AS n_prev_errors
 FROM cd JOIN cx1 ON cx1.episode_id = cd.episode_id AND cx1.step_index = cd.step_index WHERE has_cf AND cand <> chosen_index) """
query("t11_executed_examples", SE_.rstrip() + _CTX + "SELECT * FROM ex1")(lambda s, d: examples(s, d)[0].select(*_EXC))
query("t12_counterfactual_examples", FULL.rstrip() + _CTX + _EX2 + "SELECT * FROM ex2")(lambda s, d: examples(s, d)[1].select(*_EXC))
query("t13_example_ids", CD + "SELECT substr(sha256(episode_id || ':' || step_index || ':' || cand), 1, 16) AS example_id, episode_id, step_index, cand AS candidate_index, '2' AS builder_version FROM cd")(
    lambda s, d: ep.candidates(s, d).select(tc.example_id("episode_id", "step_index", "cand").alias("example_id"), "episode_id", "step_index", F.col("cand").alias("candidate_index"), F.lit("2").alias("builder_version")))
query("t14_dataset_stats", FULL.rstrip() + _CTX + _EX2 + """, x AS (SELECT * FROM ex1 UNION ALL SELECT * FROM ex2) SELECT count(*) AS n_examples, count(DISTINCT episode_id) AS n_episodes, count(DISTINCT group_id) AS n_groups, round(avg(label_valid), 6) AS pos_rate, round(avg(label_progress), 6) AS progress_rate, round(avg(label_regress), 6) AS regress_rate, count(*) FILTER (source = 'counterfactual') AS n_counterfactual FROM x""")(
    lambda s, d: tc.dataset_stats(rp.add_sources(list(examples(s, d)))))
query("t15_dense_reward", ST + "SELECT episode_id, step_index, CAST(passes - coalesce(lag(passes) OVER (PARTITION BY episode_id ORDER BY step_index), 0) AS DOUBLE) AS reward FROM st")(
    lambda s, d: tc.dense_reward(ep.steps(s, d)).select("episode_id", "step_index", "reward"))
query("j5_group_hygiene", ST + f", g AS (SELECT gid, row_number() OVER (ORDER BY {q.hash60(0, 'gid')}, gid) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(scenario_id, task_id) AS gid FROM st)) SELECT count(*) AS n_train FROM st ANTI JOIN (SELECT * FROM g WHERE r < greatest(1, floor(n * 0.25::DOUBLE))) h ON h.gid = coalesce(scenario_id, task_id)")(
    lambda s, d: sp.split_groups(examples(s, d)[0], "group_id").where("part = 'train'").agg(F.count(F.lit(1)).alias("n_train")))
query("j6_scenario_key", EPI + "SELECT episode_id, coalesce(scenario_id, task_id) AS group_id FROM ep")(
    lambda s, d: ep.episodes(s, d).select("episode_id", tc.group_key().alias("group_id")))

# ------------------------------------------------------------------ gates and ranking
_MODES = {"valid": "s_valid", "success": "s_success", "product": "s_valid * s_success", "progress": "s_valid * (0.5::DOUBLE + s_progress) * (1 - s_regress)"}
query("t18_score_modes", CD + "SELECT episode_id, step_index, cand, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _MODES.items()) + " FROM cd")(
    lambda s, d: ep.candidates(s, d).select("episode_id", "step_index", "cand", *[rnd(v).alias(k) for k, v in tc.score_modes().items()]))


def scored(spark, d, mode="progress"):
    return ep.candidates(spark, d).withColumn("score", F.round(tc.score_modes()[mode], 9))


query("t19_choice", CD + f""", x AS (SELECT episode_id, step_index, cand, round({_MODES['progress']}, 9) AS s FROM cd), b AS (SELECT episode_id, step_index, arg_min(cand, (-s, cand)) AS bk, max(s) AS bs, arg_min(s, cand) AS s0 FROM x GROUP BY ALL)
SELECT episode_id, step_index, CASE WHEN bs - s0 < 0.1::DOUBLE THEN 0 ELSE bk END AS chosen, (CASE WHEN bs - s0 < 0.1::DOUBLE THEN 0 ELSE bk END) <> 0 AS overrode_first FROM b""")(
    lambda s, d: tc.choose(scored(s, d), min_margin=0.1))


def published(spark, d):
    """Published schema: the calls of the first candidate of first turns."""
    c = ep.candidates(spark, d).where((F.col("turn") == 0) & (F.col("cand") == 0)).select(F.explode(tx.api_calls("code")).alias("c"))
    return c.select(tx.call_app(F.col("c")).alias("app"), F.substring_index("c", ".", -1).alias("api")).distinct()


_PUB = f", pb AS (SELECT DISTINCT unnest({CALLS}) AS call FROM cd WHERE turn = 0 AND cand = 0), cl AS (SELECT episode_id, step_index, cand, unnest({CALLS}) AS call FROM cd), vi AS (SELECT * FROM cl ANTI JOIN pb USING (call)) "
query("t20_schema_gate", CD.rstrip() + _PUB + "SELECT episode_id, step_index, cand, call FROM vi")(
    lambda s, d: tc.schema_violations(ep.candidates(s, d), published(s, d)))
query("j8_schema_check", CD.rstrip() + _PUB + "SELECT call, count(*) AS n FROM vi GROUP BY 1")(
    lambda s, d: tc.schema_violations(ep.candidates(s, d), published(s, d)).groupBy("call").agg(F.count(F.lit(1)).alias("n")))
_PROD = f"len(list_filter({APP_L}, lambda a: a NOT IN ('api_docs', 'supervisor'))) > 0"
_FLAG = _PUB + f""", wk AS (SELECT episode_id, step_index, coalesce(max(CASE WHEN error_type IS NULL AND {_PROD} THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS worked FROM st),
fl AS (SELECT cd.*, contains(code, 'complete_task') AND NOT worked AS premature, (episode_id, step_index, cand) IN (SELECT (episode_id, step_index, cand) FROM vi) AS unknown_call FROM cd JOIN wk USING (episode_id, step_index)) """
query("t21_premature_gate", FULL.rstrip() + _FLAG + "SELECT episode_id, step_index, cand, premature, unknown_call FROM fl")(
    lambda s, d: tc.gate_flags(ep.candidates(s, d), ep.steps(s, d), published(s, d)).select("episode_id", "step_index", "cand", "premature", "unknown_call"))


@query("t22_gated_choice", FULL.rstrip() + _FLAG + f""", x AS (SELECT *, premature OR unknown_call AS bad, round({_MODES['progress']}, 9) AS s FROM fl), g AS (SELECT episode_id, step_index, count(*) AS n, count(*) FILTER (bad) AS nb, arg_min(cand, (-s, cand)) AS ka, arg_min(cand, (-s, cand)) FILTER (NOT bad) AS ko, coalesce(string_agg(cand, ',' ORDER BY cand) FILTER (bad), '') AS rejected FROM x GROUP BY ALL)
SELECT episode_id, step_index, CASE WHEN nb = 0 OR nb = n THEN ka ELSE ko END AS chosen, rejected, nb = n AS fallback FROM g""")
def t22(spark, d):
    return tc.gated_choice(tc.gate_flags(scored(spark, d), ep.steps(spark, d), published(spark, d)))


_LOOK = "CASE WHEN has_cf THEN 2.0::DOUBLE * (passes_after - passes_before) - CASE WHEN cf_error IS NOT NULL THEN 1 ELSE 0 END - CASE WHEN cf_done AND failures_after > 0 THEN 3 ELSE 0 END ELSE -10 END"
query("t23_lookahead", CD + f", x AS (SELECT episode_id, step_index, cand, CAST({_LOOK} AS DOUBLE) AS s FROM cd) SELECT episode_id, step_index, arg_min(cand, (-s, cand)) AS chosen, arg_min(cand, (-s, cand)) <> 0 AS overrode_first FROM x GROUP BY ALL")(
    lambda s, d: tc.choose(ep.candidates(s, d).withColumn("score", tc.lookahead_score())))

# ------------------------------------------------------------------ world model on traces
_GS = f"""g_gr AS (SELECT gid, row_number() OVER (ORDER BY {q.hash60(0, 'gid')}, gid) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(scenario_id, task_id) AS gid FROM ep)),
g_split AS (SELECT episode_id AS case_id, CASE WHEN r < greatest(1, floor(n * 0.25::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ep JOIN g_gr ON g_gr.gid = coalesce(scenario_id, task_id))"""
GM = q.with_(ms.encoded("g").replace(q.split_cte("g", 0), _GS), ms.fitted())


def trace_prepared(spark, d):
    e = sp.split_groups(ep.episodes(spark, d).withColumn("group_id", tc.group_key()), "group_id")
    split = e.select(F.col("episode_id").alias("case_id"), F.when(F.col("part") == "heldout", "test").otherwise("train").alias("split"))
    return en.prepare(trace_events(spark, d), wm.AGENT, split, assume_complete=True)


@query("t24_world_model", GM + ", " + ms.best_context("act >= 0") + f""", cb AS (SELECT cd0.episode_id, cd0.step_index, cd0.cand, {BASE_ACT} AS base FROM (SELECT e2.*, cand, {ep._code_sql('cand')} AS code FROM eb e2 CROSS JOIN (SELECT unnest([0, 1, 2]) AS cand)) cd0),
jo AS (SELECT cb.*, bc.k, bc.ctx, v1.id AS i1, v2.id AS i2 FROM cb JOIN bc ON bc.case_id = cb.episode_id AND bc.event_idx = cb.step_index LEFT JOIN v v1 ON v1.value = base || '|ok' LEFT JOIN v v2 ON v2.value = base || '|err'),
px AS (SELECT jo.*, coalesce(p1.p, 0) AS po, coalesce(p2.p, 0) AS pe, pu.p AS pu FROM jo LEFT JOIN pr p1 ON p1.k = jo.k AND p1.ctx = jo.ctx AND p1.cls = i1 LEFT JOIN pr p2 ON p2.k = jo.k AND p2.ctx = jo.ctx AND p2.cls = i2 JOIN pr pu ON pu.k = jo.k AND pu.ctx = jo.ctx AND pu.cls = 1)
SELECT episode_id, step_index, cand, round(CASE WHEN i1 IS NULL AND i2 IS NULL THEN 0.5::DOUBLE ELSE (po + 1e-6) / (po + pe + 2e-6) END, 6) AS valid, round(CASE WHEN i1 IS NULL AND i2 IS NULL THEN pu ELSE po + pe END, 6) AS plausible FROM px""")
def t24(spark, d):
    p = trace_prepared(spark, d)
    out = wm.candidate_scores(p, tr.fit_prepared(p), ep.candidates(spark, d))
    return out.select("episode_id", "step_index", "cand", rnd("valid").alias("valid"), rnd("plausible").alias("plausible"))


@query("t24_success_rollout")
def t24s(spark, d):
    p = trace_prepared(spark, d)
    m = tr.fit_prepared(p)
    out = wm.success_scores(p, m, ep.candidates(spark, d), n=4, max_len=10)
    return out.select("episode_id", "step_index", "cand", rnd("success").alias("success"), rnd("score").alias("score"))


@query("v19_trace_report", GM + ", " + ms.scored("split = 'test' AND pos < n - 1").replace("bc.case_id, bc.pos, bc.y_id", "bc.case_id, bc.pos, bc.y_id") + f""", yv AS (SELECT s.*, v.value, split_part(v.value, '|', 1) AS base FROM s JOIN v ON v.id = s.y_id),
pq AS (SELECT yv.case_id, yv.pos, any_value(yv.value LIKE '%|err') AS y, coalesce(max(CASE WHEN pd.cls = coalesce(vo.id, 1) THEN p END), 0) AS po, coalesce(max(CASE WHEN pd.cls = coalesce(ve.id, 1) THEN p END), 0) AS pe FROM yv LEFT JOIN v vo ON vo.value = base || '|ok' LEFT JOIN v ve ON ve.value = base || '|err' JOIN pd ON pd.case_id = yv.case_id AND pd.pos = yv.pos WHERE NOT starts_with(base, 'outcome.') GROUP BY ALL),
sc AS (SELECT 'validity' AS what, CASE WHEN y THEN 1 ELSE 0 END AS y, round(pe / (po + pe + 1e-9), 9) AS p FROM pq
 UNION ALL SELECT 'outcome', CASE WHEN e.last_act = 'outcome.success|ok' THEN 1 ELSE 0 END, round(pd.p, 9) FROM pd JOIN e ON e.case_id = pd.case_id AND e.pos = pd.pos JOIN v ON v.id = pd.cls AND v.value = 'outcome.success|ok' WHERE e.pos = e.n - 2)
SELECT what, (SELECT round(avg({ONE.format('pred = y_id')}), 6) FROM s) AS next_top1, (SELECT count(*) FROM s) AS n_steps, count(*) AS n, (SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6) FROM sc a JOIN sc b ON a.what = b.what AND a.y = 1 AND b.y = 0 WHERE a.what = sc.what) AS auroc FROM sc GROUP BY what""")
def v19(spark, d):
    p = trace_prepared(spark, d)
    return wm.report(p, tr.fit_prepared(p))


# ------------------------------------------------------------------ world state, summaries
_WS = f""", w0 AS (SELECT episode_id, step_index, code, error_type, error_message, tool_result, list_filter({CALLS}, lambda c: NOT starts_with(c, 'api_docs.')) AS world, list_filter({CALLS}, lambda c: NOT starts_with(c, 'api_docs.') AND NOT starts_with(c, 'supervisor.')) AS useful FROM st WHERE code <> ''),
fa AS (SELECT episode_id, step_index, 'app' AS kind, split_part(unnest(world), '.', 1) AS key, '' AS value FROM w0 UNION ALL SELECT episode_id, step_index, 'api', unnest(world), '' FROM w0
 UNION ALL SELECT episode_id, step_index, 'error', unnest(world), substr(error_message, 1, 120) FROM w0 WHERE error_type IS NOT NULL
 UNION ALL SELECT episode_id, step_index, 'auth', regexp_extract(code, 'tok = apis\\.([a-z_]+)\\.login', 1), 'tok' FROM w0 WHERE error_type IS NULL AND starts_with(code, 'tok = ')
 UNION ALL SELECT episode_id, step_index, 'note', regexp_extract(code, 'note\\("(.*)"\\)', 1), '' FROM w0 WHERE contains(code, 'note("')
 UNION ALL SELECT episode_id, step_index, 'error', useful[-1], NULL FROM w0 WHERE error_type IS NULL AND starts_with(tool_result, '[') AND len(useful) > 0
 UNION ALL SELECT episode_id, step_index, 'entity', useful[-1], '{{"count":' || json_array_length(tool_result) || ',"id_field":"' || split_part(useful[-1], '.', 1) || '_id","first_ids":[' || array_to_string(list_transform(range(json_array_length(tool_result)::BIGINT), lambda i: '"3"'), ',') || '],"keys":["' || split_part(useful[-1], '.', 1) || '_id","title"]}}' FROM w0 WHERE error_type IS NULL AND starts_with(tool_result, '[') AND len(useful) > 0),
wl AS (SELECT episode_id, kind, key, (arg_max([value], CASE WHEN kind = 'note' THEN -step_index ELSE step_index END))[1] AS value FROM fa GROUP BY ALL) """
query("t25_world_state", ST.rstrip() + _WS + "SELECT episode_id, kind, key, value FROM wl WHERE value IS NOT NULL")(
    lambda s, d: tc.world_state(tc.facts(ep.steps(s, d))).select("episode_id", "kind", "key", "value"))
query("t25_state_per_step", ST.rstrip() + _WS + ", wp AS (SELECT st.episode_id, st.step_index, kind, key, (arg_max([value], CASE WHEN kind = 'note' THEN -fa.step_index ELSE fa.step_index END))[1] AS value FROM st LEFT JOIN fa ON fa.episode_id = st.episode_id AND fa.step_index <= st.step_index GROUP BY ALL) SELECT episode_id, step_index, "
      + ", ".join(f"count(*) FILTER (kind = '{k}' AND value IS NOT NULL) AS n_{k}" for k in tc.KINDS if k != "note") + ", least(count(*) FILTER (kind = 'note'), 12) AS n_note FROM wp GROUP BY 1, 2")(
    lambda s, d: tc.state_sizes(tc.world_intervals(tc.facts(ep.steps(s, d))), ep.steps(s, d)))
query("t25_state_at_last_step", ST.rstrip() + _WS + "SELECT episode_id, kind, key, value FROM wl WHERE value IS NOT NULL")(
    lambda s, d: tc.state_at(tc.world_intervals(tc.facts(ep.steps(s, d))), ep.steps(s, d).groupBy("episode_id").agg(F.max("step_index").alias("step_index"))).select("episode_id", "kind", "key", "value"))
_TE = "coalesce(success, false)"
_SUM = f""", u AS (SELECT episode_id, sum(cost_usd) AS cost FROM co GROUP BY 1), v0 AS (SELECT episode_id, count(*) FILTER (overrode_first) AS ov, count(*) FILTER (error_type IS NOT NULL) AS iv FROM st GROUP BY 1),
j AS (SELECT ep.*, {_TE} AS ok, cost, ov, iv FROM ep JOIN u USING (episode_id) JOIN v0 USING (episode_id)),
sg AS (SELECT run_id, avg({ONE.format('a')}) AS sgc FROM (SELECT run_id, coalesce(scenario_id, task_id) AS g, bool_and(ok) AS a FROM j GROUP BY ALL) GROUP BY 1),
rs AS (SELECT run_id, count(*) AS n_episodes, round(avg({ONE.format('ok')}), 6) AS tgc, round(any_value(sgc), 6) AS sgc, round(sum(iv) / sum(n_steps), 6) AS invalid_rate, round(sum(n_steps) / count(*), 6) AS mean_steps, round(avg(wall_s), 6) AS mean_wall_s, round(avg(cost), 6) AS mean_cost_usd,
 count(*) FILTER (termination_reason = 'completed') AS n_completed, count(*) FILTER (termination_reason = 'max_steps') AS n_max_steps, count(*) FILTER (termination_reason = 'error') AS n_error, count(*) FILTER (termination_reason = 'budget') AS n_budget, round(sum(ov) / sum(n_steps), 6) AS override_rate FROM j JOIN sg USING (run_id) GROUP BY run_id) """
RUNS = q.with_(ep.CAND_SQL, _STEP_ONLY, ep.EP_SQL, _COST).rstrip() + _SUM


def runs(spark, d):
    cost = costed(spark, d).groupBy("episode_id").agg(F.sum("cost_usd").alias("cost_usd"))
    return tc.run_summary(ep.episodes(spark, d).join(cost, "episode_id"), ep.steps(spark, d))


_MET = ["tgc", "sgc", "invalid_rate", "mean_steps", "mean_wall_s", "mean_cost_usd", "override_rate"]
_UNP = "(UNPIVOT (SELECT run_id, " + ", ".join(f"{m}::DOUBLE AS {m}" for m in _MET) + " FROM rs) ON " + ", ".join(_MET) + " INTO NAME metric VALUE v)"
query("t26_run_summary", RUNS + "SELECT * FROM rs")(runs)
query("t26_over_runs", RUNS + f"SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, count(*) AS n_runs FROM {_UNP} GROUP BY 1")(
    lambda s, d: tc.over_runs(runs(s, d), _MET))


@query("t27_run_delta", RUNS + f"SELECT a.metric, round(a.v, 6) AS x, round(b.v, 6) AS y, CASE WHEN a.v <> 0 THEN round((b.v - a.v) / abs(a.v), 6) END AS change FROM {_UNP} a JOIN {_UNP} b ON a.metric = b.metric AND a.run_id = 'r0' AND b.run_id = 'r1'")
def t27(spark, d):
    long = runs(spark, d).unpivot(["run_id"], [F.col(m).cast("double").alias(m) for m in _MET], "metric", "value")
    return rp.relative_change(long.where("run_id = 'r0'"), long.where("run_id = 'r1'"), ["metric"])


query("t28_fatal_episodes", ST + "SELECT episode_id FROM st WHERE step_index = 0 AND error_type = 'llm_error' AND contains(lower(error_message), 'credit balance')")(
    lambda s, d: tc.fatal_first_step(ep.steps(s, d)))

_KW = "CASE " + " ".join(f"WHEN app = '{a}' THEN " + "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + ")" for a, ks in tx.APP_KEYWORDS.items()) + " END"
query("j13_implied_apps", "SELECT doc_id, app FROM (SELECT doc_id, text, unnest([" + ", ".join(f"'{a}'" for a in tx.APP_KEYWORDS) + f"]) AS app FROM documents) WHERE {_KW}")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(tx.implied_apps("text")).alias("app")))
query("j11_pair_similarity")(lambda s, d: _pairs(s, d))


def _pairs(spark, d):
    """Mean similarity between the sampled continuations of each prefix (a fixed few per prefix)."""
    from caseloom.plans.models import sampled

    _, s = sampled(spark, d)
    g = s.groupBy("case_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "suffix"))), lambda x: x["suffix"]).alias("ss"))
    return g.select("case_id", "pos", rnd(me.medoid("ss")["mean_pair"]).alias("mean_pair"))


