"""Agent episodes derived from the conversations table, for Spark and for DuckDB.

Each turn is a step; 64 consecutive turns of a conversation are one episode (so an episode is bounded).
Codes, errors, candidates and outcomes follow md5 rules of (conversation, turn, candidate).
"""

from pyspark.sql import functions as F

from caseloom.functions.columns import hash_order
from caseloom.plans import sqltext as q
from caseloom.sources.tables import table

SEG = 64
T0 = 1704067200000000  # 2024-01-01 in microseconds
APPS = ["mail", "files", "notes", "supervisor", "api_docs"]
APIS = ["get", "list", "send", "login", "drop"]
TERMINATIONS = ["completed", "max_steps", "error", "budget"]
PRICES = [("model-0", 1.0, 5.0, 1.25, 0.1), ("model-1", 2.0, 10.0, 2.5, 0.2)]  # model-2 has no price on purpose


def h(seed, *cols):
    return hash_order(seed, *cols)


def _pick(words, idx):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (idx + 1).cast("int"))


def _code(k):
    """Code text of candidate ``k`` (a column)."""
    app, api = _pick(APPS, h("app", "conv_id", "turn", k) % 5), _pick(APIS, h("api", "conv_id", "turn", k) % 5)
    turn = F.col("turn").cast("string")
    call = (
        F.when(app == "supervisor", F.lit("apis.supervisor.complete_task(answer=x)"))
        .when(app == "api_docs", F.lit("apis.api_docs.show_api_doc(app_name='mail', api_name='get')"))
        .when(api == "login", F.concat(F.lit("tok = apis."), app, F.lit(".login(username='u', password='pw"), F.col("conv_id").cast("string"), F.lit("')['access_token']")))
        .otherwise(F.concat(F.lit("x = apis."), app, F.lit("."), api, F.lit("(access_token='tok"), turn, F.lit("')")))
    )
    note = F.when(h("note", "conv_id", "turn", k) % 7 == 0, F.concat(F.lit('\nnote("turn '), turn, F.lit('")'))).otherwise("")
    return F.when(h("none", "conv_id", "turn", k) % 11 == 0, "").otherwise(F.concat(call, F.lit("\nprint(x)"), note))


def _error(k):
    """Error type of candidate ``k`` if it is (or were) executed."""
    e = h("err", "conv_id", "turn", k) % 15
    return F.when(e == 0, "api_error").when(e == 5, "runtime_error").when(e == 10, "syntax_error")


def episode_base(spark, d):
    c = table(spark, d, "conversations")
    ep = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / SEG).cast("string"))
    return c.select(
        "conv_id", "turn", "role", "text", ep.alias("episode_id"), (F.col("turn") % SEG).cast("int").alias("step_index"),
        F.concat(F.lit("r"), (F.col("conv_id") % 2).cast("string")).alias("run_id"),
        F.when(F.col("conv_id") % 10 != 7, F.concat(F.lit("s"), (F.col("conv_id") % 20).cast("string"))).alias("scenario_id"),
        F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("task_id"),
        F.concat(F.lit("model-"), (h("model", "conv_id") % 3).cast("string")).alias("model_id"),
        (F.lit(T0) + F.col("conv_id") * 60000000).alias("started_us"),
    )


def candidates(spark, d):
    """One row per candidate action of every step."""
    c = episode_base(spark, d).withColumn("cand", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = "cand"
    has_cf = h("cf", "conv_id", "turn", k) % 6 != 0
    n = lambda tag, m, base=0: (h(tag, "conv_id", "turn", k) % m + base).cast("long")
    when = lambda v: F.when(has_cf, v)
    c = c.withColumns({"code": _code(k), "cf_error": when(_error(k)), "has_cf": has_cf})
    return c.withColumns({
        "action_raw": F.when(F.col("code") == "", F.lit("no plan")).otherwise(F.concat(F.lit("Thinking.\n```python\n"), F.col("code"), F.lit("\n```"))),
        "passes_before": when(n("pb", 3)), "passes_after": when(n("pa", 3)), "failures_after": when(n("fa", 3)), "cf_done": when(h("dn", "conv_id", "turn", k) % 4 == 0),
        "input_tokens": n("in", 900, 100), "output_tokens": n("out", 90, 10), "cache_read_tokens": n("cr", 50), "cache_write_tokens": n("cw", 20),
        "s_valid": (h("pv", "conv_id", "turn", k) % 100) / 100.0, "s_progress": (h("pp", "conv_id", "turn", k) % 100) / 100.0,
        "s_regress": (h("pr", "conv_id", "turn", k) % 100) / 100.0, "s_success": (h("ps", "conv_id", "turn", k) % 100) / 100.0,
    })


def steps(spark, d):
    """One row per executed step (the chosen candidate's action and its outcome)."""
    s = episode_base(spark, d).withColumn("chosen_index", (h("pick", "conv_id", "turn") % 3).cast("int"))
    fatal = (h("fatal", "conv_id") % 12 == 0) & (F.col("turn") % SEG == 0)
    s = s.withColumns({"code": _code("chosen_index"), "error_type": F.when(fatal, F.lit("llm_error")).otherwise(_error("chosen_index"))})
    turn = F.col("turn").cast("string")
    msg = (F.when(F.col("error_type") == "llm_error", F.lit("Your Credit balance is too low"))
           .when(F.col("error_type") == "api_error", F.concat(F.lit("Response status code is 422: boom "), turn))
           .when(F.col("error_type") == "syntax_error", F.lit("Syntax error on line 1")).when(F.col("error_type") == "runtime_error", F.lit("NameError: x")))
    app = F.regexp_extract("code", r"apis\.([a-z_]+)\.", 1)
    item = F.concat(F.lit('{"'), app, F.lit('_id": 3, "title": "x"}'))
    rows = F.concat(F.lit("["), F.array_join(F.array_repeat(item, (h("cnt", "conv_id", "turn") % 4 + 1).cast("int")), ", "), F.lit("]"))
    jit = F.when(h("jit", "conv_id", "turn") % 3 == 0, F.lit(15000000)).otherwise(0)
    s = s.withColumn("error_message", msg)
    return s.withColumns({
        "tool_result": F.when(F.col("error_type").isNotNull(), F.concat(F.lit("Execution failed. Traceback:\n"), F.col("error_message"), F.lit("\n")))
        .when(F.col("code").rlike(r"\.(get|list)\("), rows).otherwise("Execution successful."),
        "step_us": F.col("started_us") + F.col("turn") * 10000000 - jit,
        "passes": (h("pass", "conv_id", "turn") % 4).cast("long"), "failures": (h("fail", "conv_id", "turn") % 3).cast("long"),
        "done": h("done", "conv_id", "turn") % 10 == 0, "overrode_first": F.col("chosen_index") != 0,
        "observation": F.col("text"),
    })


def episodes(spark, d):
    """One row per episode: outcome, termination and border times."""
    b = episode_base(spark, d).groupBy("episode_id", "conv_id", "run_id", "scenario_id", "task_id", "model_id", "started_us").agg(
        F.count(F.lit(1)).alias("n_steps"), F.min_by("text", "turn").alias("instruction"))
    return b.withColumns({
        "success": F.when(h("succ", "conv_id") % 7 != 0, h("succ", "conv_id") % 3 != 0),
        "termination_reason": _pick(TERMINATIONS, h("term", "conv_id") % 4),
        "ended_us": F.when(h("end", "conv_id") % 5 != 0, F.col("started_us") + F.lit(3600000000)),
        "schema_version": F.when(h("ver", "conv_id") % 13 == 0, "0.9").otherwise("1.1.0"),
        "wall_s": (h("wall", "conv_id") % 100).cast("double"),
        "stored_steps": F.col("n_steps") + F.when(h("tot", "conv_id") % 8 == 0, 1).otherwise(0),
    })


# ------------------------------------------------------------------ the same rules for DuckDB
def hs(seed, *cols):
    return q.hash60(seed, "(" + " || ':' || ".join(cols) + ")")


def _case(words, idx):
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _code_sql(k):
    app, api = _case(APPS, f"{hs('app', 'conv_id', 'turn', k)} % 5"), _case(APIS, f"{hs('api', 'conv_id', 'turn', k)} % 5")
    return f"""(CASE WHEN {hs('none', 'conv_id', 'turn', k)} % 11 = 0 THEN '' ELSE (CASE WHEN {app} = 'supervisor' THEN 'apis.supervisor.complete_task(answer=x)' WHEN {app} = 'api_docs' THEN 'apis.api_docs.show_api_doc(app_name=''mail'', api_name=''get'')'
 WHEN {api} = 'login' THEN 'tok = apis.' || {app} || '.login(username=''u'', password=''pw' || conv_id || ''')[''access_token'']' ELSE 'x = apis.' || {app} || '.' || {api} || '(access_token=''tok' || turn || ''')' END)
 || chr(10) || 'print(x)' || (CASE WHEN {hs('note', 'conv_id', 'turn', k)} % 7 = 0 THEN chr(10) || 'note("turn ' || turn || '")' ELSE '' END) END)"""


def _error_sql(k):
    return f"(CASE {hs('err', 'conv_id', 'turn', k)} % 15 WHEN 0 THEN 'api_error' WHEN 5 THEN 'runtime_error' WHEN 10 THEN 'syntax_error' END)"


BASE_SQL = f"""eb AS (SELECT conv_id, turn, role, text, conv_id || '-' || (turn // {SEG}) AS episode_id, CAST(turn % {SEG} AS INTEGER) AS step_index, 'r' || (conv_id % 2) AS run_id,
 CASE WHEN conv_id % 10 <> 7 THEN 's' || (conv_id % 20) END AS scenario_id, 't' || conv_id AS task_id, 'model-' || ({hs('model', 'conv_id')} % 3) AS model_id, {T0} + conv_id * 60000000 AS started_us FROM conversations)"""


def _num(tag, m, base=0):
    return f"({hs(tag, 'conv_id', 'turn', 'cand')} % {m} + {base})"


_CF = f"{hs('cf', 'conv_id', 'turn', 'cand')} % 6 <> 0"
CAND_SQL = BASE_SQL + f""", cd0 AS (SELECT eb.*, cand FROM eb CROSS JOIN (SELECT unnest([0, 1, 2]) AS cand)),
cd AS MATERIALIZED (SELECT *, {_code_sql('cand')} AS code, CASE WHEN {_CF} THEN {_error_sql('cand')} END AS cf_error, {_CF} AS has_cf, CASE WHEN {_CF} THEN {_num('pb', 3)} END AS passes_before, CASE WHEN {_CF} THEN {_num('pa', 3)} END AS passes_after,
 CASE WHEN {_CF} THEN {_num('fa', 3)} END AS failures_after, CASE WHEN {_CF} THEN {_num('dn', 4)} = 0 END AS cf_done, {_num('in', 900, 100)} AS input_tokens, {_num('out', 90, 10)} AS output_tokens, {_num('cr', 50)} AS cache_read_tokens, {_num('cw', 20)} AS cache_write_tokens,
 {_num('pv', 100)} / 100.0::DOUBLE AS s_valid, {_num('pp', 100)} / 100.0::DOUBLE AS s_progress, {_num('pr', 100)} / 100.0::DOUBLE AS s_regress, {_num('ps', 100)} / 100.0::DOUBLE AS s_success FROM cd0)"""
STEP_SQL = BASE_SQL + f""", sp0 AS (SELECT *, CAST({hs('pick', 'conv_id', 'turn')} % 3 AS INTEGER) AS chosen_index FROM eb),
sp1 AS (SELECT *, {_code_sql('chosen_index')} AS code, CASE WHEN {hs('fatal', 'conv_id')} % 12 = 0 AND turn % {SEG} = 0 THEN 'llm_error' ELSE {_error_sql('chosen_index')} END AS error_type FROM sp0),
sp2 AS (SELECT *, CASE error_type WHEN 'llm_error' THEN 'Your Credit balance is too low' WHEN 'api_error' THEN 'Response status code is 422: boom ' || turn WHEN 'syntax_error' THEN 'Syntax error on line 1' WHEN 'runtime_error' THEN 'NameError: x' END AS error_message FROM sp1),
st AS MATERIALIZED (SELECT *, CASE WHEN error_type IS NOT NULL THEN 'Execution failed. Traceback:' || chr(10) || error_message || chr(10) WHEN regexp_matches(code, '\\.(get|list)\\(') THEN '[' || array_to_string(list_transform(range({hs('cnt', 'conv_id', 'turn')} % 4 + 1), lambda i: '{{"' || regexp_extract(code, 'apis\\.([a-z_]+)\\.', 1) || '_id": 3, "title": "x"}}'), ', ') || ']' ELSE 'Execution successful.' END AS tool_result,
 started_us + turn * 10000000 - CASE WHEN {hs('jit', 'conv_id', 'turn')} % 3 = 0 THEN 15000000 ELSE 0 END AS step_us, {hs('pass', 'conv_id', 'turn')} % 4 AS passes, {hs('fail', 'conv_id', 'turn')} % 3 AS failures, {hs('done', 'conv_id', 'turn')} % 10 = 0 AS done, chosen_index <> 0 AS overrode_first, text AS observation FROM sp2)"""
EP_SQL = f"""ep AS MATERIALIZED (SELECT *, CASE WHEN {hs('succ', 'conv_id')} % 7 <> 0 THEN {hs('succ', 'conv_id')} % 3 <> 0 END AS success, {_case(TERMINATIONS, hs('term', 'conv_id') + ' % 4')} AS termination_reason, CASE WHEN {hs('end', 'conv_id')} % 5 <> 0 THEN started_us + 3600000000 END AS ended_us,
 CASE WHEN {hs('ver', 'conv_id')} % 13 = 0 THEN '0.9' ELSE '1.1.0' END AS schema_version, CAST({hs('wall', 'conv_id')} % 100 AS DOUBLE) AS wall_s, n_steps + CASE WHEN {hs('tot', 'conv_id')} % 8 = 0 THEN 1 ELSE 0 END AS stored_steps
 FROM (SELECT episode_id, conv_id, run_id, scenario_id, task_id, model_id, started_us, count(*) AS n_steps, arg_min(text, turn) AS instruction FROM eb GROUP BY ALL))"""
