"""Trace documents, redaction, gates, ranking, world state."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from caseloom.functions import entities as ent, text as tx
from caseloom.operators import traces as tc
from caseloom.sources import episodes as se, xes

OPEN = "session.open(user='kim@example.org', password='tulip-44')\nconfig = {\"api_key\": \"kk-00-zz\", \"size\": 3}\nmail kim@example.org"
CUT = "my_token_2 = 'abc def\nnext(1)\nhead eyJ0123456789.abcdefghijkl.mnopqrstuvwx tail OTP : \"991 "


def masked(spark, texts, salt="s"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", ent.redact("s", salt).alias("r"))
    return [(r["r"]["text"], r["r"]["n"]) for r in df.orderBy("i").collect()]


def expected(value, salt="s"):
    return "<REDACTED:" + hashlib.sha256((salt + value).encode()).hexdigest()[:8] + ">"


def test_redaction_rules(spark):
    a, b, plain, empty, null = masked(spark, [OPEN, CUT, "no key, no = sign", "", None])
    assert a == (OPEN.replace("tulip-44", expected("tulip-44")).replace("kk-00-zz", expected("kk-00-zz")), 2)
    assert b == (CUT.replace("abc def", expected("abc def")).replace("eyJ0123456789.abcdefghijkl.mnopqrstuvwx", expected("eyJ0123456789.abcdefghijkl.mnopqrstuvwx"))
                 .replace("991 ", expected("991 ")), 3)
    assert plain == ("no key, no = sign", 0) and empty == ("", 0) and null == (None, None)
    assert masked(spark, [a[0], b[0]], "t") == [(a[0], 0), (b[0], 0)]  # masked text stays


def test_redaction_sees_every_script(spark):
    text = "password\u00a0= 'hunter2' \u00e9token\u2003=\u2003\"x1\"\u2028y"
    assert masked(spark, [text]) == [(text.replace("hunter2", expected("hunter2")).replace("x1", expected("x1")), 2)]
    assert masked(spark, ["token = ''", "a" * 200_000 + " secret='v'"]) == [("token = '" + expected("") + "'", 1), ("a" * 200_000 + " secret='" + expected("v") + "'", 1)]


def test_whole_documents_are_masked(spark):
    kind = "api_key string, note string, list array<struct<token:string,said:array<string>>>, more map<string,string>, n int"
    row = ("K123", "password: 'x'", [("T9", ["otp='77'", None]), None], {"Secret": "zz", "about": "secret = 'q'", "gone": None}, 4)
    d = ent.redact_documents(spark.createDataFrame([row, (None,) * 5], kind), "s")
    r, null = sorted(d.collect(), key=lambda x: x["n"] is None)
    assert r["api_key"] == expected("K123") and r["note"] == "password: '" + expected("x") + "'" and r["n"] == 4
    assert [tuple(x) if x else None for x in r["list"]] == [(expected("T9"), ["otp='" + expected("77") + "'", None]), None]
    assert r["more"] == {"Secret": expected("zz"), "about": "secret = '" + expected("q") + "'", "gone": None}
    assert tuple(r["redaction"]) == ("2", 6) and tuple(null)[:5] == (None,) * 5 and null["redaction"]["n_redactions"] == 0
    again = sorted(ent.redact_documents(d, "t").collect(), key=lambda x: x["n"] is None)[0]
    assert again["redaction"]["n_redactions"] == 0 and again["list"] == r["list"]


def test_code_parsing(spark):
    cases = {
        "Plan:\n```python\ny = 2\n```\nend": ("y = 2", None), "I would rather wait.": (None, "no_code_block"),
        'a <function_calls><invoke name="q"><parameter>apis.mail.send()</parameter>': (None, "fake_tool_call_xml"), "```python\nfor k in range(": (None, "truncated_code_block"),
        "apis.mail.send(to='k')": ("apis.mail.send(to='k')", "no_fence"), "```\none\n```\n```\ntwo\n```": ("two", None)}
    out = spark.createDataFrame(list(enumerate(cases)), "i int, s string").select("i", tx.code_block("s", True).alias("b")).orderBy("i").collect()
    assert [(r["b"]["code"], r["b"]["parse_error"]) for r in out] == list(cases.values())


def test_step_activity(spark):
    f = lambda code, err: spark.range(1).select(tx.action_activity(F.lit(code), F.lit(err)).alias("a")).first()["a"]
    assert f("z = apis.depot.fetch(2)", None) == "depot.fetch|ok" and f("x", "api_error") == "python.no_api|err" and f("", None) == "none.no_code|ok"


def episode(eid="e1", steps=((0, 0, 1), (1, 0, 1)), version="1.1.0", **kw):
    cand = {"action_raw": "```python\nprint(1)\n```", "action": {"type": "execute_code", "code": "print(1)"}}
    st = [{"step_index": i, "timestamp": "2026-01-01T00:00:00Z", "observation": "o", "action_schema_ref": "h", "candidates": [cand] * n, "chosen_index": c, "tool_result": "1",
           "error": {"type": "api_error", "message": "boom"} if i == 1 else None} for i, c, n in steps]
    return {"schema_version": version, "env_id": "m", "benchmark": "m", "task_id": "t1", "episode_id": eid, "run_id": "r1", "split": "train", "versions": {"model_id": "x"},
            "started_at": "2026-01-01T00:00:00Z", "task_instruction": "do x", "steps": st, "termination_reason": "max_steps", "task_meta": {"a": 1}, **kw}


def test_reading_and_validating_documents(spark, tmp_path):
    docs = [episode(), episode("gap", ((0, 0, 1), (2, 0, 1))), episode("pick", ((0, 3, 2),)), episode("old", version="0.9"), episode("end", termination_reason="bored"),
            episode("none", task_id=None)]
    for i in (0, 1):
        (tmp_path / f"d{i}").mkdir()
    (tmp_path / "d0" / "a.jsonl").write_text("\n\n".join(json.dumps(d) for d in docs[:3]) + "\n")
    (tmp_path / "d1" / "b.jsonl").write_text("\n".join(json.dumps(d) for d in docs[3:]) + "\n{broken\n")
    df = se.read_episodes(spark, [str(tmp_path / "d0"), str(tmp_path / "d1")])
    got = {r["episode_id"]: list(r["e"]) for r in df.where("_corrupt IS NULL").select("episode_id", se.validation_errors().alias("e")).collect()}
    assert got == {"e1": [], "gap": ["step_index"], "pick": ["chosen_index"], "old": ["schema_version"], "end": ["termination_reason"], "none": ["missing:task_id"]}
    assert [r["_corrupt"] for r in df.select("episode_id", "_corrupt").where("_corrupt IS NOT NULL").collect()] == ["{broken"]
    steps = se.flatten_steps(df.where("episode_id = 'e1'")).orderBy("step_index").collect()
    assert [s["error_type"] for s in steps] == [None, "api_error"] and steps[0]["code"] == "print(1)"  # failed actions are kept
    assert df.where("episode_id = 'e1'").select("episode_id", "task_meta").first()["task_meta"] == '{"a": 1}'
    ok, bad = se.write_validated(df.drop("trace_file"), str(tmp_path / "out"))
    assert spark.read.json(ok).count() == 1
    dead = [(r["episode_id"], r["errors"][0], r["_corrupt"]) for r in spark.read.json(bad).collect()]
    assert len(dead) == 6 and (None, "unparsable", "{broken") in dead


CAND = "episode_id string, step_index int, cand int, code string"


def table(spark, codes, history=()):
    c = spark.createDataFrame([("e", len(history), i, x) for i, x in enumerate(codes)], CAND).withColumn("score", F.lit(None).cast("double"))
    s = spark.createDataFrame([("e", i, code, err) for i, (code, err) in enumerate([*history, ("", None)])], "episode_id string, step_index int, code string, error_type string")
    return c, s


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame([("depot", "fetch"), ("depot", "names"), ("supervisor", "complete_task"), ("api_docs", "show_api_doc")], "app string, api string")


def test_gates(spark, published):
    def flags(codes, history=()):
        c, s = table(spark, codes, history)
        return [(r["unknown_call"], r["premature"]) for r in tc.gate_flags(c, s, published).orderBy("cand").collect()]

    assert flags(["y = apis.depot.fetch(3)", "apis.depot.wipe()", "apis.cellar.fetch(3)"]) == [(False, False), (True, False), (True, False)]
    end = ["apis.supervisor.complete_task(answer=1)"]
    for history, premature in (((), True), ([("apis.api_docs.show_api_doc()", None)], True), ([("apis.depot.names()", "api_error")], True),
                               ([("apis.depot.names()", None)], False)):
        assert flags(end, history) == [(False, premature)]


def test_gated_choice_and_fallback(spark, published):
    def pick(codes, scores):
        c, s = table(spark, codes)
        c = c.join(spark.createDataFrame(list(enumerate(scores)), "cand int, sc double"), "cand").withColumn("score", F.col("sc"))
        r = tc.gated_choice(tc.gate_flags(c, s, published)).first()
        return r["chosen"], r["rejected"], r["fallback"]

    assert pick(["apis.depot.wipe()", "apis.depot.names()", "apis.supervisor.complete_task()"], [0.9, 0.2, 0.8]) == (1, "0,2", False)
    assert pick(["apis.depot.wipe()", "apis.cellar.fetch(1)"], [0.3, 0.4]) == (1, "0,1", True)


def test_lookahead_order(spark):
    seen = {0: (False, None, None, None, None, None), 1: (True, None, 1, 3, 0, False), 2: (True, "api_error", 2, 2, 0, True), 3: (True, None, 0, 2, 2, True)}
    kind = "episode_id string, step_index int, cand int, has_cf boolean, cf_error string, passes_before int, passes_after int, failures_after int, cf_done boolean"
    df = spark.createDataFrame([("q", 5, i, *v) for i, v in seen.items()], kind).withColumn("score", tc.lookahead_score())
    assert {r["cand"]: r["score"] for r in df.collect()} == {0: -10.0, 1: 4.0, 2: -1.0, 3: 1.0} and tc.choose(df).first()["chosen"] == 1


def test_choice_keeps_first_on_ties_and_small_margins(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.5), ("a", 0, 1, 0.5), ("b", 0, 0, 0.5), ("b", 0, 1, 0.55), ("c", 0, 0, 0.1), ("c", 0, 1, 0.9)], "episode_id string, step_index int, cand int, score double")
    assert {r["episode_id"]: (r["chosen"], r["overrode_first"]) for r in tc.choose(df, min_margin=0.1).collect()} == {"a": (0, False), "b": (0, False), "c": (1, True)}


def test_world_state(spark):
    kind = "episode_id string, step_index int, code string, error_type string, error_message string, tool_result string"
    steps = [("key = apis.bank.login(username='k', password='p')['access_token']", None, None, "ok"),
             ("rows = apis.bank.transfers(access_token=key)", None, None, '[{"transfer_id": 31, "to": "x"}, {"transfer_id": 32}, {"transfer_id": 33}]'),
             ("apis.mail.sned()", "api_error", "unknown call sned", "failed"), ('note("three transfers")', None, None, "ok")]
    state = lambda rows: {(r["kind"], r["key"]): r["value"] for r in tc.world_state(tc.facts(spark.createDataFrame([("w", i, *x) for i, x in enumerate(rows)], kind))).collect()}
    w = state(steps)
    assert w[("auth", "bank")] == "key" and {("app", "bank"), ("app", "mail"), ("note", "three transfers")} <= set(w) and w[("error", "mail.sned")] == "unknown call sned"
    e = json.loads(w[("entity", "bank.transfers")])
    assert (e["count"], e["id_field"], e["first_ids"], e["keys"]) == (3, "transfer_id", ["31", "32", "33"], ["to", "transfer_id"])
    assert ("error", "mail.sned") not in state([*steps, ("apis.mail.sned()", None, None, '{"id": 5}')])  # a later success clears it


def plain_states(rows, max_notes=12):
    """State after each step by applying the facts one after the other."""
    state, notes, out = {}, [], {}
    for step, changes in rows:
        for kind, key, value in changes:
            if kind == "note":
                notes += [key] if key not in notes else []
            elif value is None:
                state.pop((kind, key), None)
            else:
                state[kind, key] = value
        out[step] = {**state, **{("note", n): "" for n in notes[-max_notes:]}}
    return out


def test_state_after_each_step(spark):
    kind = "episode_id string, step_index int, code string, error_type string, error_message string, tool_result string"
    doc = json.dumps({"parameters": [{"name": "q", "required": True}, {"name": "page"}]})
    steps = [
        ("a = apis.bank.login(username='k')\nb = apis.bank.login(username='l')['access_token']\nnote('n0')", None, None, "ok"),
        ("print(apis.api_docs.show_api_doc(app_name='bank', api_name='search'))", None, None, doc),
        ("apis.api_docs.show_api_descriptions(app_name='mail')", None, None, '[{"name": "send"}, {"name": "read"}]'),
        ("apis.bank.search(q=1)", "api_error", "first", "no"), ("apis.bank.search(q=2)\napis.bank.search(q=3)", "api_error", "second", "no"),
        ("apis.bank.search(q=4)", None, None, '[{"id": 1}]'), ("apis.bank.search(q=4)", None, None, '{"id": 2, "to": "x"}'), ("", None, None, ""),
        ("a = apis.bank.login(x=1)\na2 = apis.bank.login(x=2)", None, None, "ok"),
        ("\n".join(f"note('n{i}')" for i in range(8)), None, None, "ok"), ("\n".join(f"note('m{i}')" for i in range(9)), None, None, "ok")]
    df = spark.createDataFrame([("e", i, *x) for i, x in enumerate(steps)] + [("f", 0, "apis.mail.send()", None, None, "1")], kind)
    facts = tc.facts(df)
    rows = {}
    for r in sorted(facts.where("episode_id = 'e'").collect(), key=lambda r: (r.step_index, r.place)):
        rows.setdefault(r.step_index, []).append((r.kind, r.key, r.value))
    want = plain_states([(i, rows.get(i, [])) for i in range(len(steps))])
    spans = tc.world_intervals(facts)
    got = {i: {} for i in want}
    for r in tc.state_at(spans, df.where("episode_id = 'e'")).collect():
        assert (r.kind, r.key) not in got[r.step_index]
        got[r.step_index][r.kind, r.key] = r.value
    assert got == want
    sizes = {r.step_index: {k: r[f"n_{k}"] for k in tc.KINDS} for r in tc.state_sizes(spans, df).where("episode_id = 'e'").collect()}
    assert sizes == {i: {k: sum(x[0] == k for x in s) for k in tc.KINDS} for i, s in want.items()}
    end = {(r.kind, r.key): r.value for r in tc.world_state(facts).where("episode_id = 'e'").collect()}
    assert end == want[len(steps) - 1] and end["auth", "bank"] == "a2" and want[0]["auth", "bank"] == "b"
    assert end["signature", "bank.search"] == "(q, page?)" and ("api", "mail.read") in end and want[4]["error", "bank.search"] == "second"
    assert json.loads(want[6]["entity", "bank.search"])["values"] == {"id": "2", "to": "x"} and ("error", "bank.search") not in want[5]


def test_seeded_state(spark):
    eps = spark.createDataFrame([("e", "Pay the rent and mail Ann"), ("f", "Nothing here"), ("g", None)], "episode_id string, task_instruction string")
    pub = spark.createDataFrame([("venmo", "login", "(username, password)"), ("venmo", "pay", None), ("spotify", "login", "()"), ("gmail", "send", "(to)")], "app string, api string, signature string")
    got = {(r.episode_id, r.kind, r.key): r.value for r in tc.world_state(tc.seed_facts(eps, pub)).collect()}
    assert got == {("e", "app", "venmo"): "", ("e", "app", "gmail"): "", ("e", "api", "venmo.login"): "", ("e", "api", "venmo.pay"): "", ("e", "api", "gmail.send"): "",
                   ("e", "signature", "venmo.login"): "(username, password)"}
    later = spark.createDataFrame([("e", 0, 0, "signature", "venmo.login", "(u)")], "episode_id string, step_index int, place int, kind string, key string, value string")
    spans = tc.world_intervals(tc.seed_facts(eps, pub).unionByName(later)).where("kind = 'signature'").collect()
    assert {(r.valid_from, r.valid_to, r.value) for r in spans} == {(-1, 0, "(username, password)"), (0, None, "(u)")}


def test_labels_of_unknown_states(spark):
    kind = ("episode_id string, step_index int, chosen_index int, code string, error_type string, success boolean, reward double, done boolean, failures int, "
            "scenario_id string, task_id string, instruction string, last_observation string, last_error string, last_code string, n_prev_errors int, schema_version string")
    tail = ("s", "t", "i", "", "", "", 0, "1.1.0")
    rows = [("e", 0, 0, "x", None, True, None, True, 2, *tail), ("e", 1, 0, None, None, True, 1.0, None, None, *tail), ("e", 2, 0, "x", None, None, 0.0, True, 1, *tail)]
    got = tc.executed_examples(spark.createDataFrame(rows, kind)).orderBy("step_index").collect()
    assert [(r["label_valid"], r["label_progress"], r["label_regress"]) for r in got] == [(1, None, None), (0, 1, 0), (1, 0, 1)]


def test_run_summary_counts_episodes_without_steps(spark):
    e = spark.createDataFrame([("a", "r", "s1", "t1", True, 2, 1.0, 0.1, "completed"), ("b", "r", "s2", "t2", False, 0, 1.0, 0.1, "error")],
                              "episode_id string, run_id string, scenario_id string, task_id string, success boolean, n_steps int, wall_s double, cost_usd double, termination_reason string")
    s = spark.createDataFrame([("a", 0, False, None), ("a", 1, True, "api_error")], "episode_id string, step_index int, overrode_first boolean, error_type string")
    r = tc.run_summary(e, s).first()
    assert (r["n_episodes"], r["tgc"], r["invalid_rate"], r["override_rate"], r["sgc"]) == (2, 0.5, 0.5, 0.5, 0.5)


def test_implied_apps(spark):
    r = spark.range(1).select(tx.implied_apps(F.lit("How much do I OWE Kim?"), ["spotify", "venmo"]).alias("a")).first()
    assert r["a"] == ["venmo"]


def test_counterfactual_examples(spark):
    from caseloom.plans import episodes as ep

    d = "/root/testdata/sf0.001"
    steps, cands = tc.dense_reward(ep.steps(spark, d)), ep.candidates(spark, d)
    ctx = tc.step_context(steps, ep.episodes(spark, d))
    ex, cf = tc.executed_examples(ctx), tc.counterfactual_examples(cands, ctx)
    assert ex.count() == steps.count() and ex.unionByName(cf).select("example_id").distinct().count() == ex.count() + cf.count()
    assert cf.where("label_progress IS NULL OR label_success IS NOT NULL").isEmpty()


# ------------------------------------------------------------------ event-log files
LOG = """<?xml version="1.0" encoding="UTF-8"?>
<log xmlns="http://www.xes-standard.org/" xes.version="1.0">
 <extension name="Concept" prefix="concept" uri="http://x"/>
 <global scope="trace"><string key="concept:name" value="none"/></global>
 <global scope="event"><string key="org:role" value="NA"/><date key="time:timestamp" value="2000-01-01T00:00:00Z"/></global>
 <classifier name="Activity" keys="concept:name lifecycle:transition"/>
 <string key="source" value="unit"/><string key="meta_x" value="no"/>
 <trace><string key="concept:name" value="T1"/><float key="amount" value="3.5"/>
  <event><string key="concept:name" value="A"/><date key="time:timestamp" value="2020-01-01T10:00:00+02:00"/><int key="cost" value="3"><string key="currency" value="EUR"/></int></event>
  <event><string key="concept:name" value="B"/><date key="time:timestamp" value="2020-01-01T09:00:00.500Z"/></event></trace>
 <trace><event><string key="concept:name" value="A"/></event></trace>
 <trace><string key="concept:name" value="T3"/><event><string key="concept:name" value="C"/><boolean key="ok" value="true"/><date key="time:timestamp" value="2020-01-02T00:00:00Z"/></event></trace>
</log>
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_event_log_file(spark, tmp_path, zipped):
    f = tmp_path / ("log.xes.gz" if zipped else "log.xes")
    f.write_bytes(gzip.compress(LOG.encode()) if zipped else LOG.encode())
    ev = xes.read_events(spark, str(f), "unit").orderBy("case_id", "event_idx").collect()
    assert [(r["case_id"], r["event_idx"]) for r in ev] == [("T1", 0), ("T1", 1), ("T3", 0), ("__trace_1", 0)]
    assert ev[0]["ev"] == {"concept:name": "A", "time:timestamp": "2020-01-01T10:00:00+02:00", "cost": "3", "cost.currency": "EUR"} and ev[0]["cs"] == {"concept:name": "T1", "amount": "3.5"}
    assert str(ev[0]["ts"]) == "2020-01-01 08:00:00" and ev[1]["us"] % 1_000_000 == 500_000 and ev[3]["ts"] is None
    assert xes.read_events(spark, str(f), "unit", max_traces=2).select("case_id").distinct().count() == 2
    h = xes.read_header(spark, str(f)).first()
    assert h["log_attrs"] == {"source": "unit"} and h["classifiers"] == {"Activity": ["concept:name", "lifecycle:transition"]}
    assert h["globals_trace"] == {"concept:name": "none"} and set(h["globals_event"]) == {"org:role", "time:timestamp"}


def test_attribute_pairs_are_built_once(spark):
    leaf = "struct<_key:string,_value:string>"
    attr = f"struct<_key:string,_value:string,{','.join(f'{t}:array<{leaf}>' for t in xes.TYPES)}>"
    df = spark.range(1).selectExpr(f"""from_json('{{"string": [{{"_key": "a", "_value": "1"}}, null, {{"_key": "b", "int": [{{"_key": "c", "_value": "2"}}]}}, {{"_value": "x"}}, {{"_key": "a", "_value": "3"}}]}}',
        'struct<{','.join(f'{t}:array<{attr}>' for t in xes.TYPES)}>') as e""")
    out = df.select(xes._as_map(xes._entries(lambda t: F.col("e")[t])).alias("m"))
    assert out.first().m == {"a": "3", "b": None, "b.c": "2"}
    pairs = spark.createDataFrame([([("a", "1"), ("a", "2")],)], "pairs array<struct<key:string,value:string>>").select(xes._as_map(F.col("pairs")).alias("m"))
    assert pairs._jdf.queryExecution().analyzed().toString().split("\n")[0].count("pairs#") == 1 and pairs.first().m == {"a": "2"}
