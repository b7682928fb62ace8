"""Synthetic process cases: splits, vocabularies, targets, the transition model and its evaluation."""

import math

import pytest
from pyspark.sql import functions as F

from caseloom.functions.columns import UNK, decompose_activity
from caseloom.operators import encode as en, frame as fr, metrics as me, rollout as ro, splits as sp, transitions as tr
from caseloom.schema import EventLog

SCHEMA = EventLog("claims", "UTC", "document", {"activity": ("name",), "event_cat": ("role",), "case_cat": ("unit",), "case_num": ("amount",)},
                  endings=("Payment Handled",))
STEPS = ["Declaration SUBMITTED by EMPLOYEE", "Declaration APPROVED by ADMINISTRATION", "Declaration FINAL_APPROVED by SUPERVISOR", "Request Payment", "Payment Handled"]
LOOP = "Declaration REJECTED by ADMINISTRATION"
DAY = 86_400_000_000
HOUR = 3_600_000_000


def events(spark, cases):
    """cases: [(case_id, start_us, [labels])] -> event table with one event per hour."""
    rows = [(c, i, s + i * HOUR, a, "EMPLOYEE", "U1", "10.0") for c, s, acts in cases for i, a in enumerate(acts)]
    df = spark.createDataFrame(rows, "case_id string, event_idx long, us long, activity string, ev_role string, case_unit string, case_amount string")
    return df.withColumn("ts", F.timestamp_add("MICROSECOND", F.col("us"), F.expr("timestamp_ntz'1970-01-01'")))


def process_cases():
    out = []
    for i in range(60):
        acts = STEPS[:1] + [LOOP] + STEPS if i % 10 < 3 else list(STEPS)
        out.append((f"c{i:02d}", i * DAY, acts[:-1] if i % 10 == 9 else acts))
    return out


@pytest.fixture(scope="module")
def log(spark):
    return events(spark, process_cases()).cache()


def test_random_split_sizes_disjoint_deterministic(spark, log):
    a = sp.split_random(log, seed=1)
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 42, "val": 9, "test": 9}
    assert sp.leaked_cases(a).isEmpty()
    fp = lambda s: sp.fingerprint(sp.split_random(log, seed=s)).first()["fingerprint"]
    assert fp(1) == fp(1) != fp(2)


def test_assigned_split_equals_joined_split(log):
    joined = {(r["case_id"], r["split"]) for r in sp.split_random(log, seed=5).collect()}
    placed = {(r["case_id"], r["split"]) for r in sp.assign_random(log, seed=5).select("case_id", "split").distinct().collect()}
    assert joined == placed


def test_chronological_split_orders_by_start(log):
    s = sp.split_chronological(fr.case_table(log, SCHEMA)).groupBy("split").agg(F.min("first_us").alias("lo"), F.max("first_us").alias("hi")).collect()
    at = {r["split"]: r for r in s}
    assert at["train"]["hi"] <= at["val"]["lo"] and at["val"]["hi"] <= at["test"]["lo"]


def test_cross_validation_covers_every_case_once(log):
    tests = [set(r["case_id"] for r in sp.split_cv(log, f, 7).where("split = 'test'").collect()) for f in range(7)]
    assert sorted(len(t) for t in tests) == [8, 8, 8, 9, 9, 9, 9] and len(set.union(*tests)) == 60


def test_vocabulary_is_train_only_and_unseen_is_unknown(spark, log):
    train = log.where(F.col("case_id") < "c40")
    v = {r["value"]: r["id"] for r in en.fit_vocab(train, "activity").collect()}
    assert [v["<PAD>"], v["<UNK>"], v["<EOS>"]] == [0, 1, 2] and v[STEPS[0]] == 3 and "Totally New Activity" not in v
    novel = events(spark, [("x", 0, [STEPS[0], "Totally New Activity"])])
    ids = [r["act"] for r in en.lookup(novel, en.fit_vocab(train, "activity"), "activity", "act").orderBy("event_idx").collect()]
    assert ids == [3, UNK]


def test_unseen_label_keeps_known_components(spark, log):
    comp = {r["value"]: r["id"] for r in en.fit_component_vocab(log, "document").collect()}
    parts = spark.range(1).select(decompose_activity(F.lit("Request For Payment APPROVED by ADMINISTRATION"), "document").alias("c")).first()["c"]
    assert parts == ["obj=Request For Payment", "act=APPROVED", "actor=ADMINISTRATION"]
    assert parts[0] not in comp and comp["act=APPROVED"] > 1 and comp["actor=ADMINISTRATION"] > 1
    plain = spark.range(1).select(decompose_activity(F.lit("Start trip"), "document").alias("c")).first()["c"]
    assert plain == ["obj=Start trip", "act=<none>", "actor=<none>"]


def test_targets_and_censoring(spark):
    f = fr.prefix_frame(events(spark, [("a", 0, STEPS[2:]), ("b", 0, STEPS[:3])]), SCHEMA).orderBy("case_id", "pos").collect()
    full, part = f[:3], f[3:]
    assert [r["y"] for r in full] == [STEPS[3], STEPS[4], "<EOS>"] and [r["y"] for r in part] == [STEPS[1], STEPS[2], None]
    assert full[2]["y_ldt"] is None and math.isclose(math.expm1(full[0]["y_ldt"]), 3600.0)
    assert [r["y_rem"] for r in full] == [7200.0, 3600.0, 0.0] and [r["y_rem"] for r in part] == [None] * 3


def test_capped_and_cut_cases_become_incomplete(spark):
    ev = events(spark, [("a", 0, list(STEPS))])
    cap = fr.prefix_frame(ev, SCHEMA, max_len=3).orderBy("pos").collect()
    assert len(cap) == 3 and not cap[-1]["complete"] and cap[-1]["y"] is None and cap[-1]["y_rem"] is None
    cut = fr.prefix_frame(ev, SCHEMA, cutoff_us=F.lit(2 * HOUR)).orderBy("pos").collect()
    assert len(cut) == 2 and not cut[0]["complete"]
    whole = fr.prefix_frame(ev, SCHEMA, max_len=3, assume_complete=True).orderBy("pos").collect()
    assert whole[-1]["y"] == "<EOS>"


def test_first_row_attribute_keeps_null(spark):
    rows = [("a", 0, 0, "x", None, None), ("a", 1, 1, "x", "7", "B")]
    df = spark.createDataFrame(rows, "case_id string, event_idx long, us long, activity string, case_amount string, case_unit string")
    c = fr.case_table(df, SCHEMA).first()
    assert c["num_amount"] is None and c["case_unit"] == "<MISSING>"


@pytest.fixture(scope="module")
def fitted(log):
    p = en.prepare(sp.assign_random(log, 0), SCHEMA)
    return p, tr.fit_prepared(p)


def test_transition_model_contract(fitted):
    p, m = fitted
    scored = tr.predict_next(p.frame, m)
    sums = scored.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s"), F.size("probs").alias("k")).agg(F.min("s"), F.max("s"), F.min("k"), F.max("k")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9 and sums[2] == sums[3] == p.size
    total = m.counts.where("k = 0").agg(F.sum("n")).first()[0]
    assert total == p.part("train").where("y_id IS NOT NULL").count()
    r = me.next_label(me.score(scored.where("split = 'test' AND y_id IS NOT NULL"))).first()
    assert 0.8 < r["accuracy"] <= 1 and r["nll"] > 0


def test_compact_scoring_equals_row_scoring(fitted):
    p, m = fitted
    rows = me.next_label(me.score(tr.predict_next(p.part("test").where("y_id IS NOT NULL"), m))).first()
    few = me.next_label(me.score(tr.predict_next(tr.compact(p.part("test"), p.order), m))).first()
    assert rows == few


def test_rollouts_end_and_stay_in_vocabulary(fitted):
    p, m = fitted
    pre = p.part("test").where("pos = 0").select("case_id", "pos", "id1", "act")
    greedy = [r["pred"] for r in ro.greedy(pre, m, 20).collect()]
    assert all(len(g) <= 20 and 2 not in g for g in greedy)
    samples = ro.sample(pre, m, 6, n=3, seed=1).collect()
    assert len(samples) == 3 * pre.count() and all(len(r["suffix"]) <= 6 and 2 not in r["suffix"] for r in samples)


def test_greedy_jumps_equal_single_steps(fitted):
    p, m = fitted
    pre = p.frame.select("case_id", "pos", "id1", "act")
    best = {(r["k"], r["ctx"]): r["best"] for r in tr.argmax_table(m).collect()}
    for r in ro.greedy(pre, m, 7).dropDuplicates(["id1", "act"]).collect():
        a, b, want = r["id1"], r["act"], []
        while len(want) < 7:
            n = best.get((2, f"{a}>{b}"), best.get((1, str(b)), best[(0, "")]))
            if n == 2:
                break
            want.append(n)
            a, b = b, n
        assert r["pred"] == want


def test_laplace_survival(spark):
    sf = lambda mu, b, x: spark.range(1).select(tr.laplace_sf(F.lit(mu), F.lit(b), F.lit(x)).alias("v")).first()["v"]
    assert sf(2.0, 1.0, 2.0) == 0.5 and math.isclose(sf(2.0, 1.0, 3.0), 0.5 * math.exp(-1)) and math.isclose(sf(2.0, 1.0, 1.0), 1 - 0.5 * math.exp(-1))


def test_saved_tables_reload_identically(spark, log):
    from caseloom.sources.store import load_tables, save_tables

    v = en.fit_vocab(log, "activity")
    back = load_tables(spark, save_tables(spark, {"vocab": v, "split": sp.split_random(log)}, "t"))
    assert set(map(tuple, back["vocab"].collect())) == set(map(tuple, v.collect()))


def test_suffixes_of_long_cases_are_whole(spark):
    acts = [f"s{i}" for i in range(199)] + ["Payment Handled"]
    f = fr.prefix_frame(events(spark, [("long", 0, acts), ("short", DAY, STEPS)]), SCHEMA)
    got = {(r.case_id, r.pos): r.suffix for r in fr.suffixes(f, f.where("complete")).collect()}
    assert len(got) == 199 + 4 and all(got["long", p] == acts[p + 1:] for p in range(199))
