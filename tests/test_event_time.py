"""Event-time state: order over micro-batches, late rows, and expiry."""

from pyspark.sql import functions as F

from caseloom.operators import frame as fr
from caseloom.plans.streams import event_time_run
from caseloom.schema import CLICKS
from caseloom.sources import tables as t
from caseloom.streaming import online as on

SCHEMA = "case_id string, event_idx long, us long, activity string"
COLS = ["case_id", "event_idx", "pos", "prev1", "prev2", "dt_s", "elapsed_s"]


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def run(spark, turns, delay, idle_ms=None):
    parts = [rows(spark, x) if isinstance(x, list) else on.clock_row(rows(spark, []), x) for x in turns]
    out = on.run_in_turns(parts, "t-event", lambda s: on.event_time_features(s, delay, idle_ms))
    return {(r.case_id, r.event_idx): r for r in spark.read.parquet(out).collect()}


def test_shuffled_arrival_equals_batch(spark, sf_dir):
    got = event_time_run(spark, sf_dir, "t-shuffled")
    assert got.where("late").isEmpty()
    want = fr.prefix_frame(t.clicks(spark, sf_dir), CLICKS, order=3).select(*COLS)
    assert sorted(map(tuple, got.select(*COLS).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    last = {r.case_id: r for r in got.collect() if r.pos >= 0}
    bags = got.groupBy("case_id").agg(F.max_by("bag", "pos").alias("bag"), F.count(F.lit(1)).alias("n")).collect()
    import json
    assert len(last) == len(bags) and all(sum(json.loads(r.bag).values()) == r.n for r in bags)


def test_late_ties_and_waiting(spark):
    s = 1_000_000
    got = run(spark, [
        [("a", 1, 50 * s, "y"), ("a", 0, 40 * s, "x"), ("b", 0, 45 * s, "x"), (None, 0, 44 * s, "n")],
        [("a", 3, 55 * s, "z2"), ("a", 2, 55 * s, "z1"), ("c", 0, 100 * s, "x")],  # the watermark goes to 90 s
        [("a", 4, 89 * s, "late"), ("a", 5, 90 * s, "w"), ("b", 1, 10 * s, "late"), ("d", 0, None, "no time"), ("d", 1, 95 * s, None)],
        200 * s,
    ], "10 seconds")
    assert {k: (r.pos, r.prev1, r.late) for k, r in got.items()} == {
        ("a", 0): (0, None, False), ("a", 1): (1, "x", False), ("a", 2): (2, "y", False), ("a", 3): (3, "z1", False),
        ("a", 5): (4, "z2", False), ("b", 0): (0, None, False), ("c", 0): (0, None, False), (None, 0): (0, None, False),
        ("a", 4): (None, None, True), ("b", 1): (None, None, True)}
    assert got[("a", 5)].bag == '{"w": 1, "x": 1, "y": 1, "z1": 1, "z2": 1}' and got[("a", 5)].elapsed_s == 50.0


def test_idle_cases_are_given_up(spark):
    s = 1_000_000
    turns = [[("a", 0, 10 * s, "x")], [("b", 0, 60 * s, "x")], [("a", 1, 70 * s, "y"), ("b", 1, 75 * s, "y")], 300 * s]
    kept = run(spark, turns, "1 second")
    assert kept[("a", 1)].pos == 1 and kept[("b", 1)].pos == 1
    gone = run(spark, turns, "1 second", idle_ms=30_000)
    assert gone[("a", 1)].pos == 0 and gone[("a", 1)].elapsed_s == 0.0 and gone[("b", 1)].pos == 1


def test_state_is_read_once_a_case():
    calls = {"get": 0, "update": 0, "list": 0}

    class Waiting(list):
        def appendList(self, rows):
            calls["list"] += 1
            self.extend(rows)

        def get(self):
            calls["list"] += 1
            return iter(list(self))

    class Cases(dict):
        def getValue(self, k):
            calls["get"] += 1
            return self.get(k)

        def updateValue(self, k, v):
            calls["update"] += 1
            self[k] = v

    class Handle:
        getListState = staticmethod(lambda *a: Waiting())
        getMapState = staticmethod(lambda *a: Cases())
        registerTimer = staticmethod(lambda ms: None)

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    clock = on.CaseClock(None)
    clock.init(Handle())
    rows_ = [{"case_id": f"c{k % 50}", "us": 1000 * (700 - k), "event_idx": k, "activity": "x" if k % 3 else "y"} for k in range(700)]
    assert not list(clock.handleInputRows((7,), iter(rows_), Clock(0)))
    out = list(clock.handleExpiredTimer((7,), Clock(10_000), None)) + list(clock.handleExpiredTimer((7,), Clock(10_000), None))
    assert len(out) == 700 and not clock.waiting and calls == {"get": 50, "update": 50, "list": 2}
    assert sorted(r.pos for r in out if r.case_id == "c3") == list(range(14))
