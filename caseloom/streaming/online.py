"""Structured Streaming forms: online case state, world state, and the two-way episode sink.

Two order policies of the online state.  By arrival (:func:`online_features`): inside a micro-batch events of a case
are applied in (time, id) order, at once.  By event time (:func:`event_time_features`): events wait until the watermark
has passed them and are applied in order of time over all micro-batches.  Under both, an event that comes too late for
its place is emitted with ``late = true`` and never applied out of order, so without late events the output equals the
batch frame row for row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.functions.pyfuncs import by_value
from caseloom.operators import traces as tc, transitions as tr
from caseloom.session import lookup_side, materialize, scratch_path
from caseloom.sources import episodes as se

ONLINE = "case_id string, event_idx long, us long, activity string, pos long, prev1 string, prev2 string, dt_s double, elapsed_s double, bag string, late boolean"
FEATURE = Row(*[c.split()[0] for c in ONLINE.split(", ")])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "pos long, prev1 string, prev2 string, first_us long, last_us long, last_idx long, bag string"


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Consume the events of one case in this batch one at a time; the state is a few values per case."""
    import json

    pos, p1, p2, first, last, last_idx, bag = state.get if state.exists else (0, None, None, None, None, None, "{}")
    counts = json.loads(bag)
    out = []
    events = pd.concat(list(batches)).sort_values(["us", "event_idx"], kind="stable")
    for e in events.itertuples(index=False):
        if last is not None and (e.us, e.event_idx) < (last, last_idx):
            out.append((key[0], e.event_idx, e.us, e.activity, None, None, None, None, None, None, True))
            continue
        first = e.us if first is None else first
        gap = 0.0 if last is None else (e.us - last) / 1e6
        counts[e.activity] = counts.get(e.activity, 0) + 1
        bag = json.dumps(counts, sort_keys=True)
        out.append((key[0], e.event_idx, e.us, e.activity, pos, p1, p2, max(gap, 0.0), (e.us - first) / 1e6, bag, False))
        pos, p1, p2, last, last_idx = pos + 1, e.activity, p1, e.us, e.event_idx
    state.update((pos, p1, p2, first, last, last_idx, bag))
    cols = ["case_id", "event_idx", "us", "activity", "pos", "prev1", "prev2", "dt_s", "elapsed_s", "bag", "late"]
    yield pd.DataFrame(out, columns=cols).astype({"pos": "Int64"})


def online_features(stream: DataFrame) -> DataFrame:
    """Prefix features of an event stream (case_id, event_idx, us, activity), emitted as events arrive."""
    ev = stream.select("case_id", "event_idx", "us", "activity")
    return ev.groupBy("case_id").applyInPandasWithState(by_value(_advance), ONLINE, STATE, "append", GroupStateTimeout.NoTimeout)


#: Buckets of cases; the cases of a bucket share its timer and its list of waiting events.
BUCKETS = 2048


class CaseClock(StatefulProcessor):
    """Prefix features of the cases of one bucket, each in order of event time.

    Events wait in a list state; a timer at the oldest one fires when the watermark has passed it and releases all that
    are due.  The list holds what arrived within the watermark's delay, never a whole case.  A case's state is read and
    written once when events of it are due: each access is a call to the state store, which costs far more than the
    events in it.  ``idle_ms`` after the last applied event the state of a case is given up.
    """

    CHUNK = 1000

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "case_id array<string>, us array<long>, event_idx array<long>, activity array<string>")
        self.cases = handle.getMapState("cases", "case_id string", "pos long, prev1 string, prev2 string, first_us long, last_us long, bag string")
        self.done = set()  # buckets released in this micro-batch

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, held, oldest = timerValues.getCurrentWatermarkInMs() * 1000, [], None
        for r in rows:
            case, us, idx, activity = r["case_id"], r["us"], r["event_idx"], r["activity"]
            if us is None or activity is None:
                continue
            if us < passed:
                yield FEATURE(case, idx, us, activity, None, None, None, None, None, None, True)
                continue
            held.append((case, us, idx, activity))
            oldest = us if oldest is None else min(oldest, us)
            if len(held) >= self.CHUNK:
                self.waiting.appendList(self._packed(held))
                held = []
        if held:
            self.waiting.appendList(self._packed(held))
        if oldest is not None:
            self.handle.registerTimer(oldest // 1000 + 1)

    def _packed(self, events: list[tuple]) -> list[tuple]:
        parts = (events[k:k + self.CHUNK] for k in range(0, len(events), self.CHUNK))
        return [tuple(list(c) for c in zip(*part)) for part in parts]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key in self.done:
            return
        self.done.add(key)
        now = timerValues.getCurrentWatermarkInMs()
        due: dict = {}
        rest = []
        for block in self.waiting.get():
            for e in zip(*block):
                if e[1] < now * 1000:
                    due.setdefault(e[0], []).append(e[1:])
                else:
                    rest.append(e)
        for case, events in due.items():
            yield from self._apply(case, sorted(events))
        if rest:
            if due:
                self.waiting.put(self._packed(rest))
            self.handle.registerTimer(min(e[1] for e in rest) // 1000 + 1)
        elif due:
            self.waiting.clear()
        if self.idle_ms is not None:
            self._give_up(now, {e[0] for e in rest})

    def _give_up(self, now: int, waiting: set) -> None:
        """Drop cases that have been idle; cases with waiting events are looked at when those are due."""
        ends = [(k[0], v[4] // 1000 + self.idle_ms + 1) for k, v in self.cases.iterator()]
        for case, end in ends:
            if end <= now and case not in waiting:
                self.cases.removeKey((case,))
        if later := [end for case, end in ends if end > now and case not in waiting]:
            self.handle.registerTimer(min(later))

    def _apply(self, case, events) -> Iterator[Row]:
        import json

        pos, p1, p2, first, last, bag = self.cases.getValue((case,)) or (0, None, None, None, None, "{}")
        counts = json.loads(bag)
        for us, idx, activity in events:
            first = us if first is None else first
            gap = 0.0 if last is None else (us - last) / 1e6
            counts[activity] = counts.get(activity, 0) + 1
            bag = json.dumps(counts, sort_keys=True)
            yield FEATURE(case, idx, us, activity, pos, p1, p2, max(gap, 0.0), (us - first) / 1e6, bag, False)
            pos, p1, p2, last = pos + 1, activity, p1, us
        self.cases.updateValue((case,), (pos, p1, p2, first, last, bag))

    def close(self) -> None:
        pass


def event_time_features(stream: DataFrame, delay: str, idle_ms: int | None = None) -> DataFrame:
    """Prefix features of an event stream (case_id, event_idx, us, activity) in order of event time.

    Rows come out when the watermark, ``delay`` behind the newest event, has passed them.  Rows behind the watermark on
    arrival come out as late.  Events without time or label only move the watermark (see :func:`clock_row`).  Needs the
    RocksDB state store (:func:`run_available` selects it).
    """
    ev = stream.select("case_id", "event_idx", "us", "activity", F.timestamp_micros("us").alias("_at")).withWatermark("_at", delay)
    ev = ev.withColumn("_bucket", F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)))
    # without the time column Spark does not drop late rows before the processor sees them
    return ev.drop("_at").groupBy("_bucket").transformWithState(by_value(CaseClock)(idle_ms), ONLINE, "Append", "EventTime")


def clock_row(df: DataFrame, us) -> DataFrame:
    """One row of an event stream that only tells the time, as a source sends when it is idle or ends."""
    t = df.sparkSession.range(1).select(F.lit(us).cast("long").alias("us"))
    return t.select(*[F.col("us") if c == "us" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def online_forecasts(features: DataFrame, vocab: DataFrame, m: tr.TransitionModel) -> DataFrame:
    """Waiting time (10 %, median, 90 %) and remaining time in seconds per streamed event, from the model's tables."""
    f = with_context(features.where(~F.col("late")), vocab)
    hits = []
    for k in range(m.order, -1, -1):
        t = m.waits.where(F.col("k") == k).select(F.col("ctx").alias(f"_x{k}"), F.col("ldt").alias(f"_v{k}"))
        f = f.withColumn(f"_key{k}", tr.context_key(m.order, k)).join(lookup_side(t), F.col(f"_key{k}") == F.col(f"_x{k}"), "left").drop(f"_key{k}", f"_x{k}")
        hits.append(f"_v{k}")
    f = f.withColumn("_w", F.coalesce(*hits)).drop(*hits)
    f = f.withColumns({c: F.expm1(F.col("_w")[i]) for i, c in enumerate(("dt_lo", "dt_hat", "dt_hi"))}).drop("_w")
    whole = m.remain_all.agg(F.max("rem_all")).first()[0]
    rem = m.remains.select(F.col("act").alias("_ra"), F.col("posb").alias("_rp"), "rem_med")
    f = f.join(lookup_side(rem), (F.col("act") == F.col("_ra")) & (F.least("pos", F.lit(tr.REM_BUCKETS)) == F.col("_rp")), "left")
    return f.withColumn("rem_hat", F.coalesce("rem_med", F.lit(whole), F.lit(0.0))).drop("_ra", "_rp", "rem_med")


def with_context(features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Label ids of the current and the previous event, by stream-static joins."""
    v = vocab.select("value", "id")
    f = features.join(lookup_side(v.withColumnRenamed("id", "_a")), features["activity"] == F.col("value"), "left").drop("value")
    f = f.join(lookup_side(v.select(F.col("value").alias("_p"), F.col("id").alias("_i1"))), F.col("prev1") == F.col("_p"), "left").drop("_p")
    return f.withColumns({"act": F.coalesce("_a", F.lit(1)), "id1": F.when(F.col("prev1").isNotNull(), F.coalesce("_i1", F.lit(1)))}).drop("_a", "_i1")


def online_predictions(features: DataFrame, vocab: DataFrame, m: tr.TransitionModel) -> DataFrame:
    """Next-label distribution per streamed event: stream-static joins with the model tables (order-2 contexts)."""
    f = with_context(features.where(~F.col("late")), vocab)
    hits = []
    for k in range(m.order, -1, -1):
        t = m.probs.where(F.col("k") == k).select(F.col("ctx").alias(f"_x{k}"), F.col("dist").alias(f"_v{k}"))
        f = f.withColumn(f"_key{k}", tr.context_key(m.order, k)).join(t, F.col(f"_key{k}") == F.col(f"_x{k}"), "left").drop(f"_key{k}", f"_x{k}")
        hits.append(f"_v{k}")
    return tr.with_probs(f.withColumn("dist", F.coalesce(*hits)).drop(*hits))


def run_available(df: DataFrame, label: str, mode: str = "append", on_batch=None, to: tuple[str, str] | None = None) -> str:
    """Process everything available into a Parquet folder (or through ``on_batch``) and return the folder.

    ``to`` names output and checkpoint of an earlier run that goes on.
    """
    spark = df.sparkSession
    out, ck = to or (scratch_path(spark, label), scratch_path(spark, f"{label}-ck"))
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    w = w.foreachBatch(on_batch(out)) if on_batch else w.format("parquet").option("path", out)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = w.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    q.awaitTermination()
    return out


def run_in_turns(parts: list[DataFrame], label: str, build) -> str:
    """Let ``parts`` arrive one after the other, each processed before the next one comes; returns the output folder.

    ``build`` makes the streaming query of the arrival folder.  State and watermark pass from turn to turn through the
    checkpoint, as after a restart.
    """
    spark = parts[0].sparkSession
    inbox, *to = (scratch_path(spark, f"{label}-{part}") for part in ("inbox", "out", "ck"))
    for part in parts:
        part.write.mode("append").parquet(inbox)
        run_available(build(event_stream(spark, inbox, parts[0].schema)), label, to=tuple(to))
    return to[0]


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt).option("columnNameOfCorruptRecord", "_corrupt")
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(folder)


def in_batches(df: DataFrame, bounds: list, column: str, label: str) -> str:
    """Write a table as consecutive files by ranges of ``column`` (arrival order for replays)."""
    path = scratch_path(df.sparkSession, label)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = df if lo is None else df.where(F.col(column) >= lo)
        part = part if hi is None else part.where(F.col(column) < hi)
        part.write.mode("append").parquet(path)
    return path


# ------------------------------------------------------------------ world state
def world_state_stream(steps: DataFrame) -> DataFrame:
    """Running world state of a step stream: state changes are stateless rows, the latest value per key is a
    streaming aggregate, so its state is one value per (episode, kind, key)."""
    at = tc.fact_order()
    g = tc.facts(steps).groupBy("episode_id", "kind", "key").agg(F.max_by(F.struct(F.col("value").alias("v")), at).alias("_v"), F.max(at).alias("_at"))
    return g.select("episode_id", "kind", "key", "_v", F.abs("_at.s").alias("since"), F.abs("_at.p").alias("place"))


def latest_table(folder: str):
    """foreachBatch target for an update-mode aggregate: each batch appends its changed keys with its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(folder)

    return put


def read_latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of every key written by :func:`latest_table`."""
    t = spark.read.parquet(folder)
    rest = [c for c in t.columns if c not in keys and c != "_batch"]
    g = t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ------------------------------------------------------------------ episode sink
def episode_sink(folder: str, salt: str = ""):
    """foreachBatch target: mask every text, validate, write valid documents and dead letters.

    Batches are written under their number, so a replayed batch overwrites itself instead of repeating rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        checked = se.masked_and_checked(batch, salt)
        checked.where(F.size("errors") == 0).drop("errors", "_corrupt").write.mode("overwrite").json(f"{folder}/episodes/batch={number}")
        checked.where(F.size("errors") > 0).write.mode("overwrite").json(f"{folder}/invalid/batch={number}")

    return put
