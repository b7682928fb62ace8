"""The prefix frame: one row per event, carrying everything later steps need about its case.

One ordered pass (:func:`caseloom.operators.sequence.sequence`) adds position, neighbours and case
borders; afterwards encodings, targets, contexts and metrics are row-wise or mergeable aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseloom.functions.columns import EOS, clean, decompose_activity, local_time, numeric
from caseloom.operators import sequence as S
from caseloom.schema import EventLog


def complete_expr(schema: EventLog, last_activity="last_act"):
    if schema.open_ended or not schema.endings:
        return F.lit(False)
    return F.col(last_activity).isin(list(schema.endings))


def prefix_frame(events: DataFrame, schema: EventLog, order: int = 2, max_len: int | None = None,
                 cutoff_us=None, assume_complete: bool = False, min_len: int = 1,
                 chunk_rows: int | None = None) -> DataFrame:
    """Ordered events with targets.

    ``max_len`` keeps the first events of a case and ``cutoff_us`` drops events at or after a time; a
    case that lost events counts as incomplete.  ``assume_complete`` overrides completeness last.
    """
    specs = {
        "pos": S.pos(), "n": S.length(), "last_act": S.last("activity"),
        "next_act": S.lead("activity"), "prev_us": S.lag("us"), "next_us": S.lead("us"),
        "first_us": S.first("us"), "last_us": S.last("us"),
    }
    specs.update({f"prev{j}": S.lag("activity", j) for j in range(1, order)})
    if "act" in events.columns:  # encoded label ids travel with the same pass
        specs["next_id"] = S.lead("act")
        specs.update({f"id{j}": S.lag("act", j) for j in range(1, order)})
    f = S.sequence(events, specs, chunk_rows=chunk_rows).withColumn("complete", complete_expr(schema))
    if min_len > 1:
        f = f.where(F.col("n") >= min_len)
    if cutoff_us is not None:
        f = _shorten(f, F.col("us") < cutoff_us, chunk_rows)
    if max_len is not None:
        f = _shorten(f, F.col("pos") < max_len, chunk_rows)
    if assume_complete:
        f = f.withColumn("complete", F.lit(True))
    return with_targets(f)


def _shorten(f: DataFrame, keep, chunk_rows) -> DataFrame:
    """Keep a leading part of every case; borders and completeness follow from what was kept."""
    kept = f.where(keep).withColumnRenamed("n", "_full").drop("last_us", "last_act")
    kept = S.sequence(kept, {"n": S.length(), "last_us": S.last("us"), "last_act": S.last("activity")}, chunk_rows=chunk_rows)
    is_last = F.col("pos") == F.col("n") - 1
    ahead = {c: F.when(~is_last, F.col(c)) for c in ("next_act", "next_us", "next_id") if c in kept.columns}
    return kept.withColumns({"complete": F.col("complete") & (F.col("n") == F.col("_full")), **ahead}).drop("_full")


def with_targets(f: DataFrame) -> DataFrame:
    """Targets: next label (``<EOS>`` after a complete case, null when censored), log waiting time, remaining seconds."""
    dt = (F.col("next_us") - F.col("us")) / 1e6
    ids = {"y_id": F.coalesce("next_id", F.when(F.col("complete"), F.lit(EOS)))} if "next_id" in f.columns else {}
    return f.withColumns({
        **ids,
        "y": F.coalesce("next_act", F.when(F.col("complete"), F.lit("<EOS>"))),
        "y_ldt": F.when(dt.isNotNull(), F.log1p(F.greatest(dt, F.lit(0.0)))),  # greatest() skips nulls
        "y_rem": F.when(F.col("complete"), (F.col("last_us") - F.col("us")) / 1e6),
        "dt_s": F.greatest(F.coalesce((F.col("us") - F.col("prev_us")) / 1e6, F.lit(0.0)), F.lit(0.0)),
        "elapsed_s": F.greatest((F.col("us") - F.col("first_us")) / 1e6, F.lit(0.0)),
    })


def local_clock(df: DataFrame, schema: EventLog) -> DataFrame:
    loc = local_time("ts", schema.zone)
    return df.withColumns({
        "hour": F.hour(loc), "weekday": F.weekday(loc),
        "midnight": (F.hour(loc) == 0) & (F.minute(loc) == 0) & (F.second(loc) == 0),
    })


def case_table(events: DataFrame, schema: EventLog, chunk_rows: int | None = None) -> DataFrame:
    """One row per case as a mergeable aggregate: borders, length, completeness and first-row attributes."""
    first = F.struct("us", "event_idx")
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("activity", first).alias("first_act"), F.max_by("activity", first).alias("last_act"),
    ]
    # an attribute is wrapped in a struct so that a null on the first row is kept as the value
    for c in schema.of("case_cat"):
        aggs.append(F.min_by(F.struct(F.col(f"case_{c}").alias("v")), first).alias(f"case_{c}"))
    for c in schema.of("case_num"):
        aggs.append(F.min_by(F.struct(F.col(f"case_{c}").alias("v")), first).alias(f"num_{c}"))
    out = events.groupBy("case_id").agg(*aggs)
    cols = {f"case_{c}": clean(F.col(f"case_{c}")["v"]) for c in schema.of("case_cat")}
    cols.update({f"num_{c}": numeric(F.col(f"num_{c}")["v"]) for c in schema.of("case_num")})
    return out.withColumns(cols).withColumn("complete", complete_expr(schema)) if cols else out.withColumn("complete", complete_expr(schema))


def components(df: DataFrame, schema: EventLog, label="activity") -> DataFrame:
    return df.withColumn("components", decompose_activity(label, schema.label_rule))


def drop_event(frame: DataFrame, drop) -> DataFrame:
    """The same cases without the events where ``drop`` holds, positions renumbered."""
    specs = {"pos": S.pos(), "n": S.length(), "prev1": S.lag("activity"), "next_act": S.lead("activity"),
             "prev_us": S.lag("us"), "next_us": S.lead("us"), "first_us": S.first("us"), "last_us": S.last("us"),
             "last_act": S.last("activity")}
    if "act" in frame.columns:
        specs.update({"id1": S.lag("act"), "next_id": S.lead("act")})
    keep = frame.where(~drop).drop(*specs, "y", "y_id", "y_ldt", "y_rem", "dt_s", "elapsed_s")
    return with_targets(S.sequence(keep, specs))


def case_labels(frame: DataFrame, label: str = "activity") -> DataFrame:
    """(case_id, labels): label sequence of every case.

    An array is one label longer than the suffix of the case's first prefix, so it is no larger than an output row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col(label).alias("l"))))
    return frame.groupBy("case_id").agg(F.transform(ordered, lambda e: e["l"]).alias("labels"))


def suffixes(frame: DataFrame, prefixes: DataFrame, label: str = "activity") -> DataFrame:
    """(case_id, pos, suffix): true continuation of the chosen prefixes, whole at any length.

    One array per case, sliced per prefix; no pairing of prefixes with events.
    """
    j = prefixes.select("case_id", "pos").join(case_labels(frame, label), "case_id")
    cut = F.slice("labels", (F.col("pos") + 2).cast("int"), F.size("labels"))
    return j.select("case_id", "pos", F.when(F.col("pos") < F.size("labels") - 1, cut).alias("suffix")).where(F.col("suffix").isNotNull())
