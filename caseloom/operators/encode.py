"""Train-fit vocabularies and scalers as small tables, and their application to prefix frames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.columns import SPECIALS, UNK, decompose_activity, local_time
from caseloom.operators.frame import prefix_frame
from caseloom.operators.ranking import global_rank
from caseloom.schema import EventLog
from caseloom.session import key_side, literal_table, lookup_side, materialize, materialize_counted

CAT_SPECIALS = SPECIALS[:2]


# ------------------------------------------------------------------ vocabularies
def fit_vocab(df: DataFrame, col: str | Column, min_count: int = 1, specials=SPECIALS) -> DataFrame:
    """(value, id, n): specials first, then values by (count desc, value asc) with at least ``min_count`` rows."""
    c = F.col(col) if isinstance(col, str) else col
    counts = df.select(c.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("n") >= min_count) & ~F.col("value").isin(list(specials)))
    ranked = global_rank(counts, [F.desc("n"), F.col("value")], "_r")
    body = ranked.select("value", (F.col("_r") + len(specials)).cast("int").alias("id"), "n")
    head = literal_table(df.sparkSession, [(s, i, None) for i, s in enumerate(specials)], "value string, id int, n long")
    return head.unionByName(body)


def fit_component_vocab(df: DataFrame, family: str, label: str = "activity") -> DataFrame:
    """Vocabulary of label components; counts are over distinct labels, not events."""
    labels = df.select(label).distinct()
    comps = labels.select(F.explode(decompose_activity(label, family)).alias("component"))
    return fit_vocab(comps, "component", 1, CAT_SPECIALS)


def extend_vocab(vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """Append the distinct ``value`` rows of ``labels`` that the vocabulary lacks, ids in sorted order."""
    new = labels.select("value").distinct().join(vocab, "value", "left_anti")
    size = vocab.agg(F.max("id").alias("m")).scalar()
    new = global_rank(new, ["value"], "_r").select("value", (F.col("_r") + size + 1).cast("int").alias("id"), F.lit(0).cast("long").alias("n"))
    return vocab.unionByName(new)


def lookup(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    """Value -> id with the unknown id as default."""
    v = lookup_side(vocab.select(F.col("value").alias(col), F.col("id").alias("_id")), "vocab")
    return df.join(v, col, "left").withColumn(out, F.coalesce("_id", F.lit(UNK))).drop("_id")


def inverse_lookup(df: DataFrame, vocab: DataFrame, col: str, out: str) -> DataFrame:
    v = lookup_side(vocab.select(F.col("id").alias(col), F.col("value").alias(out)), "vocab")
    return df.join(v, col, "left")


def component_table(vocab: DataFrame, comp_vocab: DataFrame, family: str) -> DataFrame:
    """(label id, slot, component id); special labels map to the unknown component."""
    rows = vocab.select("id", "value", F.posexplode(decompose_activity("value", family)).alias("slot", "component"))
    known = comp_vocab.select(F.col("value").alias("component"), F.col("id").alias("_cid"))
    rows = rows.join(lookup_side(known, "components"), "component", "left")
    cid = F.when(F.col("value").isin(SPECIALS), F.lit(UNK)).otherwise(F.coalesce("_cid", F.lit(UNK)))
    return rows.select("id", "slot", cid.alias("component_id"))


def cardinality_flags(df: DataFrame, fields: list[str], min_count: int = 5, limit: int = 255) -> DataFrame:
    """Per field: vocabulary size and whether it is used as a category or as an ordinal number."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")).select("c.*")
    vc = cells.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    size = (F.count(F.lit(1)) + len(CAT_SPECIALS)).alias("size")
    return vc.groupBy("field").agg(size).withColumn("kind", F.when(F.col("size") > limit, "ordinal").otherwise("category"))


# ------------------------------------------------------------------ scalers
def _scaler(x: Column, name: str) -> list[Column]:
    sd = F.stddev_pop(x)
    return [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{name}_mean"),
            F.coalesce(F.when(sd > 1e-8, sd), F.lit(1.0)).alias(f"{name}_std")]


def fit_scalers(train: DataFrame) -> DataFrame:
    """One row of means and population deviations of log1p waiting time, elapsed time and position."""
    gap = F.when(F.col("pos") > 0, F.log1p("dt_s"))
    return train.agg(*_scaler(gap, "dt"), *_scaler(F.log1p("elapsed_s"), "elapsed"), *_scaler(F.log1p(F.col("pos").cast("double")), "pos"))


def fit_case_scalers(cases: DataFrame, fields: list[str]) -> DataFrame:
    return cases.agg(*[c for f in fields for c in _scaler(F.log1p(F.abs(F.col(f"num_{f}"))), f)])


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table as scalar sub-queries (no join)."""
    packed = row.agg(F.first(F.struct(*row.columns)).alias("s")).scalar()
    return df.withColumn("_s", packed)


def time_features(frame: DataFrame, scalers: DataFrame, schema: EventLog) -> DataFrame:
    """z(log1p gap), z(log1p elapsed), sin/cos of local hour and weekday, z(log1p position)."""
    f = _with_row(frame, scalers)
    loc = local_time("ts", schema.zone)
    h, wd = F.hour(loc) * (2 * math.pi / 24), F.weekday(loc) * (2 * math.pi / 7)
    z = lambda x, n: (x - F.col(f"_s.{n}_mean")) / F.col(f"_s.{n}_std")
    return f.withColumns({
        "f_dt": z(F.log1p("dt_s"), "dt"), "f_elapsed": z(F.log1p("elapsed_s"), "elapsed"),
        "f_hour_sin": F.sin(h), "f_hour_cos": F.cos(h), "f_wd_sin": F.sin(wd), "f_wd_cos": F.cos(wd),
        "f_pos": z(F.log1p(F.col("pos").cast("double")), "pos"),
    }).drop("_s")


def synthetic_time(frame: DataFrame, seconds: Column, schema: EventLog) -> DataFrame:
    """Clock features of a generated next event ``seconds`` later, in the log's real zone."""
    ts = F.timestamp_add("MICROSECOND", F.round(seconds * 1e6).cast("long"), F.col("ts"))
    loc = local_time(ts, schema.zone)
    return frame.withColumns({"s_hour": F.hour(loc), "s_weekday": F.weekday(loc)})


def case_numbers(cases: DataFrame, scalers: DataFrame, fields: list[str]) -> DataFrame:
    """(scaled value or 0, missing indicator) per numeric case attribute."""
    c = _with_row(cases, scalers)
    cols = {}
    for f in fields:
        v = F.col(f"num_{f}")
        cols[f"z_{f}"] = F.coalesce((F.log1p(F.abs(v)) - F.col(f"_s.{f}_mean")) / F.col(f"_s.{f}_std"), F.lit(0.0))
        cols[f"m_{f}"] = v.isNull().cast("double")
    return c.withColumns(cols).drop("_s")


def bag_counts(frame: DataFrame, ids: list[int], order=("us", "event_idx")) -> DataFrame:
    """Running count of each label id inside the prefix (inclusive)."""
    from caseloom.operators import sequence as S

    return S.sequence(frame, {f"bag_{i}": S.running_sum((F.col("act") == i).cast("long")) for i in ids}, order=order)


# ------------------------------------------------------------------ the whole preparation
@dataclass
class Prepared:
    """Encoded prefix frame with its split, the label vocabulary and its size."""

    frame: DataFrame
    vocab: DataFrame
    size: int
    order: int
    schema: EventLog

    def part(self, name: str) -> DataFrame:
        return self.frame.where(F.col("split") == name)


def prepare(events: DataFrame, schema: EventLog, split: DataFrame | None = None, order: int = 2, vocab: DataFrame | None = None,
            store: bool = True, **frame_options) -> Prepared:
    """Split, train vocabulary, label ids and targets in one ordered pass over the events.

    ``split`` may be left out when the events carry a ``split`` column (see ``splits.assign_random``).
    The frame is read many times (fit, calibrate, score), so it is written once by default.
    """
    ev = events if split is None else events.join(key_side(split.select("case_id", "split")), "case_id")
    if vocab is None:
        vocab, size = materialize_counted(fit_vocab(ev.where(F.col("split") == "train"), "activity"), "vocab")
    else:
        size = vocab.count()
    frame = prefix_frame(lookup(ev, vocab, "activity", "act"), schema, order=order, **frame_options)
    return Prepared(materialize(frame, "frame") if store else frame, vocab, size, order, schema)
