"""Profiles of event logs.  Every function takes a long event table with a ``log`` column and groups by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions.columns import AUDIT_MISSING_TOKENS, rnd
from caseloom.operators import sequence as S
from caseloom.operators.frame import local_clock
from caseloom.operators.ranking import exact_quantiles
from caseloom.schema import EventLog
from caseloom.session import literal_table, materialize, stage_if_large

QUANTILES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
CASE = ["log", "case_id"]


def _quantile_columns(df: DataFrame, col: str) -> DataFrame:
    cols = {f"p{int(round(q * 100)):02d}": rnd(F.col(col)[i]) for i, q in enumerate(QUANTILES)}
    return df.withColumns(cols).drop(col)


def counts(ev: DataFrame) -> DataFrame:
    return ev.groupBy("log").agg(F.count_distinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_events"))


def activity_histogram(ev: DataFrame) -> DataFrame:
    return ev.groupBy("log", "activity").agg(F.count(F.lit(1)).alias("n"))


def cases(ev: DataFrame) -> DataFrame:
    """Per-case borders as a mergeable aggregate (no sort)."""
    o = F.struct("us", "event_idx")
    return ev.groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min_by("activity", o).alias("first_act"), F.max_by("activity", o).alias("last_act"))


def length_quantiles(ev: DataFrame) -> DataFrame:
    c = ev.groupBy(*CASE).agg(F.count(F.lit(1)).alias("n"))
    return _quantile_columns(exact_quantiles(c, ["log"], "n", QUANTILES, extra=[rnd(F.avg("n")).alias("mean")]), "q")


def duration_quantiles(ev: DataFrame) -> DataFrame:
    c = cases(ev).withColumn("h", (F.col("last_us") - F.col("first_us")) / 1e6 / 3600)
    more = [rnd(F.avg("h")).alias("mean"), F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us")]
    return _quantile_columns(exact_quantiles(c, ["log"], "h", QUANTILES, extra=more), "q")


def border_activities(ev: DataFrame, top: int = 10) -> DataFrame:
    """First-activity histogram (top ``top`` per log) and the whole last-activity histogram."""
    both = cases(ev).select("log", F.explode(F.array(
        F.struct(F.lit("first").alias("border"), F.col("first_act").alias("activity")),
        F.struct(F.lit("last").alias("border"), F.col("last_act").alias("activity")))).alias("b")).select("log", "b.*")
    n = both.groupBy("log", "border", "activity").agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(W.partitionBy("log", "border").orderBy(F.desc("n"), "activity"))
    return n.withColumn("_r", rn).where((F.col("border") == "last") | (F.col("_r") <= top)).drop("_r")


def terminal_share(cs: DataFrame, terminal: dict[str, tuple[str, ...]]) -> DataFrame:
    """Share of cases (see :func:`cases`) whose last activity is terminal in their log."""
    hit = F.lit(False)
    for log, acts in terminal.items():
        hit = hit | ((F.col("log") == log) & F.col("last_act").isin(list(acts)))
    return cs.groupBy("log").agg(rnd(F.avg(hit.cast("double"))).alias("frac_terminal"))


def censoring(cs: DataFrame) -> DataFrame:
    """Cases (see :func:`cases`) ending within 7 / 30 days of their log's end; one row per log joins back, not a product."""
    ends = F.broadcast(cs.groupBy("log").agg(F.max("last_us").alias("end_us")))
    days = (F.col("end_us") - F.col("last_us")) / 1e6 / 86400
    return cs.join(ends, "log").groupBy("log").agg(
        F.count_if(days <= 7).alias("within_7d"), F.count_if(days <= 30).alias("within_30d"))


def gaps(ev: DataFrame) -> DataFrame:
    """Waiting-time quantiles, share of zero gaps."""
    g = S.sequence(ev, {"prev_us": S.lag("us")}, case=CASE).where(F.col("prev_us").isNotNull())
    g = g.select("log", ((F.col("us") - F.col("prev_us")) / 1e6).alias("dt"))
    zero = rnd(F.avg((F.col("dt") == 0).cast("double"))).alias("frac_zero")
    return _quantile_columns(exact_quantiles(g, ["log"], "dt", QUANTILES, extra=[zero]), "q")


def backward_share(ev: DataFrame) -> DataFrame:
    """Share of events earlier than their predecessor in file order; first events count in the denominator."""
    g = S.sequence(ev, {"prev_us": S.lag("us")}, case=CASE, order=("event_idx",))
    back = F.coalesce(F.col("us") < F.col("prev_us"), F.lit(False))
    return g.groupBy("log").agg(rnd(F.avg(back.cast("double"))).alias("frac_backward"))


def clock_profile(ev: DataFrame, schema: EventLog) -> DataFrame:
    c = local_clock(ev, schema)
    hist = F.explode(F.array(
        F.struct(F.lit("weekday").alias("unit"), F.col("weekday").alias("slot")),
        F.struct(F.lit("hour").alias("unit"), F.col("hour").alias("slot"))))
    return c.select("log", hist.alias("h")).select("log", "h.*").groupBy("log", "unit", "slot").agg(F.count(F.lit(1)).alias("n"))


def time_quality(ev: DataFrame, schema: EventLog) -> DataFrame:
    c = local_clock(ev, schema)
    return c.groupBy("log").agg(
        rnd(F.avg(F.col("ts").isNull().cast("double"))).alias("frac_missing_ts"),
        rnd(F.avg(F.coalesce(F.col("midnight"), F.lit(False)).cast("double"))).alias("frac_midnight"))


def midnight_by_activity(ev: DataFrame, schema: EventLog, top: int = 8) -> DataFrame:
    c = local_clock(ev, schema).groupBy("log", "activity").agg(F.avg(F.col("midnight").cast("double")).alias("share"))
    c = c.where(F.col("share") > 0)
    rn = F.row_number().over(W.partitionBy("log").orderBy(F.desc("share"), "activity"))
    return c.withColumn("_r", rn).where(F.col("_r") <= top).select("log", "activity", rnd("share").alias("share"))


# ------------------------------------------------------------------ columns
def long_columns(ev: DataFrame, columns: list[str]) -> DataFrame:
    """(log, case_id, us, event_idx, column, value) - one scan, one row per cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return ev.select("log", "case_id", "us", "event_idx", cells.alias("x")).select("log", "case_id", "us", "event_idx", "x.*")


def value_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("log", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(vc: DataFrame) -> DataFrame:
    """Missing share and cardinality per column from its value counts."""
    missing = F.col("value").isNull() | F.col("value").isin(AUDIT_MISSING_TOKENS)
    return vc.groupBy("log", "column").agg(
        rnd(F.sum(F.when(missing, F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_frac"),
        F.count("value").alias("cardinality"))


def top_values(vc: DataFrame, few: int = 30, many: int = 5) -> DataFrame:
    """Top values per column: ``few`` when the column has at most ``few`` values, else ``many``.

    ``rn <= few`` lets Spark limit each map task's groups before the exchange (window group limit).
    """
    card = vc.groupBy("log", "column").agg(F.count("value").alias("_card"))
    rn = F.row_number().over(W.partitionBy("log", "column").orderBy(F.desc("n"), "value"))
    top = vc.where(F.col("value").isNotNull()).withColumn("_r", rn).where(F.col("_r") <= few)
    top = top.join(card, ["log", "column"]).where((F.col("_card") <= few) | (F.col("_r") <= many))
    return top.select("log", "column", "value", "n")


def rare_share(vc: DataFrame, below: int = 5, high_card: int = 30) -> DataFrame:
    rare = F.when(F.col("value").isNotNull() & (F.col("n") < below), F.col("n")).otherwise(0)
    return vc.groupBy("log", "column").agg(
        F.count("value").alias("cardinality"), rnd(F.sum(rare) / F.sum("n")).alias("rare_share"),
    ).where(F.col("cardinality") > high_card).drop("cardinality")


def constancy(cells: DataFrame) -> DataFrame:
    """Does a column vary inside a case?  min <> max replaces a distinct count, so partial sums combine map-side."""
    o = F.struct("us", "event_idx")
    per = cells.groupBy("log", "case_id", "column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min_by("value", F.when(F.col("value").isNotNull(), o)).alias("first_value"))
    varies = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).cast("double")
    has = F.col("first_value").isNotNull() & ~F.col("first_value").isin(AUDIT_MISSING_TOKENS)
    return per.groupBy("log", "column").agg(
        rnd(F.avg(varies)).alias("varies_frac"), rnd(F.avg(1 - varies)).alias("constant_frac"), F.count_if(has).alias("cases_with_value"))


def leakage(ev: DataFrame, columns: list[str], lo: int = 2, hi: int = 200) -> DataFrame:
    """Mutual information of a case attribute (first non-null value) with the last activity, over the entropy of the latter."""
    o = F.struct("us", "event_idx")
    aggs = [F.max_by("activity", o).alias("y")]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), o)).cast("string").alias(c) for c in columns]
    per_case = ev.groupBy(*CASE).agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns]))
    xy = per_case.select("log", "y", cells.alias("c")).select("log", "y", "c.*").where(F.col("x").isNotNull())
    # a contingency table is small next to the events and is read four times below
    joint = stage_if_large(xy.groupBy("log", "column", "x", "y").agg(F.count(F.lit(1)).alias("n")), "joint")
    tot = joint.groupBy("log", "column").agg(F.sum("n").alias("nt"), F.count_distinct("x").alias("card"))
    tot = tot.where((F.col("card") >= lo) & (F.col("card") <= hi)).select("log", "column", "nt")
    px = joint.groupBy("log", "column", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("log", "column", "y").agg(F.sum("n").alias("ny"))
    k = ["log", "column"]
    mi = joint.join(tot, k).join(px, [*k, "x"]).join(py, [*k, "y"])
    term = F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")).cast("double"))
    mi = mi.groupBy(*k).agg(F.sum(term).alias("mi"))
    h = py.join(tot, k).groupBy(*k).agg((-F.sum(F.col("ny") / F.col("nt") * F.ln(F.col("ny") / F.col("nt")))).alias("h"))
    return mi.join(h, k).select(*k, rnd(F.when(F.col("h") > 0, F.col("mi") / F.col("h")).otherwise(0.0)).alias("nmi"))


# ------------------------------------------------------------------ variants
def variant_keys(ev: DataFrame) -> DataFrame:
    """Order-sensitive fingerprint of each case's activity sequence, without collecting the sequence.

    Two xor sums of hash(position, activity) identify a sequence; they merge map-side, so even a case
    with a large share of all events costs one small row.
    """
    p = S.sequence(ev, {"pos": S.pos()}, case=CASE)
    h = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("pos"), F.col("activity")))
    return p.groupBy(*CASE).agg(F.count(F.lit(1)).alias("len"), h(1).alias("h1"), h(2).alias("h2"))


def variants(ev: DataFrame, top: int = 5, text_events: int = 10_000) -> DataFrame:
    """Per log: number of variants, the ``top`` most frequent ones, and their joint share.

    Ties go to the variant whose first case id comes first.  The text of a variant is read back from that
    one case; variants longer than ``text_events`` keep their row with a null text.
    """
    key = ["log", "len", "h1", "h2"]
    vc = stage_if_large(variant_keys(ev).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("case_id")), "variants")
    tot = vc.groupBy("log").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_cases"))
    rn = F.row_number().over(W.partitionBy("log").orderBy(F.desc("n"), "case_id"))
    best = vc.withColumn("rank", rn).where(F.col("rank") <= top).select("log", "case_id", "rank", "n", "len")
    share = best.groupBy("log").agg(F.sum("n").alias("top_n"))
    short = ev.join(F.broadcast(best.where(F.col("len") <= text_events).select(*CASE)), CASE, "left_semi")  # ``top`` cases per log
    text = short.groupBy(*CASE).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("us", "event_idx", "activity"))), lambda e: e["activity"]), " > ").alias("variant"))
    out = best.join(text, CASE, "left").join(tot, "log").join(share, "log")
    return out.select("log", "rank", "variant", "n", "n_variants", rnd(F.col("top_n") / F.col("n_cases")).alias("top_share"))


def role_lint(ev: DataFrame, schema: EventLog) -> DataFrame:
    """Every raw column with its declared role, or ``unassigned``."""
    spark = ev.sparkSession
    cols = [c for c in ev.columns if c.startswith(("ev_", "case_")) and c != "case_id"]
    roles = literal_table(spark, schema.role_rows(), "column string, role string, reason string")
    prof = column_profile(value_counts(long_columns(ev, cols)))
    return prof.select("log", "column", "cardinality").join(F.broadcast(roles), "column", "left").select(
        "log", "column", "cardinality", F.coalesce("role", F.lit("unassigned")).alias("role"), F.coalesce("reason", F.lit("")).alias("reason"))


def inventory(ev: DataFrame, columns: list[str]) -> DataFrame:
    """Filled cells per (scope, key, type) of the raw attributes."""
    types = dict(ev.dtypes)
    cells = F.explode(F.array(*[
        F.struct(F.lit("case" if c.startswith("case_") else "event").alias("scope"), F.lit(c).alias("key"),
                 F.lit(types[c]).alias("type"), F.col(c).isNotNull().alias("has")) for c in columns]))
    return ev.select("log", cells.alias("c")).select("log", "c.*").where("has").groupBy("log", "scope", "key", "type").agg(F.count(F.lit(1)).alias("n"))


def crosstab(ev: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    out = ev.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    return out.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"n_{v}") for v in values])


def summary(ev: DataFrame, schemas: dict[str, EventLog]) -> DataFrame:
    """One row per log with the headline figures."""
    c = materialize(cases(ev), "cases")  # one pass over the events, then small tables
    per = c.groupBy("log").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("events"))
    acts = ev.groupBy("log").agg(F.count_distinct("activity").alias("activities"))
    nv = variant_keys(ev).groupBy("log").agg(F.count_distinct("len", "h1", "h2").alias("variants"))
    q = exact_quantiles(c.withColumn("n", F.col("n").cast("double")), ["log"], "n", [0.5, 0.95], "lq")
    h = exact_quantiles(c.withColumn("h", (F.col("last_us") - F.col("first_us")) / 1e6 / 3600), ["log"], "h", [0.5, 0.95], "hq")
    t = terminal_share(c, {s.name: s.endings for s in schemas.values()})
    cs = censoring(c).select("log", "within_30d")
    out = per.join(acts, "log").join(nv, "log").join(q, "log").join(h, "log").join(t, "log").join(cs, "log")
    return out.select(
        "log", "cases", "events", "activities", "variants", rnd(F.col("lq")[0]).alias("len_p50"), rnd(F.col("lq")[1]).alias("len_p95"),
        rnd(F.col("hq")[0]).alias("hours_p50"), rnd(F.col("hq")[1]).alias("hours_p95"), "frac_terminal", "within_30d")
