"""Event-log files (XES XML, plain or gzip) as tables: traces are rows of Spark's XML source.

The schema is explicit (inference flips struct/array with cardinality).  A gzip file is one split, so
parallelism equals the number of files; the event rows are spread again after the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from caseloom.functions.columns import epoch_us
from caseloom.operators.sparse import bind

TYPES = ["string", "date", "int", "float", "boolean", "id"]
_LEAF = "struct<_key:string,_value:string>"
_ATTR = f"array<struct<_key:string,_value:string,{','.join(f'{t}:array<{_LEAF}>' for t in TYPES)}>>"
_EVENT = f"array<struct<{','.join(f'{t}:{_ATTR}' for t in TYPES)}>>"
TRACE = ", ".join(f"{t} {_ATTR}" for t in TYPES) + f", event {_EVENT}"


def _children(arr: Column, child: str) -> Column:
    """``parent.child`` pairs of one nested attribute type."""
    def of(parent: Column) -> Column:
        inner = F.coalesce(parent.getField(child), F.array())
        return F.transform(inner, lambda x: F.struct(F.concat(parent["_key"], F.lit("."), x["_key"]).alias("key"), x["_value"].alias("value")))

    return F.flatten(F.transform(arr, of))


def _entries(get) -> Column:
    """(key, value) pairs of one element: direct attributes, then children as ``parent.child``.

    Types an element lacks and attributes without children are passed over: most are.
    """
    none = F.array().cast("array<struct<key:string,value:string>>")
    flat = []
    for t in TYPES:
        arr = get(t)
        direct = F.transform(arr, lambda a: F.struct(a["_key"].alias("key"), a["_value"].alias("value")))
        nested = F.exists(arr, lambda a: F.coalesce(*[a[c] for c in TYPES]).isNotNull())
        children = F.when(nested, F.concat(*[_children(arr, c) for c in TYPES])).otherwise(none)
        flat.append(F.when(arr.isNull(), none).otherwise(F.concat(direct, children)))
    return F.concat(*flat)


def _as_map(entries: Column) -> Column:
    """Map of the pairs, the last one winning on a repeated key; the pairs are built once."""
    def build(named: Column) -> Column:
        last = lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"]
        return bind(F.array_distinct(F.transform(named, lambda e: e["key"])), lambda keys: F.map_from_arrays(keys, F.transform(keys, last)))

    return bind(F.filter(entries, lambda e: e["key"].isNotNull()), build)


def read_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(trace_idx, cs map, event array): traces in file order."""
    raw = spark.read.format("xml").option("rowTag", "trace").schema(TRACE).load(path)
    t = raw.withColumn("_mid", F.monotonically_increasing_id())
    t = t.withColumns({"_part": F.shiftright("_mid", 33), "_i": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per file split
    offsets = t.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_off"))
    t = t.join(F.broadcast(offsets), "_part")
    return t.select((F.col("_off") + F.col("_i")).alias("trace_idx"), _as_map(_entries(lambda t_: F.col(f"`{t_}`"))).alias("cs"), "event")


def read_events(spark: SparkSession, path: str | list[str], log: str, max_traces: int | None = None, repartition: int | None = None) -> DataFrame:
    """Flat events: log, case_id, event_idx (file order in the trace), ts, us, ``ev`` and ``cs`` maps of raw texts."""
    t = read_traces(spark, path)
    if max_traces is not None:
        t = t.where(F.col("trace_idx") < max_traces)
    case = F.coalesce(F.try_element_at("cs", F.lit("concept:name")), F.concat(F.lit("__trace_"), F.col("trace_idx").cast("string")))
    e = t.select(case.alias("case_id"), "cs", F.posexplode("event").alias("event_idx", "e"))
    e = e.select(F.lit(log).alias("log"), "case_id", F.col("event_idx").cast("long").alias("event_idx"), "cs", _as_map(_entries(lambda t_: F.col("e")[t_])).alias("ev"))
    if repartition:
        e = e.repartition(repartition)
    ts = F.try_to_timestamp(F.try_element_at("ev", F.lit("time:timestamp")))
    e = e.withColumn("ts", F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")))
    return e.withColumn("us", epoch_us("ts"))


def project(events: DataFrame, ev_keys: list[str], cs_keys: list[str]) -> DataFrame:
    """Chosen attributes as ``ev_<key>`` / ``case_<key>`` text columns (absent keys are null)."""
    cols = [F.try_element_at("ev", F.lit(k)).alias(f"ev_{k}") for k in ev_keys]
    cols += [F.try_element_at("cs", F.lit(k)).alias(f"case_{k}") for k in cs_keys]
    return events.select("log", "case_id", "event_idx", "ts", "us", *cols)


def read_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: log attributes (``meta_*`` left out), globals by scope, classifiers.

    Records end at the first trace tag, so only the text before it is parsed as a document.
    """
    head = spark.read.option("lineSep", "<trace").text(path).withColumn("file", F.col("_metadata.file_path"))
    head = head.where(F.instr("value", "<log") > 0)
    body = F.substring(F.col("value"), F.instr("value", "<log"), F.length("value"))
    doc = F.when(F.instr(body, "</log>") > 0, body).otherwise(F.concat(body, F.lit("</log>")))
    h = head.select("file", doc.alias("x"))

    def pairs(where: str) -> Column:
        each = [F.arrays_zip(F.xpath("x", F.lit(f"{where}/{t}/@key")).alias("key"), F.xpath("x", F.lit(f"{where}/{t}/@value")).alias("value")) for t in TYPES]
        return F.concat(*each)

    attrs = F.filter(pairs("/log"), lambda e: ~e["key"].startswith("meta_"))
    classifiers = F.map_from_arrays(F.xpath("x", F.lit("/log/classifier/@name")), F.transform(F.xpath("x", F.lit("/log/classifier/@keys")), lambda k: F.split(F.trim(k), r"\s+")))
    return h.select("file", _as_map(attrs).alias("log_attrs"), _as_map(pairs("/log/global[@scope='event']")).alias("globals_event"),
                    _as_map(pairs("/log/global[@scope='trace']")).alias("globals_trace"), classifiers.alias("classifiers"))


def cell_inventory(events: DataFrame) -> DataFrame:
    """Filled attribute counts per (scope, key) of a raw log."""
    e = events.select(F.lit("event").alias("scope"), F.explode(F.map_keys("ev")).alias("key"))
    firsts = events.where(F.col("event_idx") == 0).select(F.lit("case").alias("scope"), F.explode(F.map_keys("cs")).alias("key"))
    return e.unionByName(firsts).groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n"))
