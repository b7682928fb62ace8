"""Adapters that read relational tables as event logs.

Every log has ``log, case_id, event_idx, ts`` (zone-less UTC), ``us`` (epoch microseconds),
``ev_*`` / ``case_*`` attributes and ``activity``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.functions.columns import activity_label, epoch_us
from caseloom.schema import CLICKS, DIALOGS, ORDERS, EventLog
from caseloom.session import key_side


# Declared, not inferred: opening a table starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def with_activity(df: DataFrame, schema: EventLog) -> DataFrame:
    return df.withColumns({
        "log": F.lit(schema.name),
        "activity": activity_label(*[f"ev_{k}" for k in schema.of("activity")]),
        "us": epoch_us("ts"),
    })


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("event_idx"), "ts",
        F.col("event_type").alias("ev_type"), F.col("value").alias("ev_value"),
        F.get_json_object("props", "$.k").alias("ev_k"),
    )
    return with_activity(ev, CLICKS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("_c"), F.col("o_orderkey").alias("event_idx"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("ev_status"), F.col("o_orderpriority").alias("ev_priority"),
        F.col("o_totalprice").alias("ev_price"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("_c"), F.col("c_mktsegment").alias("case_segment"),
        F.col("c_acctbal").alias("case_balance"), F.col("c_nationkey").cast("string").alias("case_nation"),
    )
    ev = o.join(key_side(c), "_c").withColumn("case_id", F.col("_c").cast("string")).drop("_c")
    return with_activity(ev, ORDERS)


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("turn").alias("event_idx"),
        F.timestamp_add("SECOND", F.col("turn"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")).alias("ts"),
        F.col("role").alias("ev_role"),
    )
    return with_activity(ev, DIALOGS)


READERS = {"clicks": clicks, "orders": orders, "dialogs": dialogs}


def read_log(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return READERS[name](spark, sf_dir)


def limit_cases(df: DataFrame, n: int) -> DataFrame:
    """The first n cases in file order (by their first ``event_idx``), with all their events."""
    firsts = df.groupBy("case_id").agg(F.min("event_idx").alias("_f")).orderBy("_f", "case_id").limit(n)
    return df.join(firsts.select("case_id"), "case_id", "left_semi")
