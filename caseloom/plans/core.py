"""Projections, filters, ordering: P*, S3, S4, W*, K*, J3, J12, J13, U-set*."""

from pyspark.sql import Window as W, functions as F

from caseloom.functions.columns import (activity_label, clean, decompose_activity, hash_unit, numeric, rnd)
from caseloom.functions.text import truncate_text
from caseloom.operators import audit, frame as fr, sequence as S
from caseloom.operators.ranking import best_per_group, top_k
from caseloom.plans import sqltext as q
from caseloom.plans.registry import query
from caseloom.schema import CLICKS, ORDERS
from caseloom.sources import tables as t

A, B, C = q.frame("a"), q.frame("b"), q.frame("c")


@query("s3_trace_limit", q.with_(q.B_RAW, "f AS (SELECT case_id, min(event_idx) AS m FROM b_raw GROUP BY 1 ORDER BY 2, 1 LIMIT 100)")
       + "SELECT case_id, count(*) AS n FROM b_raw SEMI JOIN f USING (case_id) GROUP BY 1")
def s3(spark, d):
    return t.limit_cases(t.orders(spark, d), 100).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("s4_inventory", q.with_(q.B_RAW) + """SELECT 'orders' AS log, scope, key, type, count(*) AS n FROM (
 SELECT unnest([{'scope':'event','key':'ev_status','type':'string','v':ev_status}, {'scope':'event','key':'ev_priority','type':'string','v':ev_priority},
 {'scope':'event','key':'ev_price','type':'double','v':CAST(ev_price AS VARCHAR)}, {'scope':'case','key':'case_segment','type':'string','v':case_segment},
 {'scope':'case','key':'case_balance','type':'double','v':CAST(case_balance AS VARCHAR)}, {'scope':'case','key':'case_nation','type':'string','v':case_nation}], recursive := true)
 FROM b_raw) WHERE v IS NOT NULL GROUP BY ALL""")
def s4(spark, d):
    return audit.inventory(t.orders(spark, d), ["ev_status", "ev_priority", "ev_price", "case_segment", "case_balance", "case_nation"])


@query("p1_activity_label", "SELECT o_orderkey, coalesce(o_orderstatus,'') || '|' || coalesce(o_orderpriority,'') AS activity FROM orders")
def p1(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", activity_label("o_orderstatus", "o_orderpriority").alias("activity"))


@query("p2_clean", """SELECT doc_id, CASE WHEN lang IS NULL OR lang IN ('','UNKNOWN','UNDEFINED','nan','None','-','<NA>') THEN '<MISSING>' ELSE lang END AS lang,
 CASE WHEN quality IS NULL THEN '<MISSING>' ELSE CAST(quality AS VARCHAR) END AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def p2(spark, d):
    docs, lab = t.table(spark, d, "documents"), t.table(spark, d, "labels")
    return docs.select("doc_id", "lang").join(lab.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", clean("lang").alias("lang"), clean("quality").alias("quality"))


@query("p3_case_numeric", q.with_(q.B_RAW, q.cases("b")) + "SELECT case_id, num_balance FROM b_cases")
def p3(spark, d):
    return fr.case_table(t.orders(spark, d), ORDERS).select("case_id", "num_balance")


@query("p4_case_categorical", q.with_(q.B_RAW, q.cases("b")) + "SELECT case_id, case_segment, case_nation FROM b_cases")
def p4(spark, d):
    return fr.case_table(t.orders(spark, d), ORDERS).select("case_id", "case_segment", "case_nation")


@query("p5_epoch", "SELECT event_id, epoch_us(ts) / 1e6 AS epoch_s FROM events")
def p5(spark, d):
    return t.clicks(spark, d).select(F.col("event_idx").alias("event_id"), (F.col("us") / 1e6).alias("epoch_s"))


_LOC = "timezone('Europe/Amsterdam', timezone('UTC', ts))"


@query("p6_local_clock", f"SELECT event_id, hour(l) AS hour, isodow(l) - 1 AS weekday, (hour(l) = 0 AND minute(l) = 0 AND floor(second(l)) = 0) AS midnight FROM (SELECT event_id, {_LOC} AS l FROM events)")
def p6(spark, d):
    return fr.local_clock(t.clicks(spark, d), CLICKS).select(F.col("event_idx").alias("event_id"), "hour", "weekday", "midnight")


@query("p7_case_order", q.with_(B) + "SELECT event_idx, case_id, pos FROM b")
def p7(spark, d):
    return S.sequence(t.orders(spark, d), {"pos": S.pos()}).select("event_idx", "case_id", "pos")


@query("p8_components", q.with_(q.B_RAW) + """SELECT event_idx, 'status=' || split_part(activity, '|', 1) || ';sub=' || substr(activity, strpos(activity, '|') + 1) AS components FROM b_raw""")
def p8(spark, d):
    return t.orders(spark, d).select("event_idx", F.array_join(decompose_activity("activity", "status"), ";").alias("components"))


@query("p9_completeness", q.with_(q.A_RAW, q.cases("a")) + "SELECT case_id, n, last_act, complete FROM a_cases")
def p9(spark, d):
    return fr.case_table(t.clicks(spark, d), CLICKS).select("case_id", "n", "last_act", "complete")


@query("p10_assume_complete", q.with_(q.frame("a", complete="true")) + "SELECT event_idx, y, y_rem FROM a")
def p10(spark, d):
    return fr.prefix_frame(t.clicks(spark, d), CLICKS, assume_complete=True).select("event_idx", "y", "y_rem")


@query("p11_min_length", q.with_(q.B_RAW) + "SELECT case_id, event_idx FROM b_raw QUALIFY count(*) OVER (PARTITION BY case_id) >= 10")
def p11(spark, d):
    return fr.prefix_frame(t.orders(spark, d), ORDERS, min_len=10).select("case_id", "event_idx")


@query("p12_length_cap", q.with_(q.frame("b", max_len=4)) + "SELECT event_idx, pos, n, complete, y FROM b")
def p12(spark, d):
    return fr.prefix_frame(t.orders(spark, d), ORDERS, max_len=4).select("event_idx", "pos", "n", "complete", "y")


_CUT = "852076800000000"  # 1997-01-01 in microseconds


@query("p13_time_cutoff", q.with_(B) + f""", k AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS kept,
 lead(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS na FROM b WHERE us < {_CUT})
SELECT event_idx, kept AS n, complete AND kept = n AS complete, coalesce(na, CASE WHEN complete AND kept = n THEN '<EOS>' END) AS y FROM k""")
def p13(spark, d):
    f = fr.prefix_frame(t.orders(spark, d), ORDERS, cutoff_us=F.lit(int(_CUT)))
    return f.select("event_idx", "n", "complete", "y")


@query("p14_prefixes", q.with_(A) + """SELECT case_id, pos, pos + 1 AS prefix_len, activity AS last1, prev1 AS last2, prev2 AS last3, pos < n - 1 AS has_suffix FROM a""")
def p14(spark, d):
    """Every event is a prefix; its length and last labels identify what a scorer sees (no growing arrays)."""
    f = fr.prefix_frame(t.clicks(spark, d), CLICKS, order=3)
    return f.select("case_id", "pos", (F.col("pos") + 1).alias("prefix_len"), F.col("activity").alias("last1"), F.col("prev1").alias("last2"),
                    F.col("prev2").alias("last3"), (F.col("pos") < F.col("n") - 1).alias("has_suffix"))


@query("p15_drop_event", q.with_(A) + """, m AS (SELECT case_id, min(pos) AS p FROM a WHERE activity = 'error' GROUP BY 1),
k AS (SELECT a.case_id, a.event_idx, a.us, a.activity FROM a LEFT JOIN m ON a.case_id = m.case_id WHERE p IS NULL OR pos <> p)
SELECT case_id, event_idx, row_number() OVER w - 1 AS pos, lag(activity) OVER w AS prev1 FROM k WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)""")
def p15(spark, d):
    f = fr.prefix_frame(t.clicks(spark, d), CLICKS)
    first = f.where(F.col("activity") == "error").groupBy("case_id").agg(F.min("pos").alias("_p"))
    f = f.join(first, "case_id", "left")
    return fr.drop_event(f, F.coalesce(F.col("pos") == F.col("_p"), F.lit(False))).select("case_id", "event_idx", "pos", "prev1")


@query("p17_attribute_dropout", f"SELECT event_id, CASE WHEN {q.unit(7, 'event_id')} < 0.15 THEN '<UNK>' ELSE regexp_extract(props, '\"k\": ?([0-9]+)', 1) END AS ev_k FROM events")
def p17(spark, d):
    return t.clicks(spark, d).select(F.col("event_idx").alias("event_id"),
                                     F.when(hash_unit(7, "event_idx") < 0.15, "<UNK>").otherwise(F.col("ev_k")).alias("ev_k"))


@query("p18_truncate_text", "SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || '...[truncated ' || (length(text) - 1500) || ' chars]' ELSE text END AS text FROM documents")
def p18(spark, d):
    return t.table(spark, d, "documents").select("doc_id", truncate_text("text", 1500).alias("text"))


# ------------------------------------------------------------------ joins, windows, top-k, sets
@query("j3_value_frequency", q.with_(q.A_RAW) + "SELECT event_idx, ev_k, count(*) OVER (PARTITION BY ev_k) AS freq FROM a_raw")
def j3(spark, d):
    ev = t.clicks(spark, d)
    vc = ev.groupBy(F.col("ev_k").alias("_value")).agg(F.count(F.lit(1)).alias("freq"))  # a hot value is one row on this side
    return ev.join(vc, F.col("ev_k").eqNullSafe(F.col("_value"))).select("event_idx", "ev_k", "freq")  # null is a value, too


@query("j1_split_membership", q.with_(q.A_RAW, q.split_cte("a")) + "SELECT split, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM a_raw JOIN a_split USING (case_id) GROUP BY 1")
def j1(spark, d):
    from caseloom.operators.splits import assign_random

    return assign_random(t.clicks(spark, d)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("case_id").alias("n_cases"))


@query("w2_first_last", q.with_(q.B_RAW, q.cases("b")) + "SELECT case_id, first_act, last_act FROM b_cases")
def w2(spark, d):
    return fr.case_table(t.orders(spark, d), ORDERS).select("case_id", "first_act", "last_act")


@query("w1_lag_lead", q.with_(A) + "SELECT event_idx, prev1, next_act, (us - prev_us) / 1e6 AS back_s, (next_us - us) / 1e6 AS ahead_s FROM a")
def w1(spark, d):
    ev = t.clicks(spark, d)
    s = S.sequence(ev, {"prev1": S.lag("activity"), "next_act": S.lead("activity"), "prev_us": S.lag("us"), "next_us": S.lead("us")})
    return s.select("event_idx", "prev1", "next_act", ((F.col("us") - F.col("prev_us")) / 1e6).alias("back_s"),
                    ((F.col("next_us") - F.col("us")) / 1e6).alias("ahead_s"))


@query("w3_row_number", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem""")
def w3(spark, d):
    li = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return S.sequence(li, {"pos": S.pos()}, case="l_orderkey", order=("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos")


@query("w4_running_counts", q.with_(A) + """SELECT event_idx, count(*) FILTER (activity = 'error') OVER (PARTITION BY case_id ORDER BY pos) AS n_error,
 count(*) FILTER (activity = 'error') OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_error_before FROM a""")
def w4(spark, d):
    err = (F.col("activity") == "error").cast("long")
    return S.sequence(t.clicks(spark, d), {"n_error": S.running_sum(err), "n_error_before": S.running_sum(err, inclusive=False)}).select(
        "event_idx", "n_error", "n_error_before")


@query("w5_running_max", q.with_(q.A_RAW) + "SELECT event_idx, max(ev_value) OVER (PARTITION BY case_id ORDER BY us, event_idx) AS high FROM a_raw")
def w5(spark, d):
    return S.sequence(t.clicks(spark, d), {"high": S.running_max("ev_value")}).select("event_idx", "high")


@query("w6_marked_distance", q.with_(A) + """SELECT event_idx, pos - max(CASE WHEN activity = 'error' THEN pos END) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_last,
 pos - min(CASE WHEN activity = 'error' THEN pos END) OVER (PARTITION BY case_id) AS since_first FROM a""")
def w6(spark, d):
    ev = S.sequence(t.clicks(spark, d), {"pos": S.pos()})
    marked = F.when(F.col("activity") == "error", F.col("pos"))
    firsts = ev.groupBy("case_id").agg(F.min(marked).alias("_first"))
    s = S.sequence(ev, {"_last": S.last_seen(marked, inclusive=False)}).join(firsts, "case_id")
    return s.select("event_idx", (F.col("pos") - F.col("_last")).alias("since_last"), (F.col("pos") - F.col("_first")).alias("since_first"))


@query("w7_previous_text", q.with_(C) + """SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, lag(text, 1, '<start>') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations""".replace("CAST(conv_id AS BIGINT) AS conv_id", "conv_id"))
def w7(spark, d):
    s = S.sequence(t.table(spark, d, "conversations"), {"before": S.lag("text")}, case="conv_id", order=("turn",))
    return s.select("conv_id", "turn", F.coalesce("before", F.lit("<start>")).alias("before"))


@query("w8_best_in_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def w8(spark, d):
    return best_per_group(t.table(spark, d, "orders"), ["o_custkey"], F.struct(-F.col("o_totalprice"), F.col("o_orderkey")), ["o_orderkey", "o_totalprice"])


@query("w9_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w9(spark, d):
    rn = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))  # rn <= 3 is limited per map task
    return t.table(spark, d, "conversations").withColumn("_r", rn).where(F.col("_r") <= 3).select("conv_id", "turn", "role")


@query("k1_top_values", q.with_(q.A_RAW) + "SELECT ev_k, count(*) AS n FROM a_raw GROUP BY 1 ORDER BY n DESC, ev_k LIMIT 5")
def k1(spark, d):
    return top_k(t.clicks(spark, d).groupBy("ev_k").agg(F.count(F.lit(1)).alias("n")), 5, F.desc("n"), F.col("ev_k"))


@query("uset1_union_logs", "SELECT 'clicks' AS log, count(*) AS n, count(event_type) AS n_type, 0 AS n_role FROM events UNION ALL SELECT 'dialogs', count(*), 0, count(role) FROM conversations")
def uset1(spark, d):
    u = t.clicks(spark, d).unionByName(t.dialogs(spark, d), allowMissingColumns=True)
    return u.groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.count("ev_type").alias("n_type"), F.count("ev_role").alias("n_role"))


@query("uset2_intersect", "SELECT CAST(user_id AS VARCHAR) AS id FROM events INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def uset2(spark, d):
    return t.clicks(spark, d).select(F.col("case_id").alias("id")).intersect(
        t.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id")))


@query("uset3_unseen", q.with_(A, q.split_cte("a")) + """, v AS (SELECT DISTINCT ev_k FROM a JOIN a_split USING (case_id) WHERE split = 'val')
SELECT count(*) AS n, count(*) FILTER (ev_k NOT IN (SELECT ev_k FROM v)) AS n_unseen FROM a JOIN a_split USING (case_id) WHERE split = 'test'""")
def uset3(spark, d):
    from caseloom.operators.splits import assign_random

    ev = assign_random(t.clicks(spark, d))
    known = ev.where(F.col("split") == "val").select("ev_k", F.lit(1).alias("_k")).distinct()
    return ev.where(F.col("split") == "test").join(known, "ev_k", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_k").isNull()).alias("n_unseen"))


@query("uset4_key_union", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def uset4(spark, d):
    return t.table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
