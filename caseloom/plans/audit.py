"""Audit queries A1-A19 over the three logs together."""

from dataclasses import replace

from pyspark.sql import functions as F

from caseloom.operators import audit
from caseloom.plans import sqltext as q
from caseloom.plans.registry import query
from caseloom.schema import LOGS, ORDERS, CLICKS
from caseloom.sources import tables as t

COLS = ["log", "case_id", "event_idx", "ts", "us", "activity"]
EV = q.A_RAW + ",\n" + q.B_RAW + ",\n" + q.C_RAW + """, ev AS (SELECT 'clicks' AS log, case_id, event_idx, ts, us, activity FROM a_raw
 UNION ALL SELECT 'orders', case_id, event_idx, ts, us, activity FROM b_raw UNION ALL SELECT 'dialogs', case_id, event_idx, ts, us, activity FROM c_raw)"""
CASES = EV + """, cs AS (SELECT log, case_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(activity, (us, event_idx)) AS first_act,
 arg_max(activity, (us, event_idx)) AS last_act FROM ev GROUP BY 1, 2)"""
TERM = "((log = 'clicks' AND last_act = 'purchase') OR (log = 'orders' AND last_act LIKE 'F|%') OR (log = 'dialogs' AND last_act = 'assistant'))"
LEN = q.with_(EV)
PS = [("p00", 0), ("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95), ("p99", .99), ("p100", 1)]


def quant(col: str) -> str:
    return ", ".join(f"round(quantile_cont(CAST({col} AS DOUBLE), {p}), 6) AS {n}" for n, p in PS)


def all_logs(spark, d):
    out = t.clicks(spark, d).select(*COLS)
    return out.unionByName(t.orders(spark, d).select(*COLS)).unionByName(t.dialogs(spark, d).select(*COLS))


query("a1_counts", LEN + "SELECT log, count(DISTINCT case_id) AS n_cases, count(*) AS n_events FROM ev GROUP BY 1")(
    lambda s, d: audit.counts(all_logs(s, d)))
query("a2_activity_histogram", LEN + "SELECT log, activity, count(*) AS n FROM ev GROUP BY 1, 2")(
    lambda s, d: audit.activity_histogram(all_logs(s, d)))
query("a3_case_length", q.with_(CASES) + f"SELECT log, {quant('n')}, round(avg(n), 6) AS mean FROM cs GROUP BY 1")(
    lambda s, d: audit.length_quantiles(all_logs(s, d)))
query("a4_case_duration", q.with_(CASES) + f", h AS (SELECT *, (last_us - first_us) / 1e6 / 3600 AS h FROM cs) SELECT log, {quant('h')}, round(avg(h), 6) AS mean, min(first_us) AS start_us, max(last_us) AS end_us FROM h GROUP BY 1")(
    lambda s, d: audit.duration_quantiles(all_logs(s, d)))
query("a5_border_activities", q.with_(CASES) + """, b AS (SELECT log, 'first' AS border, first_act AS activity, count(*) AS n FROM cs GROUP BY ALL
 UNION ALL SELECT log, 'last', last_act, count(*) FROM cs GROUP BY ALL)
SELECT * FROM b QUALIFY border = 'last' OR row_number() OVER (PARTITION BY log, border ORDER BY n DESC, activity) <= 10""")(
    lambda s, d: audit.border_activities(all_logs(s, d)))
query("a6_terminal_share", q.with_(CASES) + f"SELECT log, round(avg(CASE WHEN {TERM} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_terminal FROM cs GROUP BY 1")(
    lambda s, d: audit.terminal_share(audit.cases(all_logs(s, d)), {k: v.endings for k, v in LOGS.items()}))
query("a7_censoring", q.with_(CASES) + """SELECT log, count(*) FILTER (d <= 7) AS within_7d, count(*) FILTER (d <= 30) AS within_30d FROM
 (SELECT log, (max(last_us) OVER (PARTITION BY log) - last_us) / 1e6 / 86400 AS d FROM cs) GROUP BY 1""")(
    lambda s, d: audit.censoring(audit.cases(all_logs(s, d))))
query("a8_gaps", LEN + f""", g AS (SELECT log, (us - lag(us) OVER (PARTITION BY log, case_id ORDER BY us, event_idx)) / 1e6 AS dt FROM ev)
SELECT log, {quant('dt')}, round(avg(CASE WHEN dt = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_zero FROM g WHERE dt IS NOT NULL GROUP BY 1""")(
    lambda s, d: audit.gaps(all_logs(s, d)))
query("a9_backward_share", LEN + """, g AS (SELECT log, us < lag(us) OVER (PARTITION BY log, case_id ORDER BY event_idx) AS b FROM ev)
SELECT log, round(avg(CASE WHEN b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_backward FROM g GROUP BY 1""")(
    lambda s, d: audit.backward_share(all_logs(s, d)))
_LOC = EV + ", l AS (SELECT *, timezone('Europe/Amsterdam', timezone('UTC', ts)) AS loc FROM ev), m AS (SELECT *, (hour(loc) = 0 AND minute(loc) = 0 AND floor(second(loc)) = 0) AS mid FROM l)"
query("a10_clock_histogram", q.with_(_LOC) + "SELECT log, 'hour' AS unit, hour(loc) AS slot, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT log, 'weekday', isodow(loc) - 1, count(*) FROM l GROUP BY ALL")(
    lambda s, d: audit.clock_profile(all_logs(s, d), ORDERS))
query("a10_time_quality", q.with_(_LOC) + "SELECT log, round(avg(CASE WHEN ts IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_missing_ts, round(avg(CASE WHEN mid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_midnight FROM m GROUP BY 1")(
    lambda s, d: audit.time_quality(all_logs(s, d), ORDERS))
# order dates are midnights of the stored clock, so this one reads the zone as stored
query("a11_midnight_by_activity", LEN + """SELECT log, activity, round(share, 6) AS share FROM (SELECT log, activity, avg(CASE WHEN ts = date_trunc('day', ts) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
 FROM ev GROUP BY 1, 2) WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY log ORDER BY share DESC, activity) <= 8""")(
    lambda s, d: audit.midnight_by_activity(all_logs(s, d).where(F.col("ts").isNotNull()), replace(ORDERS, zone="UTC")))

_BC = ["ev_status", "ev_priority", "case_segment", "case_nation", "case_balance"]
_VC = q.B_RAW + """, cells AS (SELECT case_id, us, event_idx, unnest([{'column':'ev_status','value':ev_status},{'column':'ev_priority','value':ev_priority},
 {'column':'case_segment','value':case_segment},{'column':'case_nation','value':case_nation},{'column':'case_balance','value':CAST(case_balance AS VARCHAR)}], recursive := true) FROM b_raw),
 vc AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY 1, 2)"""


def cells(s, d):
    return audit.long_columns(t.orders(s, d), _BC)


query("a12_column_profile", q.with_(_VC) + """SELECT 'orders' AS log, "column", round(sum(CASE WHEN value IS NULL OR value IN ('','UNKNOWN','UNDEFINED','nan','None','-') THEN n ELSE 0 END) / sum(n), 6) AS missing_frac, count(value) AS cardinality FROM vc GROUP BY "column" """)(
    lambda s, d: audit.column_profile(audit.value_counts(cells(s, d))))
query("a12_top_values", q.with_(_VC) + """SELECT 'orders' AS log, "column", value, n FROM (SELECT *, count(value) OVER (PARTITION BY "column") AS card, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM vc)
 WHERE "column" <> 'case_balance' AND (r <= 5 OR (card <= 30 AND r <= 30))""")(
    lambda s, d: audit.top_values(audit.value_counts(cells(s, d).where(F.col("column") != "case_balance"))))
query("a13_constancy", q.with_(_VC) + """, p AS (SELECT case_id, "column", count(DISTINCT value) AS k, arg_min(value, (us, event_idx)) FILTER (value IS NOT NULL) AS f FROM cells GROUP BY 1, 2)
SELECT 'orders' AS log, "column", round(avg(CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS varies_frac, round(avg(CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS constant_frac,
 count(*) FILTER (f IS NOT NULL AND f NOT IN ('','UNKNOWN','UNDEFINED','nan','None','-')) AS cases_with_value FROM p GROUP BY "column" """)(
    lambda s, d: audit.constancy(cells(s, d)))
query("a14_rare_share", q.with_(q.A_RAW) + """, vc AS (SELECT ev_k AS value, count(*) AS n FROM a_raw GROUP BY 1) SELECT 'clicks' AS log, 'ev_k' AS "column", round(sum(CASE WHEN n < 95 THEN n ELSE 0 END) / sum(n), 6) AS rare_share FROM vc""")(
    lambda s, d: audit.rare_share(audit.value_counts(audit.long_columns(t.clicks(s, d), ["ev_k"])), below=95))
query("a15_leakage", q.with_(q.B_RAW) + """, pc AS (SELECT case_id, arg_max(activity, (us, event_idx)) AS y, arg_min(case_segment, (us, event_idx)) FILTER (case_segment IS NOT NULL) AS s,
 arg_min(case_nation, (us, event_idx)) FILTER (case_nation IS NOT NULL) AS na FROM b_raw GROUP BY 1),
xy AS (SELECT 'case_segment' AS "column", s AS x, y FROM pc WHERE s IS NOT NULL UNION ALL SELECT 'case_nation', na, y FROM pc WHERE na IS NOT NULL),
j AS (SELECT "column", x, y, CAST(count(*) AS DOUBLE) AS n FROM xy GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS nt, sum(n) OVER (PARTITION BY "column", x) AS nx, sum(n) OVER (PARTITION BY "column", y) AS ny FROM j)
SELECT 'orders' AS log, k."column", round(any_value(mi) / any_value(h), 6) AS nmi FROM k
 JOIN (SELECT "column", sum(n / nt * ln(n * nt / (nx * ny))) AS mi FROM k GROUP BY 1) USING ("column")
 JOIN (SELECT "column", -sum(p * ln(p)) AS h FROM (SELECT DISTINCT "column", y, ny / nt AS p FROM k) GROUP BY 1) USING ("column") GROUP BY 2""")(
    lambda s, d: audit.leakage(t.orders(s, d), ["case_segment", "case_nation"]))
query("a16_variants", LEN + """, v AS (SELECT log, case_id, string_agg(activity, ' > ' ORDER BY us, event_idx) AS variant FROM ev GROUP BY 1, 2),
 c AS (SELECT log, variant, count(*) AS n, min(case_id) AS fc FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY n DESC, fc) AS rank, count(*) OVER (PARTITION BY log) AS n_variants, sum(n) OVER (PARTITION BY log) AS nc FROM c)
SELECT log, rank, variant, n, n_variants, round(sum(n) OVER (PARTITION BY log) / nc, 6) AS top_share FROM r WHERE rank <= 5""")(
    lambda s, d: audit.variants(all_logs(s, d)))
query("a17_summary", q.with_(CASES) + f""", v AS (SELECT log, case_id, string_agg(activity, '>' ORDER BY us, event_idx) AS v FROM ev GROUP BY 1, 2),
 e AS (SELECT log, max(us) AS e FROM ev GROUP BY 1)
SELECT log, count(*) AS cases, sum(n)::BIGINT AS events, (SELECT count(DISTINCT activity) FROM ev WHERE ev.log = cs.log) AS activities, (SELECT count(DISTINCT v) FROM v WHERE v.log = cs.log) AS variants,
 round(quantile_cont(n::DOUBLE, .5), 6) AS len_p50, round(quantile_cont(n::DOUBLE, .95), 6) AS len_p95, round(quantile_cont((last_us - first_us) / 1e6 / 3600, .5), 6) AS hours_p50,
 round(quantile_cont((last_us - first_us) / 1e6 / 3600, .95), 6) AS hours_p95, round(avg(CASE WHEN {TERM} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS frac_terminal, count(*) FILTER ((e - last_us) / 1e6 / 86400 <= 30) AS within_30d
FROM cs JOIN e USING (log) GROUP BY log""")(
    lambda s, d: audit.summary(all_logs(s, d), LOGS))
query("a18_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")(
    lambda s, d: audit.crosstab(t.table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))
query("a19_role_lint", q.with_(q.A_RAW) + """SELECT 'clicks' AS log, "column", k AS cardinality, role, reason FROM (SELECT 'ev_type' AS "column", count(DISTINCT ev_type) AS k, 'activity' AS role, '' AS reason FROM a_raw
 UNION ALL SELECT 'ev_k', count(DISTINCT ev_k), 'event_cat', '' FROM a_raw UNION ALL SELECT 'ev_value', count(DISTINCT ev_value), 'excluded', 'measured after the event' FROM a_raw)""")(
    lambda s, d: audit.role_lint(t.clicks(s, d), CLICKS))
