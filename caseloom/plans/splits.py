"""Split queries D1-D12."""

from pyspark.sql import functions as F

from caseloom.operators import frame as fr, splits as sp
from caseloom.plans import sqltext as q
from caseloom.plans.registry import query
from caseloom.schema import CLICKS, ORDERS
from caseloom.sources import tables as t

A, B = q.frame("a"), q.frame("b")
CHRONO = """ch0 AS (SELECT case_id, first_us, last_us, row_number() OVER (ORDER BY first_us, case_id) - 1 AS rank, count(*) OVER () AS nc FROM b_cases),
ch AS (SELECT case_id, first_us, last_us, CASE WHEN rank < floor(nc * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(nc * 0.7::DOUBLE) + floor(nc * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ch0)"""
CH = q.with_(q.B_RAW, q.cases("b"), CHRONO)


def chrono(spark, d):
    return sp.split_chronological(fr.case_table(t.orders(spark, d), ORDERS))


query("d1_random_split", q.with_(q.A_RAW, q.split_cte("a", 3)) + "SELECT * FROM a_split")(
    lambda s, d: sp.split_random(t.clicks(s, d), seed=3))
query("d2_chronological_split", CH + "SELECT case_id, split FROM ch")(lambda s, d: chrono(s, d).select("case_id", "split"))
query("d3_split_meta", CH + """, c AS (SELECT min(first_us) AS cut FROM ch WHERE split = 'test') SELECT max(first_us) AS train_end_us, count(*) AS n_train, count(*) FILTER (last_us >= cut) AS n_overlap,
 any_value(cut) AS cutoff_us, round(count(*) FILTER (last_us >= cut) / count(*), 6) AS overlap_frac FROM ch, c WHERE split = 'train'""")(
    lambda s, d: sp.chronological_meta(chrono(s, d)))


@query("d4_strict_split", CH + """, c AS (SELECT min(first_us) AS cut FROM ch WHERE split = 'test'), e AS (SELECT split, case_id, count(*) AS n, count(*) FILTER (us < cut) AS kept FROM b_raw JOIN ch USING (case_id), c WHERE split <> 'test' GROUP BY 1, 2)
SELECT split, count(*) AS n_cases, count(*) FILTER (kept = 0) AS n_dropped, count(*) FILTER (kept > 0 AND kept < n) AS n_truncated, sum(kept)::BIGINT AS n_events FROM e GROUP BY 1""")
def d4(spark, d):
    return sp.strict_counts(t.orders(spark, d), chrono(spark, d))


query("d5_cv_fold", q.with_(q.B_RAW) + f""", r AS (SELECT case_id, row_number() OVER (ORDER BY {q.hash60(0, 'case_id')}, case_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM b_raw)),
f AS (SELECT case_id, CAST(CASE WHEN rank < (n % 7) * (n // 7 + 1) THEN rank // (n // 7 + 1) ELSE n % 7 + (rank - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM r),
o AS (SELECT case_id, fold, row_number() OVER (ORDER BY {q.hash60(1002, 'case_id')}, case_id) - 1 AS r2, count(*) OVER () AS n2 FROM f WHERE fold <> 2)
SELECT case_id, fold, CASE WHEN r2 < floor(n2 * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM o UNION ALL SELECT case_id, fold, 'test' FROM f WHERE fold = 2""")(
    lambda s, d: sp.split_cv(t.orders(s, d), fold=2, n_folds=7))
query("d6_disjoint", q.with_(q.A_RAW, q.split_cte("a")) + "SELECT count(*) AS n_leaked FROM (SELECT case_id FROM a_split GROUP BY 1 HAVING count(DISTINCT split) > 1)")(
    lambda s, d: sp.leaked_cases(sp.split_random(t.clicks(s, d))).agg(F.count(F.lit(1)).alias("n_leaked")))
query("d7_fingerprint", q.with_(q.A_RAW, q.split_cte("a")) + "SELECT bit_xor(" + q.hash60("fp", "split || ':' || case_id") + ") AS fingerprint, count(*) AS n FROM a_split")(
    lambda s, d: sp.fingerprint(sp.split_random(t.clicks(s, d))))
query("d8_group_holdout", f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY {q.hash60(5, 'source')}, source) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN n > 1 AND r < greatest(1, floor(n * 0.25::DOUBLE)) THEN 'heldout' ELSE 'train' END AS part FROM documents JOIN g USING (source)""")(
    lambda s, d: sp.split_groups(t.table(s, d, "documents").select("doc_id", "source"), "source", seed=5))
def first_fit_sql(table: str, group: str, budget: int, seed: int) -> str:
    """One group after the other, as a recursive statement."""
    return f"""WITH RECURSIVE g AS (SELECT {group}, count(*) AS size, {q.hash60(seed, group)} AS h FROM {table} GROUP BY 1),
o AS (SELECT {group}, size, row_number() OVER (ORDER BY h, {group}) AS r FROM g),
f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS total, false AS fits
 UNION ALL SELECT o.r, CASE WHEN f.total + o.size <= {budget} THEN f.total + o.size ELSE f.total END, f.total + o.size <= {budget} FROM f JOIN o ON o.r = f.r + 1)
SELECT {group}, size, total FROM f JOIN o USING (r) WHERE fits"""


query("d9_group_budget", first_fit_sql("documents", "source", 300, 2))(
    lambda s, d: sp.select_groups(t.table(s, d, "documents"), "source", 300, seed=2))
query("d9_customers_under_budget", first_fit_sql("orders", "o_custkey", 2500, 7))(
    lambda s, d: sp.select_groups(t.table(s, d, "orders"), "o_custkey", 2500, seed=7))
query("d10_few_shot", q.with_(q.A_RAW, q.split_cte("a")) + f"""SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY {q.hash60(9, 'case_id')}, case_id) - 1 AS r, count(*) OVER () AS n FROM a_split WHERE split = 'train') WHERE r < greatest(floor(n * 0.3::DOUBLE), 20)""")(
    lambda s, d: sp.few_shot(sp.split_random(t.clicks(s, d)).where("split = 'train'"), 0.3, seed=9))
query("d11_sample_prefixes", q.with_(A) + f"SELECT case_id, pos FROM a WHERE pos < n - 1 ORDER BY {q.hash60(4, chr(40) + 'case_id || ' + chr(39) + ':' + chr(39) + ' || pos' + chr(41))}, case_id, pos LIMIT 500")(
    lambda s, d: sp.sample_prefixes(fr.prefix_frame(t.clicks(s, d), CLICKS).where("pos < n - 1").select("case_id", "pos"), 500, seed=4))
query("d12_split_statistics", q.with_(A, q.split_cte("a")) + """SELECT split, count(DISTINCT case_id) AS n_cases, count(y) AS n_prefixes, round(sum(CASE WHEN pos = 0 AND complete THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / sum(CASE WHEN pos = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS complete_share
 FROM a JOIN a_split USING (case_id) GROUP BY 1""")(
    lambda s, d: sp.statistics(fr.prefix_frame(t.clicks(s, d), CLICKS), sp.split_random(t.clicks(s, d))))
