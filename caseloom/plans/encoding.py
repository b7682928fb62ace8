"""Encoding queries E1-E15, J2."""

from pyspark.sql import functions as F

from caseloom.functions.columns import rnd
from caseloom.operators import encode as en, frame as fr, sequence as S, splits as sp
from caseloom.plans import sqltext as q
from caseloom.plans.registry import query
from caseloom.schema import CLICKS, DIALOGS, ORDERS
from caseloom.sources import tables as t

A, B, C = q.frame("a"), q.frame("b"), q.frame("c")


def vocab_cte(name: str, src: str, col: str, min_count: int, n_special: int) -> str:
    sp_ = ", ".join(f"('{s}', {i}, NULL)" for i, s in enumerate(["<PAD>", "<UNK>", "<EOS>"][:n_special]))
    return f"""{name} AS (SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) - 1 + {n_special} AS INTEGER) AS id, n FROM (SELECT {col} AS value, count(*) AS n FROM {src} GROUP BY 1) WHERE n >= {min_count} AND value IS NOT NULL
 UNION ALL SELECT * FROM (VALUES {sp_}) s(value, id, n))"""


def train_events(s, d, reader, seed=0):
    ev = reader(s, d)
    return ev.join(sp.split_random(ev, seed).where("split = 'train'"), "case_id", "left_semi")


SPL_A = q.with_(A, q.split_cte("a")) + ", tr AS (SELECT a.* FROM a SEMI JOIN (SELECT * FROM a_split WHERE split = 'train') USING (case_id))"
SPL_B = q.with_(B, q.split_cte("b")) + ", tr AS (SELECT b.* FROM b SEMI JOIN (SELECT * FROM b_split WHERE split = 'train') USING (case_id))"

query("e1_vocabulary", SPL_A + ", " + vocab_cte("v", "tr", "ev_k", 5, 2) + " SELECT value, id, n FROM v")(
    lambda s, d: en.fit_vocab(train_events(s, d, t.clicks), "ev_k", 5, en.CAT_SPECIALS))
query("e2_component_vocabulary", SPL_B + ", lb AS (SELECT DISTINCT activity FROM tr), cp AS (SELECT unnest(['status=' || split_part(activity, '|', 1), 'sub=' || substr(activity, strpos(activity, '|') + 1)]) AS c FROM lb), "
      + vocab_cte("v", "cp", "c", 1, 2) + " SELECT value, id, n FROM v")(
    lambda s, d: en.fit_component_vocab(train_events(s, d, t.orders), "status"))

_SC = lambda x, f, n: f"round(coalesce(avg({x}), 0), 6) AS {n}_mean, round(coalesce(CASE WHEN stddev_pop({x}) > 1e-8 THEN stddev_pop({x}) END, 1), 6) AS {n}_std"
_SCALE = ", ".join([_SC("CASE WHEN pos > 0 THEN ln(1 + dt_s) END", "", "dt"), _SC("ln(1 + elapsed_s)", "", "elapsed"), _SC("ln(1 + pos)", "", "pos")])


@query("e3_scalers", SPL_A + f" SELECT {_SCALE} FROM tr")
def e3(spark, d):
    sc = en.fit_scalers(fr.prefix_frame(train_events(spark, d, t.clicks), CLICKS))
    return sc.select(*[rnd(c).alias(c) for c in sc.columns])


_VA = vocab_cte("v", "tr", "activity", 1, 3)


@query("e4_label_ids", SPL_A + ", " + _VA + ", " + vocab_cte("vk", "tr", "ev_k", 5, 2) + """ SELECT a.event_idx, coalesce(v.id, 1) AS act, coalesce(vk.id, 1) AS k_id, coalesce(v2.value, '') AS back FROM a LEFT JOIN v ON a.activity = v.value
 LEFT JOIN vk ON a.ev_k = vk.value LEFT JOIN v v2 ON v2.id = coalesce(v.id, 1)""")
def e4(spark, d):
    tr = train_events(spark, d, t.clicks)
    va, vk = en.fit_vocab(tr, "activity"), en.fit_vocab(tr, "ev_k", 5, en.CAT_SPECIALS)
    out = en.lookup(en.lookup(t.clicks(spark, d), va, "activity", "act"), vk, "ev_k", "k_id")
    return en.inverse_lookup(out, va, "act", "back").select("event_idx", "act", "k_id", "back")


@query("j2_vocabulary_default", SPL_B + ", " + vocab_cte("v", "tr", "ev_price", 2, 2).replace("'<PAD>'", "NULL").replace("'<UNK>'", "NULL") + " SELECT b.event_idx, coalesce(v.id, 1) AS id FROM b LEFT JOIN v ON b.ev_price = v.value")
def j2(spark, d):
    v = en.fit_vocab(train_events(spark, d, t.orders), F.col("ev_price").cast("string"), 2, en.CAT_SPECIALS)
    num = v.withColumn("value", F.col("value").try_cast("double"))
    # ids follow text order for equal counts, so take them from the numeric order for a portable result
    body = num.where(F.col("n").isNotNull())
    from caseloom.operators.ranking import global_rank

    body = global_rank(body.drop("id"), [F.desc("n"), F.col("value")], "_r").select("value", (F.col("_r") + 2).cast("int").alias("id"))
    return en.lookup(t.orders(spark, d), body, "ev_price", "id").select("event_idx", "id")


_T = "CASE WHEN pos > 0 THEN ln(1 + dt_s) END"


@query("e5_time_features", SPL_A + """, sc AS (SELECT avg(CASE WHEN pos > 0 THEN ln(1 + dt_s) END) AS dm, stddev_pop(CASE WHEN pos > 0 THEN ln(1 + dt_s) END) AS ds, avg(ln(1 + elapsed_s)) AS em, stddev_pop(ln(1 + elapsed_s)) AS es, avg(ln(1 + pos)) AS pm, stddev_pop(ln(1 + pos)) AS ps FROM tr),
l AS (SELECT *, timezone('Europe/Amsterdam', timezone('UTC', ts)) AS loc FROM a)
SELECT event_idx, round((ln(1 + dt_s) - dm) / ds, 5) AS f_dt, round((ln(1 + elapsed_s) - em) / es, 5) AS f_elapsed, round(sin(2 * pi() * hour(loc) / 24), 5) + 0.0 AS f_hour_sin, round(cos(2 * pi() * hour(loc) / 24), 5) + 0.0 AS f_hour_cos,
 round(sin(2 * pi() * (isodow(loc) - 1) / 7), 5) + 0.0 AS f_wd_sin, round(cos(2 * pi() * (isodow(loc) - 1) / 7), 5) + 0.0 AS f_wd_cos, round((ln(1 + pos) - pm) / ps, 5) AS f_pos FROM l, sc""")
def e5(spark, d):
    ev = t.clicks(spark, d)
    f = fr.prefix_frame(ev.join(sp.split_random(ev), "case_id"), CLICKS)
    out = en.time_features(f, en.fit_scalers(f.where("split = 'train'")), CLICKS)
    return out.select("event_idx", *[(rnd(c, 5) + 0.0).alias(c) for c in out.columns if c.startswith("f_")])


@query("e6_case_numbers", q.with_(q.B_RAW, q.cases("b")) + """, s AS (SELECT avg(ln(1 + abs(num_balance))) AS m, stddev_pop(ln(1 + abs(num_balance))) AS sd FROM b_cases)
SELECT case_id, round(coalesce((ln(1 + abs(num_balance)) - m) / sd, 0), 6) AS z, CASE WHEN num_balance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing FROM b_cases, s""")
def e6(spark, d):
    c = fr.case_table(t.orders(spark, d), ORDERS)
    out = en.case_numbers(c, en.fit_case_scalers(c, ["balance"]), ["balance"])
    return out.select("case_id", rnd("z_balance").alias("z"), F.col("m_balance").alias("missing"))


query("e7_next_activity", q.with_(B) + "SELECT event_idx, y FROM b")(
    lambda s, d: fr.prefix_frame(t.orders(s, d), ORDERS).select("event_idx", "y"))
query("e8_next_wait", q.with_(A) + "SELECT event_idx, round(y_ldt, 6) AS y_ldt FROM a")(
    lambda s, d: fr.prefix_frame(t.clicks(s, d), CLICKS).select("event_idx", rnd("y_ldt").alias("y_ldt")))
query("e9_remaining", q.with_(A) + "SELECT event_idx, y_rem FROM a")(
    lambda s, d: fr.prefix_frame(t.clicks(s, d), CLICKS).select("event_idx", "y_rem"))


@query("e10_suffix", q.with_(C) + "SELECT c.case_id, c.pos, string_agg(e.activity, '>' ORDER BY e.pos) AS suffix FROM c JOIN c e ON c.case_id = e.case_id AND e.pos > c.pos WHERE c.complete GROUP BY 1, 2")
def e10(spark, d):
    f = fr.prefix_frame(t.dialogs(spark, d), DIALOGS)
    return fr.suffixes(f, f.where("complete")).select("case_id", "pos", F.array_join("suffix", ">").alias("suffix"))


@query("e11_union_vocabulary", SPL_A + ", " + _VA + ", x AS (SELECT DISTINCT role AS value FROM conversations UNION SELECT DISTINCT event_type FROM events), nw AS (SELECT value FROM x ANTI JOIN v USING (value)) SELECT value, id FROM v UNION ALL SELECT value, CAST((SELECT max(id) FROM v) + row_number() OVER (ORDER BY value) AS INTEGER) FROM nw")
def e11(spark, d):
    v = en.fit_vocab(train_events(spark, d, t.clicks), "activity")
    more = t.dialogs(spark, d).select(F.col("activity").alias("value")).unionByName(t.clicks(spark, d).select(F.col("activity").alias("value")))
    return en.extend_vocab(v, more).select("value", "id")


@query("e12_label_components", SPL_B + ", " + vocab_cte("v", "tr", "activity", 1, 3) + ", lb AS (SELECT DISTINCT activity FROM tr), cp AS (SELECT unnest(['status=' || split_part(activity, '|', 1), 'sub=' || substr(activity, strpos(activity, '|') + 1)]) AS c FROM lb), "
       + vocab_cte("cv", "cp", "c", 1, 2) + """, sl AS (SELECT id, value, 0 AS slot, 'status=' || split_part(value, '|', 1) AS c FROM v UNION ALL SELECT id, value, 1, 'sub=' || CASE WHEN strpos(value, '|') > 0 THEN substr(value, strpos(value, '|') + 1) ELSE '' END FROM v)
SELECT sl.id, slot, CASE WHEN sl.value IN ('<PAD>', '<UNK>', '<EOS>') THEN 1 ELSE coalesce(cv.id, 1) END AS component_id FROM sl LEFT JOIN cv ON cv.value = sl.c""")
def e12(spark, d):
    tr = train_events(spark, d, t.orders)
    return en.component_table(en.fit_vocab(tr, "activity"), en.fit_component_vocab(tr, "status"), "status")


@query("e13_prefix_features", SPL_A + ", " + _VA + """, e AS (SELECT a.*, coalesce(v.id, 1) AS act FROM a LEFT JOIN v ON a.activity = v.value)
SELECT event_idx, pos, act, lag(act) OVER w AS last1, lag(act, 2) OVER w AS last2, count(*) FILTER (act = 3) OVER w AS bag_3, count(*) FILTER (act = 4) OVER w AS bag_4, count(*) FILTER (act = 5) OVER w AS bag_5,
 count(*) FILTER (act = 6) OVER w AS bag_6, count(*) FILTER (act = 7) OVER w AS bag_7 FROM e WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)""")
def e13(spark, d):
    v = en.fit_vocab(train_events(spark, d, t.clicks), "activity")
    size = v.count()
    e = en.lookup(t.clicks(spark, d), v, "activity", "act")
    specs = {"pos": S.pos(), "last1": S.lag("act"), "last2": S.lag("act", 2)}
    specs.update({f"bag_{i}": S.running_sum((F.col("act") == i).cast("long")) for i in range(3, size)})
    return S.sequence(e, specs).select("event_idx", "act", *specs)


@query("e14_cardinality_flag", q.with_(q.B_RAW) + """, c AS (SELECT unnest([{'field': 'ev_price', 'value': CAST(ev_price AS VARCHAR)}, {'field': 'case_nation', 'value': case_nation}, {'field': 'ev_priority', 'value': ev_priority}], recursive := true) FROM b_raw),
n AS (SELECT field, value, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 1) SELECT field, count(*) + 2 AS size, CASE WHEN count(*) + 2 > 255 THEN 'ordinal' ELSE 'category' END AS kind FROM n GROUP BY 1""")
def e14(spark, d):
    return en.cardinality_flags(t.orders(spark, d), ["ev_price", "case_nation", "ev_priority"], 1)


@query("e15_synthetic_clock", q.with_(A) + """, s AS (SELECT event_idx, timezone('Europe/Amsterdam', timezone('UTC', ts + to_microseconds(us - prev_us))) AS loc FROM a WHERE prev_us IS NOT NULL) SELECT event_idx, hour(loc) AS s_hour, isodow(loc) - 1 AS s_weekday FROM s""")
def e15(spark, d):
    f = fr.prefix_frame(t.clicks(spark, d), CLICKS).where(F.col("prev_us").isNotNull())
    return en.synthetic_time(f, F.col("dt_s"), CLICKS).select("event_idx", "s_hour", "s_weekday")


@query("s10_reload_encoder", SPL_A + ", " + _VA + " SELECT a.event_idx, coalesce(v.id, 1) AS act FROM a LEFT JOIN v ON a.activity = v.value")
def s10(spark, d):
    from caseloom.sources.store import load_tables, save_tables

    tr = train_events(spark, d, t.clicks)
    path = save_tables(spark, {"vocab": en.fit_vocab(tr, "activity")}, run="s10")
    return en.lookup(t.clicks(spark, d), load_tables(spark, path)["vocab"], "activity", "act").select("event_idx", "act")
