"""DuckDB texts of the shared sub-queries used by the oracle statements."""

A_RAW = """a_raw AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS event_idx, ts, epoch_us(ts) AS us,
 event_type AS activity, event_type AS ev_type, value AS ev_value, regexp_extract(props, '"k": ?([0-9]+)', 1) AS ev_k FROM events)"""
B_RAW = """b_raw AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderkey AS event_idx, o_orderdate AS ts,
 epoch_us(o_orderdate) AS us, o_orderstatus || '|' || o_orderpriority AS activity, o_orderstatus AS ev_status,
 o_orderpriority AS ev_priority, o_totalprice AS ev_price, c_mktsegment AS case_segment, c_acctbal AS case_balance,
 CAST(c_nationkey AS VARCHAR) AS case_nation FROM orders JOIN customer ON o_custkey = c_custkey)"""
C_RAW = """c_raw AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS event_idx,
 TIMESTAMP '1970-01-01' + to_seconds(turn) AS ts, turn * 1000000 AS us, role AS activity, role AS ev_role FROM conversations)"""
RAW = {"a": A_RAW, "b": B_RAW, "c": C_RAW}
TERMINAL = {"a": "last_act = 'purchase'", "b": "last_act LIKE 'F|%'", "c": "last_act = 'assistant'"}
OF = {"clicks": "a", "orders": "b", "dialogs": "c"}


def frame(x: str, max_len: int | None = None, complete: str | None = None) -> str:
    """Prefix frame of a log: position, neighbours, borders, targets."""
    comp = complete or TERMINAL[x]
    src = f"{x}_raw"
    pre = ""
    if max_len is not None:
        pre = f"""{x}_full AS (SELECT *, row_number() OVER w - 1 AS p0, count(*) OVER (PARTITION BY case_id) AS n0 FROM {x}_raw WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)),
{x}_cut AS (SELECT * FROM {x}_full WHERE p0 < {max_len}), """
        src = f"{x}_cut"
        comp = f"({comp}) AND n0 = n"
    return f"""{RAW[x]}, {pre}{x}_w AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY case_id) AS n,
 lag(activity) OVER w AS prev1, lag(activity, 2) OVER w AS prev2, lead(activity) OVER w AS next_act, lag(us) OVER w AS prev_us, lead(us) OVER w AS next_us,
 min(us) OVER (PARTITION BY case_id) AS first_us, max(us) OVER (PARTITION BY case_id) AS last_us,
 last_value(activity) OVER (PARTITION BY case_id ORDER BY us, event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_act
 FROM {src} WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx)),
{x}_c AS (SELECT *, ({comp}) AS complete FROM {x}_w),
{x} AS (SELECT *, coalesce(next_act, CASE WHEN complete THEN '<EOS>' END) AS y,
 CASE WHEN next_us IS NOT NULL THEN ln(1 + greatest((next_us - us) / 1e6, 0)) END AS y_ldt, CASE WHEN complete THEN (last_us - us) / 1e6 END AS y_rem,
 greatest(coalesce((us - prev_us) / 1e6, 0), 0) AS dt_s, (us - first_us) / 1e6 AS elapsed_s FROM {x}_c)"""


def cases(x: str) -> str:
    """One row per case of a raw log."""
    extra = ", arg_min(case_segment, (us, event_idx)) AS case_segment, arg_min(case_nation, (us, event_idx)) AS case_nation, arg_min(case_balance, (us, event_idx)) AS num_balance" if x == "b" else ""
    return f"""{x}_cases0 AS (SELECT case_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(activity, (us, event_idx)) AS first_act,
 arg_max(activity, (us, event_idx)) AS last_act{extra} FROM {x}_raw GROUP BY case_id),
{x}_cases AS (SELECT *, ({TERMINAL[x]}) AS complete FROM {x}_cases0)"""


def hash60(seed, col: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {col}), 1, 15) AS BIGINT)"


def unit(seed, expr: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || {expr}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def split_cte(x: str, seed: int = 0, fr=(0.7, 0.15), src: str | None = None) -> str:
    """Random split of a log's cases by hash order with exact sizes."""
    src = src or f"(SELECT DISTINCT case_id FROM {x}_raw)"
    return f"""{x}_rk AS (SELECT case_id, row_number() OVER (ORDER BY {hash60(seed, 'case_id')}, case_id) - 1 AS rank, count(*) OVER () AS n_cases FROM {src}),
{x}_split AS (SELECT case_id, CASE WHEN rank < floor(n_cases * {fr[0]}::DOUBLE) THEN 'train' WHEN rank < floor(n_cases * {fr[0]}::DOUBLE) + floor(n_cases * {fr[1]}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM {x}_rk)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
