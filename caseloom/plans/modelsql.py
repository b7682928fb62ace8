"""DuckDB texts of the fitted transition model and its scored rows."""

from caseloom.plans import sqltext as q
from caseloom.plans.encoding import vocab_cte


def encoded(x: str, seed: int = 0, max_len: int | None = None) -> str:
    """Split, train vocabulary and encoded prefix frame ``e`` of a log."""
    return f"""{q.frame(x, max_len)},
{q.split_cte(x, seed)},
tr0 AS (SELECT activity FROM {x}_raw JOIN {x}_split USING (case_id) WHERE split = 'train'),
{vocab_cte('v', 'tr0', 'activity', 1, 3)},
vs AS (SELECT max(id) + 1 AS sz FROM v),
e0 AS (SELECT f.*, split, coalesce(v.id, 1) AS act FROM {x} f JOIN {x}_split USING (case_id) LEFT JOIN v ON f.activity = v.value),
e AS MATERIALIZED (SELECT *, lag(act) OVER w AS id1, coalesce(lead(act) OVER w, CASE WHEN complete THEN 2 END) AS y_id FROM e0 WINDOW w AS (PARTITION BY case_id ORDER BY us, event_idx))"""


def contexts(src: str, cols: str) -> str:
    return f"""SELECT {cols}, 0 AS k, '' AS ctx FROM {src} UNION ALL SELECT {cols}, 1, CAST(act AS VARCHAR) FROM {src}
 UNION ALL SELECT {cols}, 2, id1 || '>' || act FROM {src} WHERE id1 IS NOT NULL"""


def fitted(where: str = "split = 'train'", alpha: float = 0.1) -> str:
    return f"""trn AS (SELECT * FROM e WHERE {where}),
cx AS MATERIALIZED ({contexts('trn', 'y_id, y_ldt')}),
cnt AS MATERIALIZED (SELECT k, ctx, y_id AS y, count(*) AS n FROM cx WHERE y_id IS NOT NULL GROUP BY ALL),
tot AS MATERIALIZED (SELECT k, ctx, sum(n) AS total FROM cnt GROUP BY ALL),
pr AS MATERIALIZED (SELECT tot.k, tot.ctx, v.id AS cls, (coalesce(cnt.n, 0) + {alpha}::DOUBLE) / (total + {alpha}::DOUBLE * sz) AS p FROM tot CROSS JOIN v CROSS JOIN vs LEFT JOIN cnt ON cnt.k = tot.k AND cnt.ctx = tot.ctx AND cnt.y = v.id)"""


def best_context(where: str, table: str = "tot") -> str:
    """``bc``: rows with the order and key of their longest known context (-1 when none)."""
    return f"""bc AS MATERIALIZED (SELECT e.*, CASE WHEN t2.ctx IS NOT NULL THEN 2 WHEN t1.ctx IS NOT NULL THEN 1 ELSE 0 END AS k, CASE WHEN t2.ctx IS NOT NULL THEN id1 || '>' || act WHEN t1.ctx IS NOT NULL THEN CAST(act AS VARCHAR) ELSE '' END AS ctx
 FROM e LEFT JOIN (SELECT DISTINCT k, ctx FROM {table}) t2 ON t2.k = 2 AND t2.ctx = id1 || '>' || act LEFT JOIN (SELECT DISTINCT k, ctx FROM {table}) t1 ON t1.k = 1 AND t1.ctx = CAST(act AS VARCHAR) WHERE {where})"""


def scored(where: str) -> str:
    """``pd``: one row per (prefix, class); ``s``: one row per scored prefix."""
    return best_context(where + " AND y_id IS NOT NULL") + """,
pd AS MATERIALIZED (SELECT bc.case_id, bc.pos, bc.y_id, cls, p FROM bc JOIN pr ON pr.k = bc.k AND pr.ctx = bc.ctx),
s AS MATERIALIZED (SELECT case_id, pos, y_id, max(CASE WHEN cls = y_id THEN p END) AS p_y, arg_min(cls, (-p, cls)) AS pred, max(p) AS conf, -sum(p * ln(greatest(p, 1e-12))) AS ent, sum(p * p) AS sq,
 sum(CASE WHEN p > py OR (p = py AND cls < y_id) THEN 1 ELSE 0 END) AS rank_y FROM (SELECT *, max(CASE WHEN cls = y_id THEN p END) OVER (PARTITION BY case_id, pos) AS py FROM pd) GROUP BY ALL)"""


def model(x: str = "a", seed: int = 0, where: str = "split = 'train'", max_len: int | None = None) -> str:
    return q.with_(encoded(x, seed, max_len), fitted(where))


def test_scores(x: str = "a", seed: int = 0) -> str:
    return model(x, seed) + ", " + scored("split = 'test'") + "\n"
