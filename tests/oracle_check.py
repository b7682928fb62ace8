"""Run registered queries next to their DuckDB statements: python -m tests.oracle_check [--sf 0.01] [names...]"""

from __future__ import annotations

import argparse
import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else repr(v))
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(cols, rows, con, sql: str):
    sc, sr = rows_of(cols, rows)
    cur = con.execute(sql)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} differing rows, first {bad[0]}" if bad else None


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--slow", type=float, default=4.0)
    ap.add_argument("--large", action="store_true", help="force the layouts used for large inputs, with tiny chunks")
    a = ap.parse_args(argv)
    sf_dir = f"/root/testdata/sf{a.sf}"
    import __spark_entry__ as e
    from caseloom.session import local_session

    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    if a.large:
        from caseloom.operators import sequence

        spark.conf.set("caseloom.smallInputBytes", "0")
        sequence.CHUNK_ROWS = 40
    con = connect(sf_dir)
    oracle, bad = e.oracle_sql(), 0
    qs = {k: v for k, v in e.queries().items() if not a.names or any(k == n or k.startswith(n + "_") or (n.endswith("*") and k.startswith(n[:-1])) for n in a.names)}
    for name, fn in qs.items():
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            cols, rows = df.columns, [tuple(r) for r in df.collect()]
            st = time.time() - t
            err, n = (compare(cols, rows, con, oracle[name]), len(rows)) if name in oracle else (None, len(rows))
        except Exception as ex:
            err, n, st = "EXC " + str(ex)[:600], -1, 0
        dt = time.time() - t
        if err or n == 0:
            bad += 1
            print(f"FAIL {name} rows={n}: {str(err)[:700]!r}", flush=True)
        elif st > a.slow or a.names:
            print(f"ok {name} rows={n} spark {st:.1f}s sql {dt - st:.1f}s{'' if name in oracle else ' (rows only)'}", flush=True)
    print(f"{len(qs)} queries, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
