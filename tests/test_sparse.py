"""Sparse distributions give what lists of all classes give."""

import numpy as np
from pyspark.sql import functions as F

from caseloom.functions.columns import hash_unit
from caseloom.operators import metrics as me, sparse as sp, transitions as tr

SIZE = 9


def cases():
    r = np.random.default_rng(2)
    out = []
    for k in range(60):
        seen = np.sort(r.choice(SIZE, r.integers(0, SIZE + 1), replace=False))
        raw, rest = r.integers(1, 5, len(seen)).astype(float), float(r.choice([0.5, 1.0, 2.0, 6.0]))
        z = raw.sum() + (SIZE - len(seen)) * rest
        out.append(([int(i) for i in seen], [float(x / z) for x in raw], float(rest / z) if len(seen) < SIZE else 0.0, SIZE, int(r.integers(SIZE)), float(r.random())))
    return out


def dense(c):
    p = np.full(SIZE, c[2])
    p[c[0]] = c[1]
    return p


def test_functions_equal_dense_ones(spark):
    rows = cases()
    df = spark.createDataFrame([((*c[:4],), c[4], c[5], i) for i, c in enumerate(rows)], f"dist {sp.SCHEMA}, y int, u double, i int")
    other = df.select(F.col("dist").alias("q"), ((F.col("i") + 59) % 60).alias("i"))
    got = df.join(other, "i").select(
        "i", sp.dense("dist").alias("dense"), sp.prob("dist", "y").alias("prob"), sp.argmax("dist").alias("argmax"), sp.top("dist").alias("top"), sp.rank("dist", "y").alias("rank"),
        sp.entropy("dist").alias("entropy"), sp.log_scale("dist", F.lit(1.7)).alias("scale"), sp.dense(sp.temper("dist", F.lit(1.7))).alias("tempered"),
        sp.dense(sp.mixture(F.array("dist", "q", "dist"))).alias("mixed"), sp.divergence("dist", "q").alias("kl"), sp.draw("dist", "u").alias("draw"),
        sp.over("dist", lambda p: p * p).alias("squares"), sp.first_other("dist").alias("free"))
    for g in got.collect():
        c, p = rows[g.i], dense(rows[g.i])
        q, y, u = dense(rows[(g.i + 1) % 60]), rows[g.i][4], rows[g.i][5]
        assert np.allclose(g.dense, p) and np.isclose(g.prob, p[y]) and np.isclose(g.top, p.max()) and np.isclose(g.squares, (p * p).sum())
        assert g.argmax == int(np.argmax(p)) and g.rank == int((p > p[y]).sum() + (p[:y] == p[y]).sum())
        ln = np.log(np.clip(p, 1e-12, 1))
        assert np.isclose(g.entropy, -(p * ln).sum()) and np.isclose(g.scale, np.log(np.exp(ln / 1.7).sum()))
        assert np.allclose(g.tempered, np.exp(ln / 1.7) / np.exp(ln / 1.7).sum(), atol=1e-9)
        assert np.allclose(g.mixed, (2 * p + q) / 3) and np.isclose(g.kl, (p * (np.log(p + 1e-9) - np.log(q + 1e-9))).sum())
        assert g.draw == min(int((np.cumsum(p) <= u).sum()), SIZE - 1)
        assert g.free == next((i for i in range(SIZE + 1) if i not in c[0]), SIZE)


def test_draws_follow_the_distribution(spark):
    df = spark.range(4000).select(sp.make(F.array(F.lit(1), F.lit(4)), F.array(F.lit(0.5), F.lit(0.2)), F.lit(0.1), 5).alias("d"), ((F.col("id") + 0.5) / 4000).alias("u"))
    got = {r.c: r.n for r in df.groupBy(sp.draw("d", "u").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 400, 1: 2000, 2: 400, 3: 400, 4: 800}


def test_scores_equal_dense_scores(spark):
    rows = [c for c in cases() if c[2] or len(c[0]) == SIZE]
    df = spark.createDataFrame([((*c[:4],), c[4], 1 + i % 3) for i, c in enumerate(rows)], f"dist {sp.SCHEMA}, y_id int, w int")
    plain = df.select(sp.dense("dist").alias("probs"), "y_id", "w")
    for f in (me.next_label, me.macro_f1, me.ece, me.fit_temperature, lambda s: me.next_label(me.score(me.apply_temperature(s, me.fit_temperature(s)).select(
            *[c for c in ("dist", "probs") if c in s.columns], "y_id", "w")))):
        a, b = f(me.score(df)).first().asDict(), f(me.score(plain)).first().asDict()
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=2e-6) for k in a)


def test_table_follows_seen_classes(spark):
    counts = spark.createDataFrame([(0, "", 3, 5), (0, "", 1, 2), (1, "7", 3, 1)], "k int, ctx string, y int, n long")
    got = {r.ctx: r.dist for r in tr.smooth(counts, 1_000_000, 0.1).collect()}
    assert got[""].ids == [1, 3] and np.allclose(got[""].ps, [2.1 / 100007, 5.1 / 100007]) and np.isclose(got["7"].rest, 0.1 / 100001)
    low = {r.ctx: r.dist for r in tr.floor_vectors(counts, 10).collect()}
    assert np.isclose(sum(low[""].ps) + 8 * low[""].rest, 1) and np.isclose(low[""].rest / low[""].ps[0], 1e-6 / (2 / 7))


def test_draws_compute_the_unit_once_and_read_intervals(spark):
    rows = cases()
    df = spark.createDataFrame([((*c[:4],), c[5], i) for i, c in enumerate(rows)], f"dist {sp.SCHEMA}, u double, i int")
    hashed = df.select(sp.draw("dist", hash_unit(1, "i")).alias("c"))
    assert hashed._jdf.queryExecution().analyzed().toString().count("md5(") == 1  # not once for each listed class
    for g in df.select("i", sp.intervals("dist").alias("c"), "u").select("i", "c", sp.draw_interval("c", "u").alias("draw")).collect():
        p, c = dense(rows[g.i]), g.c
        assert np.allclose(c.up, np.cumsum(p)[np.array(c.until, int) - 1]) and c.lo == [0.0, *c.up[:-1]]
        assert [c.at, c.until] == [[0, *c.until[:-1]], [*c.at[1:], SIZE]] and g.draw == min(int((np.cumsum(p) <= rows[g.i][5]).sum()), SIZE - 1)
