"""Counts of the splitting tree: exact totals, the law of drawing with replacement, and equal results for any layout."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from caseloom.functions.columns import hash_order
from caseloom.operators import bootstrap as bo


@pytest.mark.parametrize("total,size", [(1, 4), (4, 4), (5, 4), (37, 4), (1000, 16), (64, 1024)])
def test_counts_add_up(total, size):
    blocks = [bo.block_counts(total, k, 20, 7, size) for k in range(-(-total // size))]
    counts = np.concatenate(blocks, axis=1)
    assert counts.shape == (20, total) and (counts.sum(axis=1) == total).all()
    assert total < 30 or len({tuple(c) for c in counts}) == 20


def test_counts_follow_the_multinomial_law():
    total, reps = 21, 4000
    counts = np.concatenate([bo.block_counts(total, k, reps, 3, 4) for k in range(6)], axis=1)
    p = 1 / total
    assert np.allclose(counts.mean(axis=0), 1, atol=0.08) and np.allclose(counts.var(axis=0), total * p * (1 - p), atol=0.12)
    cov = np.cov(counts.T)
    off = cov[~np.eye(total, dtype=bool)]
    assert abs(off.mean() + total * p * p) < 0.01 and np.abs(off).max() < 0.15
    zero = (counts == 0).mean()
    assert abs(zero - (1 - p) ** total) < 0.01  # in the same block and in the last, shorter one


def rows(n=150):
    r = np.random.default_rng(1)
    return [(f"c{i % 60:03d}", float(v)) for i, v in enumerate(r.normal(5, 2, n))] + [("c007", None), ("only-null", None)]


def test_replicates_against_plain_sums(spark, monkeypatch):
    data, n_boot = rows(), 25
    df = spark.createDataFrame(data, "case_id string, v double")
    cases = sorted({c for c, _ in data})
    counts = np.concatenate([bo.block_counts(len(cases), k, n_boot, 5, 16) for k in range(-(-len(cases) // 16))], axis=1)
    sums = np.array([sum(v for c, v in data if c == k and v is not None) for k in cases])
    size = np.array([sum(c == k and v is not None for c, v in data) for k in cases])
    want = (counts * sums).sum(axis=1) / (counts * size).sum(axis=1)
    for limit in ("0", str(1 << 26)):
        spark.conf.set("caseloom.smallInputBytes", limit)
        try:
            for parts in (1, 7):
                got = {r.b: (r.m, r.cases) for r in bo.split_replicates(df.repartition(parts), "v", n_boot=n_boot, seed=5, block=16).collect()}
                assert np.allclose([got[b][0] for b in range(n_boot)], want) and {x[1] for x in got.values()} == {len(cases)}
        finally:
            spark.conf.unset("caseloom.smallInputBytes")


def test_median_from_weights(spark):
    data, n_boot = [(c, round(v or 0.0, 1)) for c, v in rows()], 15
    df = spark.createDataFrame(data, "case_id string, v double").repartition(3)
    cases = sorted({c for c, _ in data})
    counts = np.concatenate([bo.block_counts(len(cases), k, n_boot, 0, 16) for k in range(-(-len(cases) // 16))], axis=1)
    meds = [np.median(np.repeat([v for _, v in data], [counts[b][cases.index(c)] for c, _ in data])) for b in range(n_boot)]
    got = bo.split_bootstrap_median(df, "v", n_boot=n_boot, block=16).first()
    assert got.n_boot == n_boot and np.isclose(got.median, np.median([v for _, v in data]))
    assert np.allclose([got.lo, got.hi], np.quantile(meds, [0.025, 0.975]), atol=1e-6)


def test_no_rows(spark):
    df = spark.createDataFrame([], "case_id string, v double")
    assert bo.split_replicates(df, "v", n_boot=3).count() == 0


def test_drawn_medians_against_plain_lists(spark):
    data, n_boot = [*rows(), (None, 1e9), ("c001", float("inf"))], 12
    df = spark.createDataFrame(data, "case_id string, v double").repartition(3)
    cases = [None, *sorted({c for c, _ in data if c is not None})]
    slots = spark.range(len(cases)).select("id", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    draws = [[] for _ in range(n_boot)]
    for r in slots.select("b", (hash_order(4, "b", "id") % len(cases)).alias("i")).collect():
        draws[r.b] += [v for c, v in data if c is not None and c == cases[r.i] and v is not None]
    want = [np.median(x) for x in draws]
    for limit in ("0", str(1 << 26)):
        spark.conf.set("caseloom.smallInputBytes", limit)
        try:
            got = bo.bootstrap_median(df, "v", n_boot=n_boot, seed=4).first()
            assert got.n_boot == n_boot and np.isclose(got.median, np.median([v for _, v in data if v is not None]))
            assert np.allclose([got.lo, got.hi], np.quantile(want, [0.025, 0.975]), atol=1e-6)
            plan = bo.drawn_rows(df, "v", n_boot=n_boot)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 2
        finally:
            spark.conf.unset("caseloom.smallInputBytes")


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_medians_by_ranges(spark, ranges):
    r, n_boot = np.random.default_rng(2), 9
    v = np.concatenate([r.normal(0, 1, 3000), np.zeros(500), [np.inf, -np.inf]])
    weight = r.integers(0, 3, (n_boot, len(v)))
    weight[8] = 0  # a replicate without rows
    df = spark.createDataFrame([(float(x), k) for k, x in enumerate(v)], "v double, k int").repartition(4)

    def listed():
        def draws(part):
            w = weight[:, part.column("k").to_numpy()]
            rep, row = np.nonzero(w)
            return rep, row, w[rep, row]

        return draws

    got = {x.b: x.m for x in bo.replicate_medians(df, listed, n_boot, ranges).collect()}
    assert sorted(got) == list(range(8)) and np.allclose([got[b] for b in range(8)], [np.median(np.repeat(v, weight[b])) for b in range(8)])
