"""Whole groups under a budget, next to one group after the other."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions.columns import hash_key
from caseloom.operators import splits as sp


def one_by_one(groups, budget):
    out, total = [], 0
    for name, size in groups:
        if total + size <= budget:
            total += size
            out.append((name, size, total))
    return out


def check(spark, sizes, budgets, seed=3, **how):
    names = spark.createDataFrame(sorted(sizes.items()), "g string, n int")
    rows = names.select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    order = [(r.g, sizes[r.g]) for r in names.orderBy(hash_key(seed, "g"), "g").collect()]
    for budget in budgets:
        got = sorted(map(tuple, sp.select_groups(rows, "g", budget, seed, **how).collect()), key=lambda r: r[2])
        assert got == one_by_one(order, budget), budget


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 7}])
def test_groups_that_do_not_fit_are_skipped(spark, how):
    r = random.Random(1)
    sizes = {f"g{i}": r.choice([1, 1, 2, 3, 5, 8, 16, 17, 40, 64, 90]) for i in range(60)}
    check(spark, sizes, (1, 7, 64, 100, 233) if not how else (100,), **how)


def test_budget_edges(spark):
    check(spark, {"a": 5, "b": 5, "c": 5}, (0, 4, 5, 15, 1000))
    empty = spark.createDataFrame([], "g string")
    assert sp.select_groups(empty, "g", 10).count() == 0
    some = spark.createDataFrame([(None,), (None,), ("x",)], "g string")
    assert sorted((r.g or "", r["size"]) for r in sp.select_groups(some, "g", 3).collect()) == [("", 2), ("x", 1)]
