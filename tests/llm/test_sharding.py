import zlib
from itertools import product

import numpy as np
import pytest

from caseloom.llm import sharding


def spread(sizes, shard, k):
    sums = [0] * k
    for s, i in zip(sizes, shard):
        sums[i] += s
    return max(sums) - min(sums)


def plain_differencing(sizes, k):
    """Sums that repeated combining leaves, with whole lists in place of a tree and a heap."""
    parts, made = [(s, -i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)], len(sizes)
    while len(parts) > 1:
        parts.sort()
        (_, _, a), (_, _, b) = parts.pop(), parts.pop()
        sums = sorted(x + y for x, y in zip(sorted(a, reverse=True), sorted(b)))
        parts.append((sums[-1] - sums[0], -made, sums))
        made += 1
    return parts[0][0] if parts else 0


@pytest.mark.parametrize("seed", range(6))
def test_differencing(seed):
    r = np.random.default_rng(seed)
    sizes = [int(x) for x in r.permutation(10_000)[:40]]
    for k in (1, 2, 3, 8):
        assert spread(sizes, sharding.difference(sizes, k), k) == plain_differencing(sizes, k)
    few = sizes[:7]
    best = min(spread(few, s, 2) for s in product(range(2), repeat=7))
    assert best <= spread(few, sharding.difference(few, 2), 2) <= best + max(few) // 4
    greedy = [0] * 8  # largest first into the emptiest shard
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert spread(sizes, sharding.difference(sizes, 8), 8) <= max(greedy) - min(greedy)


def check(rows, got, shards):
    assert len(got) == len(rows)
    text_of = {}
    for d, t in rows:
        text_of.setdefault(d, []).append(t or "")
    shard_of, slots = {}, {}
    for r in got:
        t = next(t for t in text_of[r.doc_id] if zlib.crc32(t.encode()) == r.text_crc32)
        assert r["size"] == len(t.encode()) + 1 and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        assert shard_of.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]


@pytest.mark.parametrize("items", [sharding.ITEMS, 40, 1])
def test_assign_shards(spark, items):
    r = np.random.default_rng(3)
    rows = [(int(i), "x" * int(n) + str(i)) for i, n in enumerate(r.integers(0, 400, 300))]
    rows += [(500 + i, "hot copy") for i in range(200)] + [(900, None), (901, ""), (None, "é"), (None, "é"), (7, "twin"), (7, "twin"), (7, "x" * 30000)]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], "doc_id long, text string, shard string, _h int").repartition(5)
    got = sharding.assign_shards(df, items=items).collect()
    sums = check(rows, got, 8)
    if items == sharding.ITEMS:
        assert sorted(sums)[-2] - min(sums) < 0.002 * sorted(sums)[-2]  # the longest text fills a shard alone
    if items == 40:
        assert sorted(sums)[-2] - min(sums) < 0.2 * sorted(sums)[-2]
    by_id = sorted((r.shard, r.doc_id is not None, r.doc_id or 0, r.slot) for r in got)
    assert [x[3] for x in by_id if x[0] == 0] == list(range(sum(x[0] == 0 for x in by_id)))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(empty).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r["size"], r.shard, r.slot) for r in sharding.assign_shards(one).orderBy("doc_id").collect()] == [(1, 0, 0), (1, 0, 1)]


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 7), "kept", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string, _shard int")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.note, r._shard) for r in back.collect()) == rows
    want = {r.doc_id: r.shard for r in sharding.assign_shards(df, 4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
