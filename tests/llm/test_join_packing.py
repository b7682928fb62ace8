import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from caseloom.llm import ngram_join as nj, packing


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter) and inter:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = [None, "", " \n", "Short Text", "short text", "SHORT\ttext", "a b c d", "a b c d e", "É b c d e", "é b c d e"]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(6, 120))] + (passage if r.random() < 0.5 else [])
        for _ in range(r.choice([1, 1, 2, 5, 9])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(w))
                w[k:k + r.choice([0, 1, 1])] = [r.choice(vocab)]
            texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[i:i + 40]) for i in range(0, 20, 4)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, component_id string").repartition(4)
    assert sorted(map(tuple, nj.near_duplicates(df).collect())) == brute_components(rows)


def test_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, nj.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2)], key=repr)
    assert nj.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_one_vertex(spark):
    """Id 5 has a copy of id 1, a near copy of id 2 and a text of its own; id 9 is a copy of the latter."""
    one, two, own = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = " ".join(two[:57] + ["z"])
    rows = [(1, one), (5, one), (2, two), (5, near.split()), (5, own), (9, own), (7, ["q"] * 9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in nj.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (9, 1), (7, 7)}


@pytest.mark.parametrize("block", [1, 60, 1 << 20])
def test_shingles_of_a_block_are_those_of_each_text(monkeypatch, block):
    """Word lengths around eights and the limit, zero bytes, every white space, short and empty texts, slices."""
    monkeypatch.setattr(nj, "BLOCK_BYTES", block)
    r = random.Random(block)
    long = "x" * 62
    words = ["a", "A", "a\0", "\0", "é", "É", "[", "@", "z", "Z", "12345678", "123456789", "12345678\0", "k" * 16, "k" * 17,
             *[long + e for e in ("", "y", "z", "yy", "yz", "yyy", "yyz", "yyyyyyyyyy")], "no\u00a0break", "\x1c"]
    texts = ["", " ", "\t\n\v\f\r ", *words, *[" ".join(words[i:i + n]) for n in range(1, 7) for i in range(20)]]
    for _ in range(100):
        n = r.choice([0, 1, 2, 3, 4, 5, 6, 30, 200])
        texts.append(r.choice(["", "  "]) + "".join(r.choice(words) + r.choice([" ", "\n", "\t\r", "\v\f "]) for _ in range(n)) + r.choice(["", "end"]))
    r.shuffle(texts)
    got = {}
    for some, h, at in nj.shingles(pa.array(["cut off", *texts, "cut off"])[1:-1]):
        for i, text in enumerate(texts[some]):
            got[text] = h[at[i]:at[i + 1]].tolist()
    assert set(got) == set(texts)
    names = {}
    for text, hashes in got.items():
        w = text.encode().lower().split()
        want = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert hashes == sorted(set(hashes)) and len(hashes) == len(want)
        for shingle in want:  # the hashes of all texts that hold it have one in common, its own
            names[shingle] = names.get(shingle, set(hashes)) & set(hashes)
    alone = [names[s].pop() for s in names if len(names[s]) == 1]
    assert len(alone) == len(set(alone)) > 100 and all(names.get((w.encode().lower(),)) is not None for w in words if w.strip())
    assert list(nj.shingles(pa.array([], pa.string()))) == []


def test_prefixes_are_rare_first(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "_id long, _t string").fillna("", "_t").coalesce(1)
    counts = nj._bucket_counts(df)
    assert counts.sum() == sum(n for _, n, _ in brute_components(rows))
    for r, (_, t) in zip(nj._signatures(df, counts, 75).sort("_id").collect(), sorted(rows)):
        (_, s, _), = nj.shingles(pa.array([t or ""]))
        order = np.lexsort((s, counts[(s >> np.uint64(64 - nj.BUCKET_BITS)).astype(np.int64)]))
        assert r._prefix == s[order][:len(s) - -(-75 * len(s) // 100) + 1].view(np.int64).tolist() and r._n == len(s)


def test_counting_follows_the_text_and_not_the_documents(spark):
    """Short documents cost what their words cost; each used to cost a vector over all buckets."""
    def seconds(n):
        df = spark.range(n).selectExpr("concat('some few words of document ', id) AS _t").coalesce(1)
        start = time.monotonic()
        assert nj._bucket_counts(df).sum() == 2 * n
        return time.monotonic() - start

    seconds(10)
    assert seconds(40_000) < seconds(10) + 4


def test_group_of_near_copies_takes_further_rounds(spark, monkeypatch):
    """Each copy links with one in seven others, so two rounds leave most outside and a third one with several hubs follows."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(400):
        k = r.randrange(5, 55)
        texts.append(" ".join(base[:k] + [f"own{i}"] + base[k + 1:]))
    rows = list(enumerate(texts))
    pairs, real = [], nj.materialize

    def counted(df, label="stage"):
        out = real(df, label)
        if label.startswith("pairs-"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(nj, "materialize", counted)
    got = sorted(map(tuple, nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows)
    assert len(pairs) > 3


def test_halves_of_hashes_never_contradict_whole_ones():
    r = np.random.default_rng(5)
    seen = set()
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.choice([0.8, 0.86, 0.9, 1])], r.integers(0, 2**64, n // 8 + 1, dtype=np.uint64)]))
        want = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        half = nj.verdict(*[(x >> np.uint64(32)).astype(np.uint32) for x in (a, b)], 75, False)
        assert nj.verdict(a, b, 75, True) is want and half in (want, None)
        seen.add(half)
    assert seen == {True, False, None}
    zeros = np.zeros(6, np.uint32)  # equal upper halves of different hashes are left open, never taken for a link
    assert nj.verdict(zeros, zeros, 75, False) is None


def test_suffix_filter_is_a_bound():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 300, r.integers(0, 120)).astype(np.uint64))
        b = np.unique(r.integers(0, 300, r.integers(0, 120)).astype(np.uint64))
        assert nj.overlap_bound(a, b) >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_the_histogram(seed):
    r = np.random.default_rng(seed)
    size = int(r.choice([10, 64, 1024]))
    lengths = r.choice(np.arange(1, size), min(size - 1, int(r.integers(1, 200))), replace=False)
    h = {int(n): int(c) for n, c in zip(lengths, r.integers(1, 400, len(lengths)))}
    plan = packing.plan_patterns(h, size)
    got = {}
    for p, t in plan:
        assert t > 0 and sum(n * k for n, k in p.items()) <= size
        for n, k in p.items():
            got[n] = got.get(n, 0) + k * t
    assert got == h
    rest, order = [h[n] for n in sorted(h, reverse=True)], sorted(h, reverse=True)
    largest_first = sum(t for _, t in packing._greedy(order, rest, size))
    assert -(-sum(n * c for n, c in h.items()) // size) <= sum(t for _, t in plan) <= largest_first + len(h) // 8 + 2


def test_program_is_solved_beside_a_session(spark):
    """A full histogram, planned in a process that runs Spark: ends at the price test or the gap, and in seconds."""
    r = np.random.default_rng(0)
    assert spark.range(10).count() == 10
    for m in (127, 1023):
        lengths, demand = list(range(1023, 1023 - m, -1)), r.integers(1, 500, m).astype(float)
        start = time.monotonic()
        columns, uses, bound = packing.solve_program(lengths, demand, 1024, rounding=0)
        assert time.monotonic() - start < 60
        assert np.allclose((columns * uses).sum(axis=1), demand) and (uses > -1e-6).all()
        assert ((columns * np.array(lengths)[:, None]).sum(axis=0) <= 1024).all()
        assert bound - 1e-6 <= uses.sum() <= bound * (1 + packing.GAP) + 1e-6
        assert bound >= (demand * np.array(lengths)).sum() / 1024 - 1e-6


def test_program_ends_at_the_price_test():
    """Without a gap: the optimum, which the bound proves, and a smaller one than the first solution."""
    r = np.random.default_rng(1)
    lengths, demand = sorted(r.choice(np.arange(20, 100), 12, replace=False).tolist(), reverse=True), r.integers(5, 90, 12).astype(float)
    first = packing._fractional_start(lengths, demand, 100)[1].sum()
    columns, uses, bound = packing.solve_program(lengths, demand, 100, gap=0, rounding=0)
    assert np.isclose(uses.sum(), bound) and uses.sum() < first - 1e-6 and np.allclose((columns * uses).sum(axis=1), demand)


def test_inverse_of_the_first_basis():
    lengths, demand = [9, 7, 5, 3, 2], np.array([4., 9, 1, 7, 30])
    columns, _, order = packing._fractional_start(lengths, demand, 20)
    inverse = packing._inverse(columns, order)
    assert np.allclose((columns[:, :, None] * inverse[None]).sum(axis=1), np.eye(5))


def test_pack(spark):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(5)
    texts = [None, "", "x", "same text"] + ["same text"] * 20 + [" ".join(r.choice(["the", "of", "ing", "erst"]) for _ in range(r.choice([3, 50, 700, 1500, 2047, 5000]))) for _ in range(60)]
    rows = [(i * 5 % 997, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(2000, "twin", ""), (2000, "twin", "")], "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(df, P.path("byte_bpe_50k.json")).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows + [(2000, "twin", "")]}
    by_doc, by_seq = {}, {}
    for p in got:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        pieces = sorted(pieces)[:: 2 if d == 2000 else 1]
        assert [s for s, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) == len(ids[d])
    for pieces in by_seq.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 1024
    assert sorted(by_seq) == list(range(len(by_seq)))
    total = sum(n for v in by_seq.values() for _, n in v)
    assert len(by_seq) <= total / 1024 * 1.05 + 2
    assert packing.pack(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
