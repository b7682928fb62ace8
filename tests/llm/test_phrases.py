import re
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import phrases

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top, inside):
    """rows (lang, text) -> {(lang, rank, phrase, a, l, r, n, score)}"""
    f = {}
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                c.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found, n = [], sum(v for p, v in c.items() if len(p) == 1)
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) == 3 > len(p) and b >= least and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in c.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


def corpus(seed, n=60):
    r = np.random.default_rng(seed)
    words = ["the", "The", "a", "é", "É", "b", "deep", "sea", "x1", "Z"]
    rows = []
    for i in range(n):
        size = int(r.integers(0, 60))
        seps = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " \v", "\x1c"]
        text = "".join(words[int(r.zipf(1.4)) % len(words)] + seps[int(r.choice(len(seps), p=[.6, .1, .05, .1, .05, .04, .02, .02, .02]))] for _ in range(size))
        rows.append((["en", "fr", None, "und"][i % 4], text))
    return rows + [("en", None), ("en", ""), (None, " \t"), ("en", "..!!"), ("fr", rows[1][1]), ("fr", rows[1][1])]


@pytest.mark.parametrize("seed,least,block,piece", [(0, 10, 1 << 20, 1 << 22), (1, 3, 64, 40), (2, 2, 5, 7), (3, 4, 33, 1)])
def test_collocations(spark, seed, least, block, piece):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, la, "clash", 1) for la, t in rows], "text string, lang string, _p string, score int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least, 7, block=block, piece=piece).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, 7, 50)


def test_long_text_without_a_border(spark):
    text = "a b c d " * 30000 + "a b " + "w" * 300000
    df = spark.createDataFrame([("en", text), ("de", None)], "lang string, text string")
    got = {tuple(r) for r in phrases.collocations(df, block=1000, piece=5000).collect()}
    assert got == brute([("en", text)], 10, 2000, 50)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(df).count() == 0


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(99_999_999_999_999, 99_999_999_999_998, 99_999_999_999_997)], "a long, l long, r long")
    a, l, r = df.first()
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 1000000 * a * a // (l * r)


def test_extension_in_both_directions():
    r = np.random.default_rng(5)
    ids = np.concatenate([[0], r.integers(0, 4, 300), [0]])
    want = {k: Counter(tuple(ids[i:i + k]) for i in range(len(ids) - k + 1) if 0 not in ids[i:i + k]) for k in (1, 2, 3, 4)}
    for sides in ((False, False, False), (True, True, True), (False, True, False), (True, False, True)):
        index = phrases.WordIndex(ids, 4)
        found = index.words()
        for k, left in enumerate(sides, 2):
            found = index.extend(found, left)
            assert {tuple(p): n for p, n in zip(found["ids"].tolist(), found["n"].tolist())} == want[k]
