import hashlib
import random
from collections import Counter

from caseloom.llm import suffix_dedup as sd


def brute(rows, length=sd.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    c = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (k, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if c[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((k, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_matches_counting_every_string(spark):
    r = random.Random(4)

    def words(n):
        return " ".join(r.choice(["erst", "the", "über", "çon", "ing", "of"]) + str(r.randrange(50)) for _ in range(n))

    p1, p2, p3 = words(45), words(300), words(33)
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "ab" * 400, "é" * 300, p1, p1 + words(3), words(9) + p1 + words(60) + p1,
             p2, p2[:900] + words(2) + p2[900:], words(80) + p2[100:1100] + words(5), p3 + p3 + p3, words(40) + p3[:199], p3[:200] + words(50)]
    texts += [words(200) for _ in range(6)] + [p2] * 3 + ["x" + p2[7:], "𝒳" + p2[3:1500]]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(300, p1 + "!"), (300, p1 + "!"), (None, words(30) + p3)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted((tuple(x) for x in sd.remove_repeats(df).drop("kept").collect()), key=repr)
    assert got == brute(rows)
    spread = sd.remove_repeats(df, task_names=1).drop("kept").collect()  # every bucket by the grouping of windows
    assert sorted((tuple(x) for x in spread), key=repr) == brute(rows)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_segments_cover_all_windows_and_chunks_agree():
    r = random.Random(1)
    data = bytes(r.choice(b"abc ") for _ in range(5000))
    for chunk in (sd.CHUNK, 700):
        a, n, *_ = sd.segments(data, chunk=chunk)
        assert [x for s, k in zip(a, n) for x in range(s, s + k)] == list(range(len(data) - sd.LENGTH + 1))
