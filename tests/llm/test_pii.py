import hashlib
import random
import re

import pytest

from caseloom.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    out = {k: [(m.start(), m.end()) for m in p.finditer(text or "") if valid(k, m.group())] for k, p in RULES.items()}
    return out, ",".join(f"{k}:{s}:{e}" for k in RULES for s, e in out[k])


TEXTS = [
    None, "", "no data at all", "𝒳 a.b@c.d é x@y.z.w @ @.. me@host a@b.c@d.e.f a@b.c_x@d.ee",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.001 1.2.3 9999999999999999999999999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 22 5555555555554444",
    "+1 (017) 555-7713 +12345678 +1234567 +1..........2 ++49 30 1234567 +123456789012345 6",
    "x" * 30000 + " a@b.cc", "1" * 30000, "1 " * 9000, "12,12," * 700 + "z 10.0.0.1", "a@b.co " * 900,
]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice(["1", "2", "9", "0", ".", "-", " ", "+", "@", "a", "é", "𝒳", "(", ")", "\n", "_", "4111111111111111"])
                   for _ in range(r.randint(1, 160)))


def test_base_spans_match_the_plain_patterns(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + [noise(s) for s in range(300)])]
    df = spark.createDataFrame(rows + rows[3:5] + [(None, "z@z.zz", None)], "doc_id long, text string, spans string")
    got = pii.pii_spans(df).collect()
    assert len(got) == len(rows) + 3
    texts = {r[0]: r[1] for r in rows} | {None: "z@z.zz"}
    for r in got:
        n, s = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(n[k]) for k in RULES), texts[r.doc_id]
        assert r.spans == s and r.base_sha256 == hashlib.sha256(s.encode()).hexdigest()


def test_disclosing_terms(spark):
    rows = [(i, f"a{i} Zorro b{i} wrote z@corp.org today") for i in range(10)]
    rows += [(100 + i, f"plain words wrote today from {i}") for i in range(90)]
    rows += [(200 + i, f"copied text of Quux here 10.0.0.1{" " * i}") for i in range(20)]  # one context: one witness
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_spans(df).collect()}
    assert all(got[i] == "email:18:28,term:3:8" for i in range(10))
    assert all("term" not in x for i, x in got.items() if i >= 100)
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] == "a1 [TERM] b1 wrote [EMAIL] today" and red[105] == rows[15][1]


def test_fixed_signature_and_near_copies(spark):
    r = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rst", "ll", "sk")]

    def words(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    rows = [(i, f"{words(30)}. Best, Jane Doe <jane@corp.org>") for i in range(12)]  # the same neighbours in each text
    rows += [(100 + i, f"{words(30)} Best") for i in range(200)]
    base = words(60).split()
    for i in range(20):  # near copies: one witness, though the neighbours of Vex differ
        w = base[:30] + [f"k{i}", "Vex", f"m{i}"] + base[30:]
        rows.append((400 + i, " ".join(w) + " 10.0.0.1"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert all(got[i].endswith("Best, [TERM] [TERM] <[EMAIL]>") and got[i].count("[TERM]") == 2 for i in range(12))
    assert not any("[TERM]" in t for i, t in got.items() if i >= 100)


def test_values_of_few_texts(spark):
    r = random.Random(6)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rst", "ll", "sk")]

    def words(n):
        return " ".join(r.choice(vocab) for _ in range(n))

    rows = [(i, f"{words(12)} Quill {words(9)} quill{i // 3}@solo.net") for i in range(3)]  # one value in three texts
    rows += [(100 + i, f"{words(12)} Zorro {words(9)} p{i}@corp.org") for i in range(12)]  # each value in one text
    rows += [(200 + i, f"{words(12)} Hapax{i} {words(9)} 10.{i}.{i}.1") for i in range(12)]  # each word once
    rows += [(300 + i, words(25)) for i in range(1500)]
    got = {x.doc_id: x.text for x in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].count("[TERM]") == 1 and "Quill" not in got[i] for i in range(3))
    assert all(got[i].count("[TERM]") == 1 and "Zorro" not in got[i] for i in range(100, 112))
    assert not any("[TERM]" in t for i, t in got.items() if i >= 200)


def test_redact_overlaps_and_empty(spark):
    df = spark.createDataFrame([(1, "x +4111111111111111 y 10.0.0.1"), (2, None), (3, "é a@b.cc!")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[2] is None and got[3] == "é [EMAIL]!" and "[IP]" in got[1] and "1111" not in got[1] and got[1].startswith("x +[CARD] y")
    assert pii.pii_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_total(spark, n):
    from caseloom.llm.common import running_total
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.slice(F.transform(F.sequence(F.lit(0), F.lit(1200)), lambda x: (x * 7 % 13).cast("long")), 1, n).alias("a"))
    a, b = df.select("a", running_total(F.col("a"))).first()
    acc, want = 0, []
    for x in a:
        acc += x
        want.append(acc)
    assert (b or []) == want
