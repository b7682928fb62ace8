import hashlib
import re

from pyspark.sql import functions as F

from caseloom.llm import exact_dedup as dedup, quality

WS = re.compile(r"[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a  b", "a b", "a\tb", "a b", "A b", "x" * 40000, "x" * 40000, "é\n\né", "é é", None]


def brute(rows):
    norm = {i: WS.sub(" ", t or "") for i, (_, t) in enumerate(rows)}
    out = []
    for i, (d, _) in enumerate(rows):
        g = [rows[j][0] for j in norm if norm[j] == norm[i]]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    rows = [(i * 3 % 13, t) for i, t in enumerate(TEXTS)] + [(50, "twin"), (50, "twin"), (None, "a b"), (None, "alone")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, keep_id string, _h int")
    got = sorted((tuple(r) for r in dedup.exact_dedup(df).collect()), key=repr)
    assert got == brute(rows)
    weak = dedup.exact_dedup(df, content_hash=lambda t: F.length(t) % 2)  # colliding hashes must not merge texts
    assert sorted((tuple(r) for r in weak.collect()), key=repr) == brute(rows)
    kept = dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def brute_quality(t):
    t = t or ""
    w = [x for x in WS.split(t) if x]
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WS.sub("", x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed


def test_quality(spark):
    texts = [None, "", "\n \t", "a b", "a a a a a", "a b c " * 30, "one two three four " + "five six seven eight " * 2,
             "\n".join(["same line"] * 4 + [" same line", "x"]), "é 𝒳 | *** <b> 100% $5 & #1", " ".join(f"w{i}" for i in range(300)),
             " ".join(f"w{i % 90}" for i in range(120)), "a b c d a b c x a b c d", "y " * 2000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(1, "", None), (None, "z", "")],
                               "doc_id long, text string, n_words string")
    got = quality.quality_features(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {9, 10}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {9, 10}
    assert quality.quality_features(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_order_is_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "aaaa ### bbbb") for i in range(20)], "doc_id long, text string")
    names = [r.name for r in quality.order_rules(df)]
    assert set(names[:2]) == {"too_short", "symbols"} and len(names) == len(quality.RULES)
