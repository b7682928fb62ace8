"""The whole pipeline over a small table, against its stages in plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm import pii
from tests.llm.test_dedup_quality import WS, brute_quality
from tests.llm.test_join_packing import brute_components
from tests.llm.test_pii import brute as brute_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _email string"


def documents():
    r = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("mi", "tor", "la", "bes") for b in "aeiou" for c in ("n", "rd", "st", "k")]
    new = lambda n: " ".join(r.choice(vocab) + str(r.randrange(30)) for _ in range(n))
    texts = [None, "", "too short", "same words again " * 40, "#$% " * 30 + new(60), new(60).upper(), "\n".join(["a line that repeats"] * 30 + [new(5)])]
    for _ in range(10):
        base = new(r.randint(60, 200))
        texts += [base, base.replace(" ", "\t", 3), base + " and more"]  # exact after white space, and near
    texts += [new(70) + " mail ann.lee@corp.example.org or +44 20 7946 0958 now " + new(5), new(70) + " 10.1.2.3 and 4111 1111 1111 1111 " + new(9)]
    texts += [new(15000), new(55) + " é𝒳 " * 3]
    rows = [(i * 7 % 101, t, "en", "s", None if t is None else len(t), "clash", "own") for i, t in enumerate(texts)]
    return rows + [(500, texts[8], "en", "s", 1, "clash", "own")]


def passes_rules(t):
    n, chars, symbols, repeated_lines, _, failed = brute_quality(t)
    lines = [x for x in (t or "").split("\n") if WS.sub("", x)]
    upper = sum(c.isupper() for c in t or "")
    return not (failed or symbols * 5 > n or upper * 2 > chars or repeated_lines * 2 > len(lines) or chars < n * 2 or chars > n * 100)


def masked(t):
    spans = sorted((s, e, pii.MASK[k]) for k, found in brute_spans(t)[0].items() for s, e in found)
    out, at = "", 0
    for s, e, mask in spans:
        if s >= at:
            out += t[at:s] + mask
        at = max(at, e)
    return out + t[at:]


def plain_pipeline(rows):
    """doc_id -> text that reaches packing."""
    kept = [(d, t) for d, t in rows if passes_rules(t)]
    first = {}
    for d, t in kept:
        n = WS.sub(" ", t)
        first[n] = min(first.get(n, d), d)
    kept = [(d, t) for d, t in kept if first[WS.sub(" ", t)] == d]
    groups = {d: c for d, _, c in brute_components(kept)}
    return {d: masked(t) for d, t in kept if groups[d] == d}


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_pipeline([(d, t) for d, t, *_ in rows])
    assert 12 <= len(want) < 20 and any("[EMAIL]" in t or pii.MASK["email"] in t for t in want.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        ids = tok.encode(want[d], add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 1024


def test_pipeline_stages_keep_their_columns(spark, tmp_path):
    df = spark.createDataFrame(documents(), COLUMNS)
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        assert {(r._gone, r._email) for r in docs.select("_gone", "_email").collect()} == {("clash", "own")}
    assert re.fullmatch(r"[a-zA-Z -]+", "-".join(name for name, _ in corpus_pipeline.STAGES))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
