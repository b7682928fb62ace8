import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import bpe, token_files as tf, tokens
from caseloom.session import scratch_path

TEXTS = [
    None, "", " ", "\n", "a", "it's we'll  two   three\n\n\nfour \t five\r\n x y  z", "trailing  ", "trailing \n", " lead", "\n\nlead",
    "a\n b", "a \nb", "a  b", "a   b", "x" * 5000, " " * 700, "ab" * 3000, "naïve café 日本語テスト \U0001d4b3́ ٢٣",
    "<|endoftext|> <|endoftext|>", "*** ### 100% $$$", "\x1c\x1d \x85   z", "!!!???...   　 .", "1234567890 " * 50, "The.\nThe", "﻿ bom ​ zw",
]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "9", ".", "é", "日", "the", "ing", " ", "ß", "tion"]) for _ in range(r.randint(1, 80)))


ALL = TEXTS + [noise(s) for s in range(400)]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_matches_the_library(spark, ranks):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ALL)] + [(None, "x", 1), (4, "a", 1)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ALL) + 2
    for r in got:
        if r.doc_id is not None:
            t = ALL[r.doc_id] or ""
            ids = lib.encode_ordinary(t)
            raw = np.array(ids, "<u4").tobytes()
            assert bytes(r.ids) == raw, t
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_backtracking_on_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)}
    for i, t in enumerate([b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aaaa", b"abcd"]):
        ranks[t] = 256 + i
    coder = bpe.BytePairCoder(ranks, r"(?s).+")
    r = random.Random(7)
    for _ in range(2000):
        s = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 14)))
        assert coder.encode_piece(s) == ([ranks[s]] if s in ranks else coder.merge(s))


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 24, 31])
def test_pack_round_trip(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 7, 64, 1001):
        ids = r.integers(0, 1 << width, n, dtype=np.uint32)
        assert len(tf.pack(ids, width)) == (n * width + 7) // 8
        assert (tf.unpack(tf.pack(ids, width), width, n) == ids).all()
        f = tf.TokenFile(io.BytesIO(b"".join(tf.file_bytes([1, 5], [n, 0], ids, width, block=37))))
        for a, b in ((0, n), (n // 3, n // 2), (36, 3), (n - 1, 1)):
            if 0 <= a and a + b <= n:
                assert (f.slice(a, b) == ids[a:a + b]).all()
    assert tf.width_for(50257) == 16 and tf.width_for(2) == 1 and tf.width_for(257) == 9


@pytest.mark.parametrize("size", [50_257, 70_000])
def test_token_files(spark, size):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = ["<|endoftext|>", "a \n<|endoftext|>\n b <|endoftext|>.x", "one <|endoftext|><|endoftext|>  two"]
    assert 50256 in t.encode(special[0], add_special_tokens=False).ids
    rows = [(i * 7 % 1009, x, "clash") for i, x in enumerate([*ALL, *special])] + [(2000, "twin"  , ""), (2000, "twin", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = tf.round_trip(df, P.path("byte_bpe_50k.json"), 2, size).collect()
    want, at = [], 0
    for i, x, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    assert tf.round_trip(df.limit(0), P.path("byte_bpe_50k.json"), 2, size).count() == 0


def test_files_are_read_by_several_tasks(spark):
    df = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40).alias("text"))
    out = scratch_path(spark, "spread")
    manifest = tf.write_token_files(df, P.path("byte_bpe_50k.json"), 2, out, 50_257, file_ids=20_000)
    files = manifest.count()
    back = tf.read_token_files(manifest, out)
    assert files >= 4 and back.rdd.getNumPartitions() == files
    assert back.select(F.spark_partition_id()).distinct().count() == files
    rows = back.orderBy("doc_id").collect()
    assert [r.start for r in rows] == [i * rows[0].n_tokens for i in range(4000)]


def test_folders_are_qualified(spark):
    assert tf.qualified(spark, "/tmp/a b/c") == tf.qualified(spark, "file:/tmp/a b/c") == "file:///tmp/a%20b/c"


def test_odd_spaces_of_ascii_texts():
    r = random.Random(9)
    for _ in range(5000):
        text = "".join(r.choice(["a", "b", " ", "\n", r.choice("\t\r\x0b\x0c\x1c\x1f\x7f")]) if r.random() < 0.5 else "w" for _ in range(r.randint(0, 12)))
        assert tokens.odd_spaces(text) == (tokens._ODD.search(text) is not None)
    assert tokens.odd_spaces("é\u00a0x") and not tokens.odd_spaces("é x")


def test_backtracking_equals_merges(ranks):
    """Pieces of short letters, where the longest tokens often do not fit together."""
    coder = bpe.BytePairCoder(ranks, P.PATTERN)
    r, stepped = random.Random(2), 0
    for _ in range(3000):
        s = "".join(r.choice("aeinorst") for _ in range(r.randint(2, 24))).encode()
        if s not in ranks:
            longest = [i for _, (_, i) in coder.automaton.iter_long(s.decode())]
            want = coder.merge(s)
            stepped += longest != want
            assert coder.encode_piece(s) == coder._backtracked(s.decode()) == want
    assert stepped > 300


def test_words_of_letters_skip_the_steps_around_the_model(monkeypatch):
    enc = tf.LibraryEncoder(P.path("byte_bpe_50k.json"))
    texts = ["a few naïve words, über alles", "x Straße ÿ ŉ ɐb 日本 a1 don't it's ǅ", "end.  two\n\nlines ª º"]
    want, asked = [enc.whole(t) for t in texts], []
    whole = enc.by_word.encode
    monkeypatch.setattr(enc.by_word, "encode", lambda piece: asked.append(piece) or whole(piece))
    assert [enc(t) for t in texts] == want
    assert not {" few", " words", " über", " alles"} & set(asked)


def test_other_settings_keep_the_whole_way():
    from tokenizers import normalizers

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert tf.plain_byte_level(library)
    library.normalizer = normalizers.Lowercase()
    assert not tf.plain_byte_level(library)
