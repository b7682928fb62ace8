"""Phrase collocations from one FM-index per shard over word ids.

A task cuts its documents into blocks of at most ``BLOCK`` words.  Each block is an index: its word ids with a border
between pieces, sorted by the next words (Burrows-Wheeler order) and, for the other direction, by the words before.  A
phrase is an interval of rows in both orders.  Reading the transform over an interval lists the words that stand left (or
right) of the phrase with their counts, which are the phrases one word longer: intervals are extended that way, all
of one length at once, down to the given depth.  Counts of one phrase are summed over the blocks by Spark.

Words and pairs come first.  A phrase of three words can only reach the least count if both of its pairs do, so the second
enumeration extends no other pairs: frequent pairs are marked in a bitmap of fixed size, in which a wrong mark only costs work.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.llm.common import measured_side, text_of
from caseloom.session import materialize

#: Words of a block, bytes of a text that are cut into words at once, rows of an output batch, bits of the map of pairs.
BLOCK, SLICE, ROWS, MAP_BITS = 1 << 19, 1 << 22, 1 << 14, 24
#: Parts of a language that are ranked apart first.
SALTS = 64
#: No byte of UTF-8 text has this value, so it can stand for a border between pieces.
BORDER = b"\xff"
_FOLD = bytes(BORDER[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[ \t\xff]")


class WordIndex:
    """Burrows-Wheeler transforms of a sequence of ids and of its reverse; rows are sorted by ``depth`` ids.

    Ids are 0 (border) and up; the sequence starts and ends with a border and has fewer than 2 ** 21 ids.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth, self.bits = ids, depth, int(len(ids)).bit_length()
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids))])

    @cached_property
    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._transform(self.ids)

    @cached_property
    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        return self._transform(self.ids[::-1])

    def _transform(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id before each row, and all (id, row) in order."""
        n, b = len(ids), self.bits
        at, rank = np.arange(n), ids
        key = np.sort(ids << b | at)
        for k in range(1, self.depth):
            key = np.sort((rank << b | np.roll(ids, -k)) << b | at)  # a rank, an id and a place have at most ``b`` bits each
            rank = np.empty(n, np.int64)
            rank[key & ((1 << b) - 1)] = np.concatenate([[0], np.cumsum(np.diff(key >> b) != 0)])
        before = ids[(key & ((1 << b) - 1)) - 1]
        return before, np.sort(before << b | at)

    def words(self) -> dict[str, np.ndarray]:
        """Intervals of all single ids: start in both orders, size, and the ids."""
        w = np.nonzero(np.diff(self.first))[0]
        w = w[w > 0]
        return {"lo": self.first[w], "back": self.first[w], "n": self.first[w + 1] - self.first[w], "ids": w[:, None]}

    def extend(self, found: dict[str, np.ndarray], left: bool) -> dict[str, np.ndarray]:
        """All phrases one word longer on the left or right side."""
        before, places = self.forward if left else self.backward
        own, other = ("lo", "back") if left else ("back", "lo")
        n, b = found["n"], self.bits
        if not len(n):
            return {**found, "ids": np.zeros((0, found["ids"].shape[1] + 1), np.int64)}
        owner, ahead = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        key = np.sort(owner << b | before[np.arange(len(owner)) + np.repeat(found[own] - ahead, n)])
        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        size = np.diff(np.append(start, len(key)))
        parent, word = key[start] >> b, key[start] & ((1 << b) - 1)
        keep = word > 0
        parent, word, size, start = parent[keep], word[keep], size[keep], start[keep]
        new = np.searchsorted(places, word << b | found[own][parent])
        smaller = start - ahead[parent]  # rows of the parent with a smaller word: they come first in the other order
        ids = found["ids"][parent]
        return {own: new, other: found[other][parent] + smaller, "n": size, "ids": np.column_stack([word, ids] if left else [ids, word])}


def select(found: dict[str, np.ndarray], keep: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[keep] for k, v in found.items()}


class _Block:
    """Word ids of pieces; words of one spelling in two languages have two ids."""

    def __init__(self, keep: int):
        number = count(1)
        self.ids_of: dict = defaultdict(lambda: defaultdict(number.__next__, {BORDER: 0}))
        self.parts, self.size, self.keep, self.last = [np.zeros(1, np.int64)], 1, keep, []

    def add(self, lang: str, tokens: list[bytes]) -> None:
        ids = self.ids_of[lang]
        self.parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)
        self.last = (self.last + tokens[-self.keep:])[-self.keep:] if self.keep else []
        if BORDER in self.last:
            self.last = self.last[len(self.last) - self.last[::-1].index(BORDER):]

    def sealed(self) -> tuple[np.ndarray, list[bytes], list[str]]:
        """Ids between borders, and the word and language of each id."""
        size = 1 + sum(len(x) - 1 for x in self.ids_of.values())
        words, langs = [b""] * size, [""] * size
        for lang, ids in self.ids_of.items():
            for w, i in ids.items():
                if i:
                    words[i], langs[i] = w, lang
        return np.concatenate([*self.parts, np.zeros(1, np.int64)]), words, langs


def _tokens(data: bytes, size: int) -> Iterator[list[bytes]]:
    """Words and borders of a text, some megabytes at a time."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        cut = _GAP.search(data, min(len(data), at + size))
        end = cut.start() if cut else len(data)
        yield data[at:end].replace(BORDER, b" \xff ").split()
        at = end


def _blocks(batches: Iterator[pa.RecordBatch], depth: int, block: int, piece: int) -> Iterator[tuple[_Block, str, list[bytes]]]:
    """Full blocks, each with the last words of a piece that goes on in the next block, which starts with them again."""
    b = _Block(depth - 1)
    for batch in batches:
        for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_t")):
            for tokens in _tokens(text.as_buffer().to_pybytes(), piece):
                at = 0
                while at < len(tokens):
                    part = tokens[at:at + block - b.size]
                    b.add(lang, part)
                    at += len(part)
                    if b.size >= block:
                        yield b, lang, b.last
                        tail, b = b.last, _Block(depth - 1)
                        b.add(lang, tail)
            b.add(lang, [BORDER])
            if b.size >= block:
                yield b, lang, []
                b = _Block(depth - 1)
    if b.size > 1:
        yield b, "", []


def _hash(lang: str, word: bytes) -> int:
    """Spark's ``xxhash64`` of language, space and word."""
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word, seed=42)


def _marked(marks: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the map of :func:`_pair_map` has the pairs of words with these hashes."""
    slot = ((one ^ (two >> np.uint64(MAP_BITS))) & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _rows(found: dict[str, np.ndarray], words: pa.Array, langs: pa.Array) -> Iterator[pa.RecordBatch]:
    """Batches (language, phrase, words, count)."""
    ids, n = found["ids"], found["n"]
    for k in range(0, len(n), ROWS):
        part = ids[k:k + ROWS]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(part[:, j])) for j in range(part.shape[1])], " ")
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(part[:, 0])), phrase, pa.array(np.full(len(part), part.shape[1], np.int32)), pa.array(n[k:k + ROWS])],
            names=["_lang", "_p", "_k", "_n"])


def phrase_counts(docs: DataFrame, depth: int, pairs: bytes | None = None, block: int = BLOCK, piece: int = SLICE) -> DataFrame:
    """(``_lang``, ``_p``, ``_k`` words, ``_n``) per block, to be summed; ``docs`` has ``_lang`` and ``_t``.

    Without ``pairs`` all phrases of 1 to ``depth`` words; with the map of frequent pairs (``depth`` 3) those of three words
    whose pairs are marked.  A phrase that two blocks share at a cut inside a piece is taken off once, as a negative count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for b, lang, tail in _blocks(batches, depth, block, piece):
            ids, words, langs = b.sealed()
            if len(words) == 1:
                continue
            index = WordIndex(ids, depth - 1)
            spelled, spoken = pa.array(words, pa.string()), pa.array(langs, pa.string())
            found = index.words()
            if marks is None:
                yield from _rows(found, spelled, spoken)
                for _ in range(1, depth):
                    found = index.extend(found, left=False)
                    yield from _rows(found, spelled, spoken)
                twice = [tail[i:j] for i in range(len(tail)) for j in range(i + 1, len(tail) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(twice), pa.string()), pa.array([b" ".join(x) for x in twice], pa.string()),
                     pa.array([len(x) for x in twice], pa.int32()), pa.array([-1] * len(twice), pa.int64())], names=["_lang", "_p", "_k", "_n"])
                continue
            hashes = np.array([0] + [_hash(la, w) for la, w in zip(langs[1:], words[1:])], np.uint64)
            for left in (False, True):  # pairs to the right of a word, then triples to the left of a pair
                found = index.extend(found, left)
                found = select(found, _marked(marks, hashes[found["ids"][:, 0]], hashes[found["ids"][:, 1]]))
            yield from _rows(found, spelled, spoken)

    return docs.select("_lang", "_t").mapInArrow(work, "_lang string, _p string, _k int, _n long")


def _pair_map(pairs: DataFrame) -> bytes:
    """Bitmap of the pairs (``_lang``, ``_w`` two words): 2 MB whatever their number."""
    h = [F.xxhash64(F.concat_ws(" ", "_lang", F.col("_w")[i])) for i in (0, 1)]
    slot = h[0].bitwiseXOR(F.shiftrightunsigned(h[1], MAP_BITS)).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = pairs.select(slot.alias("_s")).groupBy(F.shiftright("_s", 5).cast("int").alias("_i"))
    rows = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 31 as int))")).alias("_b")).toArrow()  # at most 2 ** 19 rows
    out = np.zeros(1 << MAP_BITS - 5, "<u4")
    out[rows.column("_i").to_numpy()] = rows.column("_b").to_numpy().astype("<u4")
    return out.tobytes()


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("_lang", "_p", "_k").agg(F.sum("_n").alias("_f"))


def _score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r)), exact up to counts of fourteen digits."""
    a, l, r = (f"cast({c} as decimal(14,0))" for c in (a, l, r))
    return F.expr(f"({a} * {a} * 1000000BD) div ({l} * {r})")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: float = 0.5, text_col: str = "text",
                 lang_col: str = "lang", block: int = BLOCK, piece: int = SLICE) -> DataFrame:
    """The best phrases of two and three words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts at its lowest-scoring cut, ``n`` all words of the language.  A phrase
    needs ``least`` occurrences and goes if a longer one around it has a share of ``inside`` (in hundredths) of its count.

    A null text has no words, a null language is ``und``.  Repeated rows count each time.  Texts and pieces may have any
    length.  Ties are ordered by count, then by the phrase's bytes.  Other columns are not read; an empty table, or a
    language without a frequent phrase, gives no rows.
    """
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), text_of(text_col).alias("_t"))
    counts = _summed(phrase_counts(d, 2, None, block, piece)).where((F.col("_k") == 1) | (F.col("_f") >= least))
    counts = materialize(counts, "phrase-counts")
    single, frequent = counts.where("_k = 1"), F.col("_f") >= least
    total = measured_side(single.groupBy("_lang").agg(F.sum("_f").alias("n")), "phrase-totals", 64)
    words = measured_side(single.where(frequent).select("_lang", F.col("_p").alias("_w"), "_f"), "phrase-words", 96)
    pairs = counts.where("_k = 2").select("_lang", "_p", F.split("_p", " ").alias("_w"), F.col("_f").alias("a"))
    triples = _summed(phrase_counts(d, 3, _pair_map(pairs), block, piece)).where(frequent)
    triples = materialize(triples.select("_lang", "_p", F.split("_p", " ").alias("_w"), F.col("_f").alias("a")), "phrase-triples")
    for name, i in (("_head", 1), ("_rest", 2)):
        triples = triples.withColumn(name, F.concat_ws(" ", F.slice("_w", F.lit(i), F.lit(2))))

    def word(i: int, name: str) -> DataFrame:
        return words.select("_lang", F.col("_w").alias(f"_w{i}"), F.col("_f").alias(name))

    def pair(key: str, name: str) -> DataFrame:
        return pairs.select("_lang", F.col("_p").alias(key), F.col("a").alias(name))

    around = triples.select("_lang", "a", F.explode(F.array("_head", "_rest")).alias("_p"))
    around = around.groupBy("_lang", "_p").agg(F.max("a").alias("_around"))
    two = pairs.withColumns({f"_w{i}": F.col("_w")[i] for i in (0, 1)}).join(word(0, "l"), ["_lang", "_w0"]).join(word(1, "r"), ["_lang", "_w1"])
    two = two.withColumn("score", _score("a", "l", "r")).join(around, ["_lang", "_p"], "left")
    two = two.where(F.col("_around").isNull() | (100 * F.col("_around") < F.lit(round(100 * inside)) * F.col("a")))
    three = triples.withColumns({f"_w{i}": F.col("_w")[i] for i in (0, 2)})
    three = three.join(word(0, "_l1"), ["_lang", "_w0"]).join(pair("_rest", "_r1"), ["_lang", "_rest"])
    three = three.join(pair("_head", "_l2"), ["_lang", "_head"]).join(word(2, "_r2"), ["_lang", "_w2"])
    three = three.withColumns({"_s1": _score("a", "_l1", "_r1"), "_s2": _score("a", "_l2", "_r2")})
    later = F.col("_s2") < F.col("_s1")
    three = three.withColumns({o: F.when(later, F.col(f"_{c}2")).otherwise(F.col(f"_{c}1")) for o, c in (("l", "l"), ("r", "r"), ("score", "s"))})
    columns = ["_lang", "_p", "a", "l", "r", "score"]
    ranked, order = two.select(*columns).union(three.select(*columns)), [F.desc("score"), F.desc("a"), "_p"]
    for parts in ([F.pmod(F.xxhash64("_p"), F.lit(SALTS))], []):  # the best of each part first: no task ranks a whole language
        best = W.partitionBy("_lang", *parts).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(total, "_lang").select(
        F.col("_lang").alias("lang"), F.col("rank").cast("long").alias("rank"), F.col("_p").alias("phrase"), "a", "l", "r", "n", "score")
