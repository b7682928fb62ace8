"""Byte-level BPE encoding and decoding by longest matches and backtracking.

Bytes are read as Latin-1 characters, so an Aho-Corasick automaton over the vocabulary finds every token that starts at
every position in one pass.  Encoding takes the longest token at each position (one call of the automaton, when all
neighbours fit) and steps back to a shorter one, or to the previous token, when two neighbours could not stand side by side.  Two tokens are compatible when merging their
joined bytes by rank gives exactly these two tokens; the answer is remembered per pair.  A sequence in which all
neighbours are compatible is the sequence of the merges.  Positions that led nowhere are marked, so each is tried once
and the work stays linear in the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.common import text_of
from caseloom.llm.tokens import WordwiseEncoder

#: Remembered compatibilities; the memory is emptied when full.
PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairCoder:
    """Exact coder for a rank table that holds all single bytes and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: t for t, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            if len(t) == 1 or self.merge(t) == [i]:  # others can only be a whole piece
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, lowest and leftmost first; quadratic, for a few bytes."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        letters = data.decode("latin-1")
        longest = [i for _, (_, i) in self.automaton.iter_long(letters)]
        known = self.pairs.get
        for pair in zip(longest, longest[1:]):
            good = known(pair)
            if not (self.compatible(*pair) if good is None else good):
                return self._backtracked(letters)
        return longest

    def _backtracked(self, letters: str) -> list[int]:
        """The path that steps back from longest tokens whose neighbours do not fit."""
        n = len(letters)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(letters):
            starts[end - match[0] + 1].append(match)  # ends ascend, so the longest of a start comes last
        dead = bytearray(n + 1)
        known = self.pairs.get
        path: list[int] = []
        at = 0
        while at < n:
            options = starts[at]  # used up once: a position is entered again only if it is not dead
            while options:
                size, i = options.pop()
                if dead[at + size]:
                    continue
                if path:
                    good = known((path[-1], i))
                    if not (self.compatible(path[-1], i) if good is None else good):
                        continue
                path.append(i)
                at += size
                break
            else:
                dead[at] = 1
                at -= len(self.bytes_of[path.pop()])
        return path

    def encode(self, text: str) -> str:
        """Ids as characters, each match of the split pattern separately."""
        return "".join([chr(i) for m in self.pattern.finditer(text) for i in self.encode_piece(m.group().encode("utf-8"))])

    def decode(self, ids: str) -> bytes:
        return b"".join([self.bytes_of[ord(c)] for c in ids])


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``ids_sha256``, ``decoded_sha256``.

    ``vocabulary`` is the path of a rank file, read once on the driver and sent to the workers (its size is that of
    the vocabulary).  Null texts are empty: no ids.  Special tokens in a text are ordinary text.  Rows keep their
    place; nothing is shuffled.  Other columns are not read; an empty table gives no rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    made: list = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            coder = BytePairCoder(ranks.value, pattern)
            decoded = {chr(i): t for i, t in coder.bytes_of.items()}
            made.append((WordwiseEncoder(coder.encode), decoded))
        encode, decoded = made[0]
        for b in batches:
            out: list[tuple] = []
            for text in b.column("_t"):
                ids = encode(text.as_py())
                raw = ids.encode("utf-32-le", "surrogatepass")
                back = b"".join(map(decoded.__getitem__, ids))
                out.append((len(ids), raw if with_ids else None, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, raw, a, c = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(raw, pa.binary()),
                                              pa.array(a, pa.string()), pa.array(c, pa.string())],
                                             names=["_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    kind = d.schema["_id"].dataType.simpleString()
    out = d.mapInArrow(work, f"_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col) if with_ids else out.drop("ids").withColumnRenamed("_id", id_col)
