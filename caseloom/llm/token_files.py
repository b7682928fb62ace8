"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds the documents of one range of ids, ascending.  Layout, all numbers little-endian:

* magic ``CLTK1\\0\\0\\0``; u32 width in bits; u32 ids per block; u64 documents; u64 ids;
* i64 document id, u64 first id position and u64 id count, each as a column over all documents;
* u64 byte offset of each block, from the start of the data;
* data: each block starts at a byte and holds its ids with ``width`` bits each, lowest bit first.

The width is the smallest that holds the vocabulary, so a block is unpacked by one vectorised pass and any slice of
ids is read through the offsets without touching the rest.

Writing is safe under lost executors: a task writes under a name of its own attempt and reports it; only reported names
enter the manifest, so a repeated or abandoned attempt leaves an unused file and no wrong row.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from caseloom.llm.common import text_of
from caseloom.llm.tokens import WordwiseEncoder
from caseloom.session import materialize, scratch_path

MAGIC = b"CLTK1\0\0\0"
#: Ids per block.
BLOCK = 4096
#: Tasks that read files; with more files, each task reads several.
MOST_TASKS = 20_000


def width_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits per id, lowest bit first."""
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1 if width % 8 else None
    if bits is None:
        return np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width // 8].tobytes()
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, :width // 8] = raw[:n * (width // 8)].reshape(n, width // 8)
        return out.view("<u4").ravel()
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def file_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray, width: int, block: int = BLOCK) -> Iterator[bytes]:
    """The parts of a file, to be written one after another."""
    n = np.asarray(counts, np.uint64)
    blocks = [pack(ids[i:i + block], width) for i in range(0, len(ids), block)]
    yield MAGIC + np.array([width, block], "<u4").tobytes() + np.array([len(n), len(ids)], "<u8").tobytes()
    yield np.asarray(doc_ids, "<i8").tobytes()
    yield (np.cumsum(n) - n).astype("<u8").tobytes() + n.astype("<u8").tobytes()
    sizes = np.array([len(b) for b in blocks], np.uint64)
    yield (np.cumsum(sizes) - sizes).astype("<u8").tobytes()
    yield from blocks


class TokenFile:
    """Random access to one file; reads the header and then only the blocks that a slice needs."""

    def __init__(self, source):
        self.f = source
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.block = map(int, np.frombuffer(self._read(8, 8), "<u4"))
        docs, self.n_ids = map(int, np.frombuffer(self._read(16, 16), "<u8"))
        at = 32
        self.doc_ids = np.frombuffer(self._read(at, 8 * docs), "<i8")
        self.starts = np.frombuffer(self._read(at + 8 * docs, 8 * docs), "<u8").astype(np.int64)
        self.counts = np.frombuffer(self._read(at + 16 * docs, 8 * docs), "<u8").astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self._read(at + 24 * docs, 8 * blocks), "<u8").astype(np.int64)
        self.data = at + 24 * docs + 8 * blocks

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def slice(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``."""
        if n <= 0:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (start + n - 1) // self.block
        last = min(self.n_ids, (b + 1) * self.block) - b * self.block
        end = int(self.offsets[b]) + (last * self.width + 7) // 8
        raw = self._read(self.data + int(self.offsets[a]), end - int(self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            m = last if k == b else self.block
            parts.append(unpack(raw[int(self.offsets[k] - self.offsets[a]):], self.width, m) if self.width % 8 else None)
        if self.width % 8 == 0:  # blocks are gapless bytes
            ids = unpack(raw, self.width, (b - a) * self.block + last)
        else:
            ids = np.concatenate(parts)
        return ids[start - a * self.block:start - a * self.block + n]


#: Byte -> the visible character that stands for it in a byte-level vocabulary.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


def plain_byte_level(library) -> bool:
    """Whether a text is only split by the byte-level pattern and its matches looked up by the model."""
    made = json.loads(library.to_str())
    split = made["pre_tokenizer"] or {}
    return (made["normalizer"] is None and made["truncation"] is None and made["padding"] is None and made["model"].get("dropout") is None
            and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"])


class LibraryEncoder:
    """Ids of the tokenizers library for a byte-level vocabulary file, as ``add_special_tokens=False`` gives them.

    Texts are encoded word by word.  The library takes the strings of its added tokens out of a text before the split
    pattern sees the rest, so a text that holds one goes to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_word = WordwiseEncoder(self.whole, match=self.match if plain_byte_level(self.library) else None)

    def whole(self, text: str) -> str:
        return "".join(map(chr, self.library.encode(text, add_special_tokens=False).ids))

    def match(self, piece: str) -> str:
        """Ids of one match of the split pattern, from the library's model without its steps before and after."""
        return "".join([chr(t.id) for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_VISIBLE))])

    def __call__(self, text: str) -> str:
        return self.whole(text) if any(a in text for a in self.added) else self.by_word(text)


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark's default file system gives it, as pyarrow reads URIs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"file://{uri.getRawPath()}" if uri.getScheme() == "file" else uri.toString()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, out_dir: str, vocabulary_size: int,
                      id_col: str = "doc_id", text_col: str = "text", file_ids: int = 32 << 20) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write files in ascending order of id.

    Returns the manifest: ``part``, ``seq`` (order of files inside a part), ``file``, ``docs``, ``ids``.  A range
    partition becomes one or more files of about ``file_ids`` ids, so a task holds one file's ids at a time.
    Null texts are empty (only the end id); null document ids are left out of the files, as the format has integers
    only; repeated ids are separate documents next to each other.
    """
    width = width_for(vocabulary_size)
    folder = qualified(docs.sparkSession, out_dir)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, seq = TaskContext.get().partitionId(), encoder(vocabulary), 0
        end = chr(end_id)
        doc_ids: list[int] = []
        counts: list[int] = []
        texts: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            ids = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
            with store.open_output_stream(f"{root}/{name}") as f:
                for piece in file_bytes(doc_ids, counts, ids, width):
                    f.write(piece)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "docs": [len(doc_ids)], "ids": [held]})
            doc_ids.clear(), counts.clear(), texts.clear()
            seq, held = seq + 1, 0
            return row

        for b in batches:
            for i, text in zip(b.column("_id").to_pylist(), b.column("_t")):
                s = enc(text.as_py()) + end
                doc_ids.append(i)
                counts.append(len(s))
                texts.append(s)
                held += len(s)
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    d = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")).where(F.col("_id").isNotNull())
    d = d.repartitionByRange("_id").sortWithinPartitions("_id")
    return materialize(d.mapInArrow(work, "part long, seq long, file string, docs long, ids long"), "token-manifest")


def read_token_files(manifest: DataFrame, out_dir: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    File totals are summed in one small window (a row per file).  The files are then dealt over as many tasks as there
    are files, ``MOST_TASKS`` at most.
    """
    folder = qualified(manifest.sparkSession, out_dir)
    before = F.sum("ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_file(f"{root}/{name}") as f:
                    t = TokenFile(f)
                    step = 1 << 20  # ids are read in runs of whole documents, about a million at a time
                    i = 0
                    while i < len(t.doc_ids):
                        j = max(i + 1, int(np.searchsorted(t.starts, t.starts[i] + step)))
                        first = int(t.starts[i])
                        n = int(t.starts[j - 1] + t.counts[j - 1]) - first
                        raw = memoryview(t.slice(first, n).astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * int(s - first):4 * int(s - first + c)])
                               for s, c in zip(t.starts[i:j], t.counts[i:j])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t.doc_ids[i:j]), pa.array(t.starts[i:j] + base), pa.array(t.counts[i:j]), pa.array(crc, pa.int64())],
                            names=["_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    tasks = min(max(manifest.count(), 1), MOST_TASKS)
    spread = files.repartition(tasks)  # round robin by a stated number, which adaptive execution does not merge
    return spread.mapInArrow(work, "_id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, vocabulary_size: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files below the shared folder and report each document as read back from them."""
    out_dir = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, end_id, out_dir, vocabulary_size, id_col, text_col), out_dir, id_col)
