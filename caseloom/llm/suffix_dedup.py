"""Exact removal of long repeated passages with sampled suffixes, built bucket by bucket.

A 200-byte string counts as repeated when it starts at two places or more.  Following difference-cover construction,
only a sample of suffixes is compared across the corpus and every other suffix is decided through the sample.  The
cover must hold, for any two equal strings, positions at the same shift of both.  A periodic cover of the shifts would
put a twelfth of all positions through a shuffle; this one takes the position of the smallest hash of 40 bytes inside
each 200, which equal strings share by construction, one position in about eighty.

* Windows (starts of 200 bytes) with one cover position form a segment.  Its bucket is the 40 bytes at that position,
  and its rank is a 128-bit name of all bytes that its windows span, computed before any comparison.
* Equal names resolve long ties at once: all windows of both segments are repeated.
* Only buckets with two different names are looked into, window by window, one place of each name standing for all;
  they are sorted by task, one bucket after another.

Buckets, names and windows are grouped by Spark, so memory is bounded by a document chunk, not by a bucket; names are
counted on the map side first, so a passage of any frequency is a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.common import text_of
from caseloom.session import materialize

#: Length of a repeated string, bytes of a bucket key, and window starts handled at once.
LENGTH, KEY, CHUNK = 200, 40, 1 << 20
#: Names of a bucket that one task resolves (some 300 bytes each).
TASK_NAMES = 10_000
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(factor: int, n: int) -> np.ndarray:
    f = np.full(n, factor, np.uint64)
    f[0] = 1
    return np.multiply.accumulate(f)


class _Hash:
    """Hashes of any substring of a chunk from prefix sums, modulo 2^64."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(0, 2**64, 256, np.uint64)
        self.factor = int(r.integers(0, 2**63)) * 8 + 5 & (2**64 - 1)
        self.inverse = pow(self.factor, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(self.factor, n + 1), _powers(self.inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


_ONE, _TWO = _Hash(1), _Hash(2)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def segments(data: bytes, length: int = LENGTH, key: int = KEY, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """(first window, windows, bucket, name 1, name 2) of all segments of a document."""
    raw, out = np.frombuffer(data, np.uint8), []
    for base in range(0, len(raw) - length + 1, chunk):
        part = raw[base:base + chunk + length - 1]
        _ONE.load(part), _TWO.load(part)
        n = len(part) - key + 1
        at = np.arange(n)
        g = (_ONE.sums[key:] - _ONE.sums[:n]) * _ONE.down[:n]
        g ^= g >> np.uint64(31)
        g *= _MIX
        g ^= g >> np.uint64(29)
        low = np.uint64(24)
        cover = (_sliding_min((g >> low << low) | at.astype(np.uint64), length - key + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(cover))[0] + 1])
        end = np.append(first[1:], len(cover))
        stop = end - 1 + length
        out.append((first + base, end - first, g[cover[first]].view(np.int64), _ONE.of(first, stop).view(np.int64), _TWO.of(first, stop).view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment_rows(d: DataFrame, length: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segments(t.as_py().encode(), length) for t in b.column("_t")]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]) if found else np.zeros(0, np.int64)
            cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("_x").take(at), *map(pa.array, cols)],
                                             names=["_id", "_x", "_a", "_n", "_b", "_k1", "_k2"])

    return d.mapInArrow(work, f"_id {d.schema['_id'].dataType.simpleString()}, _x long, _a long, _n long, _b long, _k1 long, _k2 long")


def _contexts(open_: DataFrame, length: int) -> DataFrame:
    """The listed segments with the bytes that their windows span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows share their segments; a partition holds all rows of a document
        for batch in batches:
            rows = []
            for i, x, t, segs in zip(*(batch.column(c) for c in ("_id", "_x")), batch.column("_t"), batch.column("_segs").to_pylist()):
                at = (i.as_py(), x.as_py())
                if at not in seen:
                    seen.add(at)
                    data = t.as_py().encode()
                    rows += [(*at, s["_a"], s["_b"], s["_c"], data[s["_a"]:s["_a"] + s["_n"] - 1 + length]) for s in segs]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.field("_id").type, *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_id", "_x", "_a", "_b", "_c", "_bytes"])

    return open_.mapInArrow(work, f"_id {open_.schema['_id'].dataType.simpleString()}, _x long, _a long, _b long, _c long, _bytes binary")


def _names_of(contexts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """128-bit names of all windows, with their context and offset."""
    size = np.array([len(c) for c in contexts])
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    _ONE.load(joined), _TWO.load(joined)
    n = size - length + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[owner] + offset
    return _ONE.of(at, at + length), _TWO.of(at, at + length), owner, offset


def _repeated_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows, bucket by bucket; ``contexts`` is partitioned and sorted by bucket."""
    schema = contexts.schema["_id"].dataType.simpleString()

    def resolve(rows: list[tuple]) -> pa.RecordBatch | None:
        w1, w2, owner, offset = _names_of([r[5] for r in rows], length)
        copies = np.array([r[4] for r in rows])
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        group = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        hit = np.zeros(len(order), bool)
        hit[order] = np.bincount(group, copies[owner[order]])[group] > 1
        hit &= copies[owner] == 1  # names with copies are repeated already
        at = np.nonzero(hit)[0]
        if not len(at):
            return None
        first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)])
        last = np.append(first[1:], True)
        own = owner[at[first]]
        start = np.array([rows[k][2] for k in own])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][0] for k in own], kind), pa.array([rows[k][1] for k in own], pa.int64()),
             pa.array(start + offset[at[first]]), pa.array(start + offset[at[last]] + length)], names=["_id", "_x", "_s", "_e"])

    kind = pa.string() if schema == "string" else pa.int32() if schema == "int" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_id", "_x", "_a", "_b", "_c", "_bytes"))):
                if len(held) >= 4000 and held[-1][3] != row[3]:  # whole buckets, several small ones at once
                    if (out := resolve(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := resolve(held)) is not None:
            yield out

    return contexts.mapInArrow(work, f"_id {schema}, _x long, _s long, _e long")


def _window_rows(contexts: DataFrame, length: int) -> DataFrame:
    """One row per window, for buckets too large for one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                w1, w2, owner, offset = _names_of(part.column("_bytes").to_pylist(), length)
                i, x, a, c = (part.column(n).take(pa.array(owner)) for n in ("_id", "_x", "_a", "_c"))
                yield pa.RecordBatch.from_arrays([i, x, pa.array(a.to_numpy(zero_copy_only=False) + offset), pa.array(w1.view(np.int64)),
                                                  pa.array(w2.view(np.int64)), c], names=["_id", "_x", "_s", "_w1", "_w2", "_c"])

    return contexts.mapInArrow(work, f"_id {contexts.schema['_id'].dataType.simpleString()}, _x long, _s long, _w1 long, _w2 long, _c long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, task_names: int = TASK_NAMES) -> DataFrame:
    """(``_id``, ``_x``, ``_s``, ``_e``): byte ranges that repeated strings cover; ``docs`` has ``_id``, ``_x``, ``_t``.

    Buckets of up to ``task_names`` names are resolved by one task each; larger ones by a grouping of their windows,
    which Spark spreads.  Both count the same names.
    """
    rows = materialize(_segment_rows(docs, length), "segments")
    buckets = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_b")
    rows = materialize(rows.join(buckets, "_b"), "shared-segments")
    name = ["_b", "_k1", "_k2", "_n"]
    place = F.min(F.struct("_id", "_x", "_a")).alias("_at")
    names = materialize(rows.groupBy(*name).agg(F.count(F.lit(1)).alias("_c"), place), "segment-names")
    same = rows.join(names.where("_c > 1").select(*name), name, "left_semi").select(
        "_id", "_x", F.col("_a").alias("_s"), (F.col("_a") + F.col("_n") - 1 + length).alias("_e"))
    several = names.groupBy("_b").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    todo = names.join(several.select("_b"), "_b", "left_semi").select("_at._id", "_at._x", F.struct(F.col("_at._a").alias("_a"), "_n", "_b", "_c").alias("_seg"))
    todo = todo.groupBy("_id", "_x").agg(F.collect_list("_seg").alias("_segs"))  # at most a document's own segments
    todo = todo.withColumnsRenamed({"_id": "_hid", "_x": "_hx"})
    found = docs.join(todo.hint("shuffle_hash"), (F.col("_x") == F.col("_hx")) & F.col("_id").eqNullSafe(F.col("_hid"))).drop("_hid", "_hx")
    contexts = materialize(_contexts(found, length), "contexts")
    large = materialize(several.where(F.col("_k") > task_names).select("_b"), "large-buckets")
    small = contexts.join(large, "_b", "left_anti").repartition("_b").sortWithinPartitions("_b")
    parts = _repeated_windows(small.select("_id", "_x", "_a", "_b", "_c", "_bytes"), length)
    windows = _window_rows(contexts.join(large, "_b", "left_semi").select("_id", "_x", "_a", "_b", "_c", "_bytes"), length)
    keys = ["_w1", "_w2"]
    twice = windows.groupBy(*keys).agg(F.sum("_c").alias("_k")).where("_k > 1").select(*keys)
    single = windows.where("_c = 1").join(twice, keys, "left_semi").select("_id", "_x", "_s", (F.col("_s") + length).alias("_e"))
    return same.union(parts).union(single)


def _sweep(data: bytes, spans) -> tuple[int, int, bytes]:
    """(removed bytes, maximal runs, remaining bytes) for ranges that may overlap or touch."""
    removed, runs, kept, at = 0, 0, [], 0
    for s, e in sorted(spans):
        if s > at or not runs:
            kept.append(data[at:s])
            runs, at = runs + 1, s
        removed += max(0, e - at)
        at = max(at, e)
    kept.append(data[at:])
    return removed, runs, b"".join(kept)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   task_names: int = TASK_NAMES) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes).

    Null and empty texts, and texts shorter than ``length`` bytes, keep everything.  A repeated row is another place:
    texts of ``length`` bytes or more that occur twice lose all bytes in both.  Other columns are not read; an empty
    table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_x", F.xxhash64("_t"))
    spans = repeated_spans(d, length, task_names).groupBy("_id", "_x").agg(F.collect_set(F.struct("_s", "_e")).alias("_spans"))
    spans = materialize(spans, "repeats").withColumnsRenamed({"_id": "_hid", "_x": "_hx"})
    both = d.join(spans.hint("shuffle_hash"), (F.col("_x") == F.col("_hx")) & F.col("_id").eqNullSafe(F.col("_hid")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, found in zip(b.column("_t"), b.column("_spans").to_pylist()):
                data = t.as_py().encode()
                n, runs, kept = _sweep(data, [(x["_s"], x["_e"]) for x in found]) if found else (0, 0, data)
                out.append((len(data), n, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = d.schema["_id"].dataType.simpleString()
    out = both.select("_id", "_t", "_spans").mapInArrow(
        work, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_id", id_col)
