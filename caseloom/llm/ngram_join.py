"""Near-duplicate documents: exact Jaccard join on 5-word shingles by rare-first prefix filtering.

1. Documents with equal shingle sets fall together by a 128-bit fingerprint; one of each class goes on.
2. Shingles get one global order, rare first, from counts of 2^18 hash buckets over all documents (a fixed-size table).
   Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each, in any fixed order.
3. Shingles that occur in two prefixes or more are kept; they name the candidates.  They are marked in a bitmap of fixed
   size, so most others never leave the documents' tasks; a wrong mark only costs work, as the join on the shingle follows.
   Length and positional filters apply to each shared shingle; the first one shared by a linked pair always passes.
   Distinct pairs are verified once, after a suffix filter that bounds the overlap by splitting both sets at a median.
   The upper halves of the hashes bound the overlap from above; the few pairs that they leave open, near the threshold,
   are compared by whole hashes.
4. The result is connected components, so pairs inside one component need no check.  Two rounds compare each document
   with one hub per shingle, the same hub across a group of copies, which joins large groups by as many pairs as they
   have members.  Where more pairs than shared shingles are left (a large group whose members link with some of the others
   only), further rounds compare the rest with several hubs, as long as that helps.  The last round takes all remaining
   pairs of different components, so no link is lost.

Shingles are 64-bit hashes.  Within one set or one pair equal hashes of different shingles are beyond chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.common import measured_side, text_of, unused
from caseloom.session import materialize

#: Words of a shingle, and the threshold as a percentage.
WORDS, PERCENT = 5, 75
#: Buckets of the frequency table that orders the shingles.
BUCKET_BITS = 18
#: Bits of the map of repeated shingles: 16 MB whatever their number; they are counted by this many bits of their hashes.
MAP_BITS, COUNT_BITS = 27, 40
#: Hubs of a shingle in the further rounds.
HUBS = 8
#: Bytes of text whose words are hashed at once, and bytes of a word up to which that is done eight at a time.
BLOCK_BYTES, LONG_WORD = 1 << 20, 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's finalizer, which is one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``data[start:end]``; eight more bytes must follow the last word."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = end - start
    h = _mixed((size.astype(np.uint64) * _FACTORS[0]) ^ (eights[start] & _FIRST[np.minimum(size, 8)]))
    rest = np.nonzero(size > 8)[0]
    for k in range(8, LONG_WORD, 8):
        if not len(rest):
            return h
        h[rest] = _mixed(h[rest] * _FACTORS[1] ^ (eights[start[rest] + k] & _FIRST[np.minimum(size[rest] - k, 8)]))
        rest = rest[size[rest] > k + 8]
    for i in rest:
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]])
    return h


def _window(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of windows from the hashes of their first, second, ... words."""
    v = np.full(len(words[0]), len(words), np.uint64)
    for w, factor in zip(words, _FACTORS):
        v += w * factor
        v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def _windows(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts ``text[bounds[i]:bounds[i + 1]]`` as they stand, and where those of each text begin."""
    data = np.zeros(len(text) + 8, np.uint8)
    data[:len(text)] = text + ((text - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))  # lowers A-Z only
    inside = np.ones(len(text) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (text != 32) & (text - np.uint8(9) > 4)
    cut = np.zeros(len(text) + 1, bool)  # a text ends and the next begins
    cut[bounds] = True
    start = np.nonzero(inside[1:] & (cut | ~inside[:-1]))[0]
    end = np.nonzero(inside[:-1] & (cut | ~inside[1:]))[0]
    h = word_hashes(data, start, end)
    first = np.searchsorted(start, bounds)
    n = np.diff(first)
    v, valid = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
    if len(h) >= WORDS:
        v[:len(h) - WORDS + 1] = _window([h[i:len(h) - WORDS + 1 + i] for i in range(WORDS)])
    for k in range(1, WORDS):
        last = first[1:] - k  # too near the end of its text to begin a shingle
        valid[last[last >= first[:-1]]] = False
    for k in range(1, WORDS):
        at = first[:-1][n == k]
        v[at], valid[at] = _window([h[at + i] for i in range(k)]), True
    return v[valid], np.concatenate([[0], np.cumsum(np.where(n < WORDS, np.minimum(n, 1), n - WORDS + 1))])


def shingles(texts: pa.Array, order: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some texts at a time, which, their sorted distinct shingle hashes, and where those of each text begin.

    Fewer than five words make one shingle; no word, none.  With ``order``, the upper BUCKET_BITS bits are replaced by it.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        v, at = _windows(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        if order is not None:
            v = _reordered(v, order)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            v[a:b].sort()
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        new[at[:-1][at[:-1] < at[1:]]] = True
        yield slice(i, j), v[new], np.concatenate([[0], np.cumsum(new)])[at]
        i = j


def _reordered(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Hashes whose bucket, the upper bits, is replaced by its place in ``order``."""
    low = np.uint64(64 - BUCKET_BITS)
    return (order[(h >> low).astype(np.int64)] << low) | (h & ((np.uint64(1) << low) - np.uint64(1)))


def required(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest intersection of sets of sizes a and b that links them."""
    return -(-percent * (a + b) // (100 + percent))


def _bucket_counts(docs: DataFrame) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for _, h, _ in shingles(b.column("_t")):
                counts += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["b", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in docs.select("_t").mapInArrow(work, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def _signatures(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Fingerprint and size of each document's set, and its prefix: its shingles from the rarest bucket on."""
    rare_first = np.argsort(counts, kind="stable").astype(np.uint64)
    place = np.empty_like(rare_first)
    place[rare_first] = np.arange(len(counts), dtype=np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((rare_first, place))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_first, place = shared.value
        for b in batches:
            for some, s, at in shingles(b.column("_t"), place):
                d = [xxhash.xxh3_128_intdigest(s[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                n = np.diff(at)
                size = np.minimum(n, n - -(-percent * n // 100) + 1)
                ends = np.cumsum(size)
                prefix = s[np.arange(ends[-1]) + np.repeat(at[:-1] - ends + size, size)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id")[some], pa.array([(x & (2**64 - 1)) - 2**63 for x in d], pa.int64()),
                     pa.array([(x >> 64) - 2**63 for x in d], pa.int64()), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(_reordered(prefix, rare_first).view(np.int64)))],
                    names=["_id", "_f1", "_f2", "_n", "_prefix"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"_id {kind}, _f1 long, _f2 long, _n long, _prefix array<long>")


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """Sorted shingle hashes of each text, or their upper halves."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, s, at in shingles(b.column("_t")):
                s = s if whole else (s >> np.uint64(32)).astype(np.uint32)
                sets = [s[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("_id")[some], pa.array(sets, pa.binary())], names=["_id", "_set"])

    return docs.mapInArrow(work, f"_id {docs.schema['_id'].dataType.simpleString()}, _set binary")


def _repeated(prefixes: DataFrame) -> bytes:
    """Bitmap of the shingles that stand in two prefixes or more, and few others: only the upper bits are counted."""
    upper = prefixes.select(F.explode("_prefix").alias("_h")).select(F.shiftrightunsigned("_h", 64 - COUNT_BITS).alias("_u"))
    words = upper.groupBy("_u").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    slot = F.shiftright("_u", COUNT_BITS - MAP_BITS)
    bit = slot.bitwiseAND(F.lit(63)).cast("int")
    rows = words.select(F.shiftright(slot, 6).cast("int").alias("_i"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_m"))
    rows = rows.groupBy("_i").agg(F.bit_or("_m").alias("_m")).toArrow()  # at most 2 ** (MAP_BITS - 6) rows
    out = np.zeros(1 << MAP_BITS - 6, "<i8")
    out[rows.column("_i").to_numpy()] = rows.column("_m").to_numpy()
    return out.tobytes()


def _shared(prefixes: DataFrame) -> DataFrame:
    """(``_h``, ``_id``, ``_n``, place ``_p``) of the shingles that stand in two prefixes or more."""
    shared = prefixes.sparkSession.sparkContext.broadcast(_repeated(prefixes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            lists = b.column("_prefix")
            h = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            slot = (h.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            at = np.nonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)[0]
            row = np.searchsorted(first + size, at, side="right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), b.column("_id").take(pa.array(row)), b.column("_n").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32))],
                names=["_h", "_id", "_n", "_p"])

    kind = prefixes.schema["_id"].dataType.simpleString()
    marked = prefixes.select("_id", "_n", "_prefix").mapInArrow(work, f"_h long, _id {kind}, _n long, _p int")
    marked = materialize(marked, "marked-shingles")
    common = marked.groupBy("_h").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_h")
    return materialize(marked.join(common, "_h"), "shared-shingles")


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the intersection of two sorted sets, by splitting both at a median ``depth`` times."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    m = len(a) // 2
    k = int(np.searchsorted(b, a[m]))
    return overlap_bound(a[:m], b[:k], depth - 1) + overlap_bound(a[m:], b[k:], depth - 1)


def chance(a: int, b: int) -> int:
    """More equal upper halves among different hashes of sets of these sizes than chance gives."""
    return 3 + a * b // 2**28


def verdict(a: np.ndarray, b: np.ndarray, percent: int, whole: bool) -> bool | None:
    """Whether two sorted sets link; None where upper halves of hashes cannot tell."""
    need = required(len(a), len(b), percent)
    if overlap_bound(a, b) < need:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    if same < need:
        return False  # equal hashes have equal halves, so halves never count too few
    return True if whole or same >= need + chance(len(a), len(b)) else None


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, whole: bool, label: str) -> DataFrame:
    """The pairs (a, b) that link (``_sure``) or are left open."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint64 if whole else np.uint32
        for batch in batches:
            said = [verdict(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind), percent, whole)
                    for x, y in zip(batch.column("_x"), batch.column("_y"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_a"), batch.column("_b"), pa.array([x is True for x in said], pa.bool_())],
                names=["_a", "_b", "_sure"]).filter(pa.array([x is not False for x in said], pa.bool_()))

    kind = sets.schema["_id"].dataType.simpleString()
    rows = pairs.join(sets.select(F.col("_id").alias("_a"), F.col("_set").alias("_x")), "_a")
    rows = rows.join(sets.select(F.col("_id").alias("_b"), F.col("_set").alias("_y")), "_b")
    out = rows.select("_a", "_b", "_x", "_y").mapInArrow(work, f"_a {kind}, _b {kind}, _sure boolean")
    return materialize(out.groupBy("_a", "_b").agg(F.max("_sure").alias("_sure")), label)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) that link, by upper halves of hashes and, where these leave it open, by whole ones."""

    def compared(some: DataFrame, whole: bool) -> DataFrame:
        name = f"{label}-{'whole' if whole else 'half'}"
        ends = some.select(F.col("_a").alias("_id")).union(some.select(F.col("_b").alias("_id"))).distinct()
        sets = materialize(_sets(docs.join(measured_side(ends, f"ends-{name}", 64), "_id", "left_semi"), whole), f"sets-{name}")
        return _compared(some, sets, percent, whole, f"links-{name}")

    half = compared(pairs, False)
    sure, open_ = half.where("_sure").select("_a", "_b"), half.where("not _sure").select("_a", "_b")
    return sure.union(compared(open_, True).select("_a", "_b"))


def components(links: DataFrame) -> DataFrame:
    """(``_v``, ``_c``): smallest vertex reachable over ``links`` (``_a``, ``_b``); linked vertices only.

    Each step takes the smallest label of the neighbours, then of the label's own label, until nothing changes.
    """
    both = links.select("_a", "_b").union(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct()
    edges = materialize(both, "links")
    labels = materialize(edges.groupBy(F.col("_a").alias("_v")).agg(F.least(F.min("_b"), F.first("_a")).alias("_c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("_v").alias("_b"), "_c"), "_b").groupBy(F.col("_a").alias("_v")).agg(F.min("_c").alias("_m"))
        step = labels.join(near, "_v").select("_v", F.col("_c").alias("_old"), F.least("_c", "_m").alias("_c"))
        jump = labels.select(F.col("_v").alias("_c"), F.col("_c").alias("_j"))
        step = materialize(step.join(jump, "_c").select("_v", "_old", F.least("_c", "_j").alias("_c")), "labels")
        labels = step.select("_v", "_c")
        if step.where(F.col("_c") < F.col("_old")).isEmpty():
            return labels


def _passes(percent: int, n1, p1, n2, p2):
    """Length and positional filters for two sets that share the shingles at these prefix positions."""
    most = F.least(n1 - p1, n2 - p2)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (most * (100 + percent) >= (n1 + n2) * percent)


def _with_hubs(rows: DataFrame, turn: int, hubs: int) -> DataFrame:
    """Rows beside ``_hub``, one of the hubs of their shingle, where it is in another component.

    With several hubs, only rows outside the smallest component ``_lo`` of their shingle.
    """
    order = [F.struct(F.xxhash64("_id", F.lit(turn), *[F.lit(i)] * (hubs > 1)).alias("o"), "_id", "_n", "_p", "_c") for i in range(hubs)]
    if hubs == 1:
        open_ = rows.groupBy("_h").agg(F.min(order[0]).alias("_hub"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi")
    else:
        open_ = rows.groupBy("_h").agg(F.array_distinct(F.array(*map(F.min, order))).alias("_hubs")).select("_h", F.explode("_hubs").alias("_hub"))
        rows = rows.where("_c <> _lo")
    return rows.join(open_.select("_h", "_hub"), "_h").where(F.col("_c") != F.col("_hub._c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links, itself included).

    Null, empty and blank texts have no shingles and stand alone, as do rows with a null id (component null).
    A repeated row shares its twin's component; rows that share an id but not the text are one vertex with the links of
    all its texts.  Other columns are not read; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    sig = materialize(_signatures(d, _bucket_counts(d), percent), "signatures")
    keys = ["_f1", "_f2"]
    rows = sig.where("_n > 0 and _id is not null")
    classes = materialize(rows.groupBy(*keys).agg(F.min("_id").alias("_rep")), "classes")
    copies = rows.select("_id", *keys).join(classes, keys).where(F.col("_id") != F.col("_rep"))
    copies = materialize(copies.distinct(), "copies")
    # ids with several texts tie the classes of these texts together
    several = rows.groupBy("_id").agg(F.min(F.struct(*keys)).alias("_lo"), F.max(F.struct(*keys)).alias("_hi")).where("_lo <> _hi")
    ties = copies.join(measured_side(several.select("_id"), "several-texts", 64), "_id", "left_semi")
    links = materialize(ties.select(F.col("_rep").alias("_a"), F.col("_id").alias("_b")).distinct(), "ties")
    firsts = rows.join(measured_side(copies.select("_id", *keys), "copies-side", 64), ["_id", *keys], "left_anti")
    shared = _shared(firsts)
    done, turn, left, last = None, 0, None, False
    while not last:
        turn += 1
        label = measured_side(components(links), f"components-{turn}", 64)
        rows = shared.join(label.withColumnRenamed("_v", "_id"), "_id", "left").withColumn("_c", F.coalesce("_c", "_id"))
        if turn > 2:
            open_ = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_k"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")).where("_lo <> _hi")
            rows = materialize(rows.join(open_.drop("_hi"), "_h"), f"open-{turn}")
            before, left = left, rows.where("_c <> _lo").agg(F.coalesce(F.sum("_k"), F.lit(0))).first()[0]  # no fewer pairs
            last = left <= shared.count() or before is not None and left > 0.9 * before
        if not last:
            two = _with_hubs(rows, turn, 1 if turn < 3 else HUBS)
            other = [F.col(f"_hub.{c}") for c in ("_id", "_n", "_p")]
        else:
            right = rows.select("_h", *[F.col(c).alias(f"_r{c}") for c in ("_id", "_n", "_p", "_c")])
            two = rows.join(right, "_h").where(F.col("_c") < F.col("_r_c"))
            other = [F.col(f"_r{c}") for c in ("_id", "_n", "_p")]
        pairs = two.where(_passes(percent, F.col("_n"), F.col("_p"), other[1], other[2])).select(
            F.least("_id", other[0]).alias("_a"), F.greatest("_id", other[0]).alias("_b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["_a", "_b"], "left_anti")
        pairs = materialize(pairs, f"pairs-{turn}")
        links = links.union(_verified(pairs, d, percent, f"round-{turn}"))
        done = pairs if done is None else done.union(pairs)
    label = components(links)
    merged = classes.join(label, F.col("_rep") == F.col("_v"), "left").select(*keys, F.coalesce("_c", "_rep").alias("_c"))
    out = sig.join(merged, keys, "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("_c", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns as they came."""
    name = unused(docs, "_gone")
    gone = near_duplicates(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
