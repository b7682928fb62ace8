"""Packing documents into sequences as a cutting-stock problem.

A document's ids are cut into full sequences and one remainder.  Remainders are a cutting-stock problem over at most
``size`` - 1 lengths, whatever the number of documents: a linear program over patterns (which lengths share a sequence)
is solved by column generation, where a knapsack over the dual prices finds the next pattern.  Patterns are rounded
down and the rest is filled greedily.  Remainders of one length are ranked by document id, and a pattern takes a run of
ranks, so every piece finds its sequence by arithmetic on its rank; only the pattern table is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.llm.common import text_of
from caseloom.llm.token_files import encoder
from caseloom.session import materialize

#: Relative gap to the lower bound at which the linear program counts as solved.
GAP = 0.0005
#: Sequences a length that rounding costs anyway (about a quarter is usual); a smaller distance to the bound is not worth a step.
ROUNDING = 0.02
#: Weight of the best prices so far when a pattern is priced.
CENTRE = 0.85


def _greedy(lengths: list[int], left: list[int], size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with their uses, largest length first; each exhausts a length."""
    left, out = list(left), []
    alive = list(range(len(lengths)))  # descending lengths
    while alive:
        room, pattern = size, {}
        for i in alive:
            k = min(room // lengths[i], left[i])
            if k:
                pattern[i] = k
                room -= k * lengths[i]
                if not room:
                    break
        uses = min(left[i] // k for i, k in pattern.items())
        for i, k in pattern.items():
            left[i] -= uses * k
        out.append((pattern, uses))
        alive = [i for i in alive if left[i]]
    return out


def _fractional_start(lengths: list[int], demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A basic solution: patterns filled largest first, each used until one of its lengths is exhausted (listed last)."""
    left, m = demand.astype(float).copy(), len(lengths)
    columns, uses, order = np.zeros((m, m)), np.zeros(m), []
    alive = np.ones(m, bool)
    for j in range(m):
        room, pattern = size, np.zeros(m)
        for i in np.nonzero(alive)[0]:
            k = room // lengths[i]
            if k:
                pattern[i] = k
                room -= k * lengths[i]
        on = pattern > 0
        ratio = np.full(m, np.inf)
        ratio[on] = left[on] / pattern[on]
        out = int(np.argmin(ratio))
        uses[j] = ratio[out]
        left -= uses[j] * pattern
        left[out] = 0
        alive[out] = False
        columns[:, j] = pattern
        order.append(out)
    return columns, uses, order


def _inverse(columns: np.ndarray, order: list[int]) -> np.ndarray:
    """Inverse of the first basis: a pattern holds only lengths not yet exhausted, so in that order it is triangular.

    Sums over the few non-zero entries, without matrix routines: their threads may hang in a process that runs Spark.
    """
    low, m = columns[order], len(order)
    out = np.zeros((m, m))
    for i in range(m):
        on = np.nonzero(low[i, :i])[0]
        out[i] = -(low[i, on][:, None] * out[on]).sum(axis=0)
        out[i, i] += 1
        out[i] /= low[i, i]
    found = np.empty((m, m))
    found[:, order] = out
    return found


def _knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best value of a sequence and its pattern (unbounded copies)."""
    value, column = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    value[lengths], column[lengths] = price, np.arange(len(lengths))
    best, pick = np.zeros(size + 1), np.zeros(size + 1, int)
    for c in range(int(lengths.min()), size + 1):
        total = best[c - 1::-1] + value[1:c + 1] if c > 1 else best[:1] + value[1:2]
        i = int(total.argmax())
        if total[i] > best[c - 1]:
            best[c], pick[c] = total[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(lengths)), size
    while c > 0:
        if pick[c]:
            pattern[column[pick[c]]] += 1
        c -= int(pick[c]) or 1
    return float(best[size]), pattern


def solve_program(lengths: list[int], demand: np.ndarray, size: int, gap: float = GAP, rounding: float = ROUNDING) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as columns, their uses, lower bound of the number of sequences) by column generation.

    Ends when the price test finds no better pattern, or when the bound is nearer than ``gap`` or than ``rounding`` sequences a
    length; or, where equal solutions follow each other, after as many steps without progress as there are lengths.  Prices of the basis swing widely at first, so a
    pattern is priced between them and the prices with the best bound so far (length / size to begin with, whose bound is
    the total length); the weight of the latter is lowered whenever the pattern found does not improve the basis.
    """
    size_of, idle, pull = np.array(lengths), 0, CENTRE
    columns, uses, order = _fractional_start(lengths, demand, size)
    inverse = _inverse(columns, order)
    centre = size_of / size
    bound = float((centre * demand).sum())
    while idle <= len(lengths):
        price, total = inverse.sum(axis=0), float(uses.sum())
        if total <= bound + max(gap * bound, rounding * len(lengths)):
            break
        tried = pull * centre + (1 - pull) * price
        value, pattern = _knapsack(size_of, tried, size)
        if value > 1e-9 and float((tried * demand).sum()) / max(value, 1.0) > bound:
            bound, centre = float((tried * demand).sum()) / max(value, 1.0), tried / max(value, 1.0)
        held = np.nonzero(pattern)[0]
        if (price[held] * pattern[held]).sum() <= 1 + 1e-9:
            if not pull:
                break  # the price test: no pattern improves the basis
            pull = pull / 2 if pull > 0.01 else 0.0
            continue
        pull = min(CENTRE, pull * 1.5 + 0.01)
        step = (inverse[:, held] * pattern[held]).sum(axis=1)
        on = step > 1e-9
        if not on.any():
            break
        ratio = np.full(len(lengths), np.inf)
        ratio[on] = np.maximum(uses[on], 0) / step[on]
        out = int(np.argmin(ratio))
        uses = uses - ratio[out] * step
        uses[out] = ratio[out]
        columns[:, out] = pattern
        pivot, moved = inverse[out] / step[out], np.nonzero(step)[0]
        inverse[moved] -= step[moved][:, None] * pivot
        inverse[out] = pivot
        idle = idle + 1 if uses.sum() > total - 1e-9 else 0
    return columns, uses, bound


def plan_patterns(histogram: dict[int, int], size: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with whole numbers of uses that cover exactly ``histogram`` (length -> count)."""
    lengths = sorted((n for n, c in histogram.items() if c > 0 and 0 < n <= size), reverse=True)
    if not lengths:
        return []
    demand = np.array([histogram[n] for n in lengths], float)
    columns, uses, _ = solve_program(lengths, demand, size, gap)
    plan, left = [], demand.astype(np.int64)
    for j in np.argsort(-uses):
        copies = columns[:, j].astype(np.int64)
        on = copies > 0
        times = int(min(max(0, np.floor(uses[j] + 1e-7)), (left[on] // copies[on]).min() if on.any() else 0))
        if times:
            plan.append(({int(i): int(copies[i]) for i in np.nonzero(on)[0]}, times))
            left -= times * copies
    plan += _greedy(lengths, left.tolist(), size)
    return [({lengths[i]: k for i, k in p.items()}, t) for p, t in plan if t]


def _places(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """Rows (length, first rank, end rank, copies, first sequence, offset) and the number of sequences."""
    rows, rank, seq = [], {}, 0
    for pattern, times in plan:
        at = 0
        for n in sorted(pattern, reverse=True):
            k, first = pattern[n], rank.get(n, 0)
            rows.append((n, first, first + times * k, k, seq, at))
            rank[n] = first + times * k
            at += n * k
        seq += times
    return rows, seq


def _token_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """id, number of ids, and the crc of each piece of ``size`` ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), chr(end_id)
        for b in batches:
            n, crc = [], []
            for t in b.column("_t"):
                raw = memoryview((enc(t.as_py()) + end).encode("utf-32-le", "surrogatepass"))
                n.append(len(raw) // 4)
                crc.append([zlib.crc32(raw[i:i + 4 * size]) for i in range(0, len(raw), 4 * size)])
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(crc, pa.list_(pa.int64()))],
                                             names=["_id", "_n", "_crc"])

    return docs.mapInArrow(work, f"_id {docs.schema['_id'].dataType.simpleString()}, _n long, _crc array<long>")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 1024, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are the end id alone.  Repeated rows and null ids are documents of their own.  Other columns
    are not read; an empty table gives no rows.  Sequence ids are 0, 1, ... without gaps.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    toks = materialize(_token_pieces(d, vocabulary, end_id, size), "packing-tokens")
    toks = toks.withColumns({"_full": F.floor(F.col("_n") / size), "_rest": F.col("_n") % size})
    order = ["_rest", "_id", "_n"]
    ranked = materialize(toks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()),
                         "packing-order")
    ranked = ranked.withColumns({"_part": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    histogram = {r._rest: r.n for r in ranked.groupBy("_rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    places, sequences = _places(plan_patterns({k: v for k, v in histogram.items() if k}, size))
    below, total = {}, 0
    for k in sorted(histogram):
        below[k] = total
        total += histogram[k]
    parts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"), F.sum("_full").alias("_f"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o) for c, o in (("_k", "_k0"), ("_f", "_f0"))])
    inside = W.partitionBy("_part").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    r = ranked.withColumn("_fi", F.coalesce(F.sum("_full").over(inside), F.lit(0))).join(F.broadcast(parts), "_part")
    offsets = spark.createDataFrame(pa.table({"_rest": pa.array(list(below), pa.int64()), "_below": pa.array(list(below.values()), pa.int64())}))
    r = r.join(F.broadcast(offsets), "_rest").withColumn("_rank", F.col("_i") + F.col("_k0") - F.col("_below"))
    whole = r.where("_full > 0").select("_id", "_n", "_f0", "_fi", F.posexplode(F.slice("_crc", F.lit(1), F.col("_full").cast("int"))).alias("_j", "_c"))
    whole = whole.select(
        F.col("_id").alias(id_col), (F.col("_j") * F.lit(size)).cast("long").alias("start"), F.lit(size).cast("long").alias("length"),
        F.col("_c").alias("ids_crc32"), F.col("_n").alias("doc_tokens"),
        (F.lit(sequences) + F.col("_f0") + F.col("_fi") + F.col("_j")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # thousands of rows: as one Arrow table, not as an expression per cell
    names = ("_l", "_r0", "_r1", "_copies", "_s0", "_o0")
    table = spark.createDataFrame(pa.table({c: pa.array([p[i] for p in places], pa.int64()) for i, c in enumerate(names)}))
    k = F.col("_rank") - F.col("_r0")
    rest = r.where("_rest > 0").join(F.broadcast(table), (F.col("_rest") == F.col("_l")) & (F.col("_rank") >= F.col("_r0")) & (F.col("_rank") < F.col("_r1")))
    rest = rest.select(
        F.col("_id").alias(id_col), (F.col("_full") * size).cast("long").alias("start"), F.col("_rest").alias("length"),
        F.element_at("_crc", -1).alias("ids_crc32"), F.col("_n").alias("doc_tokens"),
        (F.col("_s0") + F.floor(k / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_o0") + (k % F.col("_copies")) * F.col("_rest")).cast("long").alias("offset"))
    return whole.unionByName(rest)
