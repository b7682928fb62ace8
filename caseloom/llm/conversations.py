"""Repair of the turn structure of conversations by depth-first branch and bound.

A repaired conversation has roles ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Turns are
kept (0), given the user's or assistant's role (3), deleted (4; a must for blank and repeated turns), and turns with empty
text may be inserted (3).  A kept or rerolled turn whose text breaks off costs 3 more.  Of the cheapest lists of edits the one
whose initials (Delete, Insert, Keep, Rerole) are least in ASCII counts.

Search runs on windows of at most ``WINDOW`` turns in parallel, whatever the length of a conversation.  A window is solved
for each role state that it may be entered and left in, and its answer is sixteen costs and the order of their edit
lists.  Such answers combine like distances, some thousands of neighbours at a time, level by level; then the states are handed
down and each window is searched once more for its edits.  A window never ends with an insertion (it belongs to the next turn
or to the conversation's end), so edit lists of equal cost differ inside a window and their order can be told apart there.
Nearly all conversations are one window and are solved at once.

Only the digest of a repaired conversation is sequential by its definition; a task streams over its turns and holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from caseloom.llm.common import measured_side
from caseloom.session import materialize

#: Turns of a search window (2 ** bits), and windows or groups combined at once (2 ** bits).
WINDOW_BITS, GROUP_BITS = 6, 10
#: Role states: nothing yet, after system, after user, after assistant.  A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Cheapest end of a conversation by state, and the turns inserted for it.
CLOSING, CLOSED_BY = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
NEVER = 1 << 60
_WS = " \t\n\x0b\x0c\r"


def _after(state: int) -> int:
    """The state after a turn of the role that comes next."""
    return ASSISTANT if state == USER else USER


def _fits(initial: str, state: int) -> bool:
    return initial == ("a" if state == USER else "u")


def options(turn: tuple[str, bool], state: int) -> list[tuple[int, str, int]]:
    """(cost, edits, next state) for a turn: delete it, give it the next role or keep it, after at most one insertion.

    After two insertions the same role comes next as before them, so more are never needed.
    """
    initial, truncated = turn
    extra, step = (TRUNCATED if truncated else 0), _after(state)
    found = [(DELETE, "D", state), (REROLE + extra, "R", step), (INSERT + REROLE + extra, "IR", _after(step))]
    if _fits(initial, state):
        found.append((extra, "K", step))
    elif _fits(initial, step):
        found.append((INSERT + extra, "IK", _after(step)))
    if initial == "s" and state == START:
        found.append((extra, "K", SYSTEM))
    return found


def lower_bounds(turns: list[tuple[str, bool]]) -> list[list[int]]:
    """For each suffix of turns (initial, truncated) and each state a cost that no edit list undercuts.

    The relaxation lets a conversation stop after any role, so the bounds fit every way to leave a window.
    """
    bound = [[0] * len(STATES)]
    for turn in reversed(turns):
        bound.append([min(price + bound[-1][to] for price, _, to in options(turn, s)) for s in STATES])
    return bound[::-1]


def search(turns: list[tuple[str, bool]], entry: int, closing: tuple[int, ...], bound: list[list[int]] | None = None) -> tuple[int, str, int]:
    """(cost, edits, last state) of the cheapest, ASCII-least edits of turns (initial, truncated) from ``entry``.

    ``closing`` is the cost of stopping in each state; it counts in the result, which is (NEVER, "", entry) if no edit
    list reaches an allowed state.  Depth first with an explicit stack: a prefix is left when its cost and the bound of its
    suffix exceed the best list found (or equal it, with larger initials so far), or when its node (turn, state) was reached
    by a prefix no worse.
    """
    n, bound = len(turns), bound or lower_bounds(turns)
    best, edits, last = NEVER, "", entry
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i][state]
        if least > best or (least == best and audit > edits[:len(audit)]):
            continue
        seen = table[i].get(state)
        if seen is not None and seen <= (cost, audit):
            continue
        table[i][state] = (cost, audit)
        if i == n:
            if (cost + closing[state], audit) < (best, edits):
                best, edits, last = cost + closing[state], audit, state
            continue
        # the most promising edit is taken off the stack first
        found = sorted(options(turns[i], state), key=lambda o: (-o[0] - bound[i + 1][o[2]], [-ord(c) for c in o[1]]))
        stack.extend((i + 1, to, cost + price, audit + marks) for price, marks, to in found)
    return best, edits, last


def window_answers(turns: list[tuple[str, bool]]) -> tuple[list[int], list[int]]:
    """Costs [entry, last] of a window and, for each entry, the rank of the last states by their edit lists."""
    costs, ranks, bound = [], [], lower_bounds(turns)
    for entry in STATES:
        found = [search(turns, entry, tuple(0 if s == last else NEVER for s in STATES), bound) for last in STATES]
        order = sorted(STATES, key=lambda s: found[s][1])
        costs += [f[0] for f in found]
        ranks += [order.index(s) for s in STATES]
    return costs, ranks


def combined(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The answer of two neighbours as one."""
    (c1, r1), (c2, r2) = one, two
    costs, ranks = [], []
    for entry in STATES:
        keys = []
        for last in STATES:
            via = min(STATES, key=lambda m: (c1[4 * entry + m] + c2[4 * m + last], r1[4 * entry + m]))
            costs.append(min(NEVER, c1[4 * entry + via] + c2[4 * via + last]))
            keys.append((r1[4 * entry + via], r2[4 * via + last]))
        order = sorted(STATES, key=lambda s: keys[s])
        ranks += [order.index(s) for s in STATES]
    return costs, ranks


def path(parts: list[tuple[list[int], list[int]]], entry: int, last: int) -> list[tuple[int, int]]:
    """(entry, last) of each neighbour on the cheapest, least way from ``entry`` to ``last``."""
    rest = [[0 if s == last else NEVER for s in STATES]]
    for costs, _ in reversed(parts):
        rest.append([min(costs[4 * s + m] + rest[-1][m] for m in STATES) for s in STATES])
    rest.reverse()
    out = []
    for k, (costs, ranks) in enumerate(parts):
        to = min(STATES, key=lambda m: (costs[4 * entry + m] + rest[k + 1][m], ranks[4 * entry + m]))
        out.append((entry, to))
        entry = to
    return out


def whole_path(answer: tuple[list[int], list[int]]) -> int:
    """The last state of a conversation, from its answer."""
    costs, ranks = answer
    return min(STATES, key=lambda m: (costs[4 * START + m] + CLOSING[m], ranks[4 * START + m]))


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns of ``turns`` after damage, and ``copies``: 0 for a dropped turn, 2 for a repeated one.

    ``crc32("id:turn") % 20`` chooses: 0 drops, 1 empties the text, 2 takes its ``[.!?]``, 3 repeats, 4 makes the role user.
    A null id, turn, role or text is one space (ids and turns stay null in their columns).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = turns.select(F.col(id_col), F.col(turn_col), space(role_col).alias(role_col), space(text_col).alias(text_col), code.alias("copies"))
    code = F.col("copies")
    return rows.select(
        id_col, turn_col, F.when(code == 4, "user").otherwise(F.col(role_col)).alias(role_col),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)).alias(text_col),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Different turns (``_c``, ``_t``, ``_r``, ``_h``) with ``_n`` rows each, numbered ``_m`` 0, 1, ... in order, and faults.

    Equal rows stand together, so one row with a count is the same, and a turn that many rows repeat is sorted as one.
    """
    order = ["_c", "_t", "_r", "_h"]
    one = rows.groupBy(*order).agg(F.sum("_n").cast("long").alias("_n"), F.first("_blank").alias("_blank"), F.first("_cut").alias("_cut"))
    one = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_u", F.monotonically_increasing_id())
    one = materialize(one, "conversation-turns").withColumn("_part", F.shiftright("_u", 33))
    parts = one.groupBy("_part").agg(F.count(F.lit(1)).alias("_k"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"))
    one = one.join(F.broadcast(parts), "_part").withColumn("_m", F.col("_k0") + F.col("_u").bitwiseAND(F.lit((1 << 33) - 1)))
    again = one.where("_n > 0 and not _blank").groupBy("_c", "_r", "_h").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_k"))
    again = again.where("_k > 1").select(F.col("_c").alias("_c0"), F.col("_r").alias("_r0"), F.col("_h").alias("_h0"), "_first")
    again = measured_side(again, "conversation-repeats", 96)
    one = one.join(again, F.col("_c").eqNullSafe(F.col("_c0")) & (F.col("_r") == F.col("_r0")) & (F.col("_h") == F.col("_h0")), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_m") > F.col("_first"), "duplicate").when(F.col("_cut"), "truncated").otherwise("")
    return one.select(*order, "_n", "_m", fault.alias("_fault"))


def _batch(like: pa.RecordBatch, rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch; the first column has the type of the conversation id."""
    types = [like.schema.field("_c").type, *kinds.values()]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["_c", *kinds])


_ANSWER = {"_k": pa.int64(), "_costs": pa.list_(pa.int64()), "_ranks": pa.list_(pa.int32())}
_STATES = {"_k": pa.int64(), "_entry": pa.int32(), "_last": pa.int32(), "_end": pa.bool_()}


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("_c", "_k", "_w")))
        yield _batch(b, [(c, k, *window_answers([(x["_i"], x["_cut"]) for x in w])) for c, k, w in rows], _ANSWER)


def _parts(cell) -> list[tuple[list[int], list[int]]]:
    return [(p["_costs"], p["_ranks"]) for p in cell]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("_c", "_k", "_parts")))
        yield _batch(b, [(c, k, *reduce(combined, _parts(parts))) for c, k, parts in rows], _ANSWER)


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the neighbours of each group; a group without states is a whole conversation."""
    for b in batches:
        rows = []
        for c, cell, entry, last, end in zip(*(b.column(x).to_pylist() for x in ("_c", "_parts", "_entry", "_last", "_end"))):
            parts = _parts(cell)
            if last is None:
                entry, last, end = START, whole_path(reduce(combined, parts)), True
            way = path(parts, entry, last)
            rows += [(c, p["_k"], e, to, end and i == len(way) - 1) for i, (p, (e, to)) in enumerate(zip(cell, way))]
        yield _batch(b, rows, _STATES)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Initials of each turn's edits, and what closes the conversation beside its last turn."""
    for b in batches:
        rows = []
        for c, w, entry, last, end in zip(*(b.column(x).to_pylist() for x in ("_c", "_w", "_entry", "_last", "_end"))):
            closing = CLOSING if last is None else tuple(0 if s == last else NEVER for s in STATES)
            _, audit, state = search([(x["_i"], x["_cut"]) for x in w], START if entry is None else entry, closing)
            at = 0
            for k, x in enumerate(w):
                to = at + (2 if audit[at] == "I" else 1)
                tail = CLOSED_BY[state] if k == len(w) - 1 and (end or last is None) else ""
                rows.append((c, x["_m"], audit[at:to], tail))
                at = to
        yield _batch(b, rows, {"_m": pa.int64(), "_e": pa.string(), "_z": pa.string()})


def _searched(turns: DataFrame, window_bits: int, group_bits: int) -> DataFrame:
    """(``_c``, ``_m``, ``_e``, ``_z``): edits of turns (``_c``, ``_m``, ``_i`` initial, ``_cut`` truncated)."""
    kind = turns.schema["_c"].dataType.simpleString()
    answer, states = f"_c {kind}, _k long, _costs array<long>, _ranks array<int>", f"_c {kind}, _k long, _entry int, _last int, _end boolean"
    nothing = {c: F.lit(None).cast(t) for c, t in (("_entry", "int"), ("_last", "int"), ("_end", "boolean"))}

    def in_order(rows: DataFrame, bits: int, key: str, out: str, *cells: str) -> DataFrame:
        """At most 2 ** ``bits`` neighbours of one conversation as an array."""
        return rows.groupBy("_c", F.shiftright(key, bits).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*cells))).alias(out))

    def with_states(rows: DataFrame, given: DataFrame) -> DataFrame:
        given = given.withColumnsRenamed({"_c": "_c0", "_k": "_k0"})
        return rows.join(given, F.col("_c").eqNullSafe(F.col("_c0")) & (F.col("_k") == F.col("_k0"))).drop("_c0", "_k0")

    windows = materialize(in_order(turns, window_bits, "_m", "_w", "_m", "_i", "_cut"), "conversation-windows")
    several = windows.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_c").alias("_c0"))
    several = measured_side(several, "long-conversations", 16)
    same = F.col("_c").eqNullSafe(F.col("_c0"))
    todo, levels = windows.join(several, same, "left_semi"), []
    found = todo.mapInArrow(_answers, answer)
    while True:
        levels.append(materialize(in_order(found, group_bits, "_k", "_parts", "_k", "_costs", "_ranks"), "conversation-groups"))
        if not levels[-1].groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").take(1):
            break
        found = levels[-1].mapInArrow(_combine, answer)
    given = levels.pop().withColumns(nothing).mapInArrow(_hand_down, states)
    for groups in reversed(levels):
        given = with_states(groups, given).mapInArrow(_hand_down, states)
    alone = windows.join(several, same, "left_anti").withColumns(nothing)
    return alone.unionByName(with_states(todo, given)).mapInArrow(_edits, f"_c {kind}, _m long, _e string, _z string")


class _Repair:
    """Applies the edits of one conversation, turn after turn."""

    def __init__(self):
        self.state, self.tail = START, ""

    def _insert(self) -> tuple[str, str, str]:
        self.state, role = _after(self.state), "assistant" if self.state == USER else "user"
        return "I", role, ""

    def turn(self, role: str, text: str, rows: int, edits: str | None, tail: str | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) in order; deleted turns have their own role."""
        for e in edits or "":
            if e == "I":
                yield self._insert()
            elif e == "D":
                yield "D", role, text
            elif e == "K" and role[:1] == "s":
                self.state = SYSTEM
                yield "K", role, text
            else:
                new = "assistant" if self.state == USER else "user"
                self.state = _after(self.state)
                yield e, role if e == "K" else new, text
        for _ in range(rows - (1 if edits else 0)):
            yield "D", role, text
        self.tail = tail or self.tail

    def close(self) -> Iterator[tuple[str, str, str]]:
        for _ in self.tail:
            yield self._insert()


class _Report:
    """Counts, audit and digest of one conversation."""

    def __init__(self):
        self.repair, self.audit, self.hash, self.any = _Repair(), [], hashlib.sha256(), False
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def _apply(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for edit, role, text in edits:
            self.audit.append(edit)
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            if edit != "D":
                self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode())
                self.any = True

    def add(self, turn, role: str, text: str | None, rows: int, fault: str, edits: str | None, tail: str | None) -> None:
        if not rows:
            return
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += rows - 1  # equal neighbours
        self.initial = initial
        if fault:
            self.faults[fault] += 1
        self.faults["blank" if fault == "blank" else "duplicate"] += rows - 1
        if fault == "truncated" and "D" not in edits:
            self.cost += TRUNCATED
        self._apply(self.repair.turn(role, text or "", rows, edits, tail))

    def row(self) -> tuple:
        self._apply(self.repair.close())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_ROW = ("_t", "_r", "_x", "_n", "_fault", "_e", "_z")


def _with_edits(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, window_bits: int, group_bits: int) -> DataFrame:
    """All different turns with texts and edits, each conversation whole in one partition and in order."""
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select(F.col(id_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(F.col(role_col), F.lit(" ")).alias("_r"),
                        F.coalesce(F.col(text_col), F.lit(" ")).alias("_x"), copies.alias("_n"))
    gone = F.col("_n") == 0  # a dropped turn only keeps its conversation in the result
    rows = rows.withColumns({"_t": F.when(~gone, F.col("_t")), "_r": F.when(gone, "").otherwise(F.col("_r")), "_x": F.when(gone, "").otherwise(F.col("_x"))})
    bare = F.trim("_x", F.lit(_WS))
    rows = rows.withColumns({"_h": F.unhex(F.sha2("_x", 256)), "_blank": F.length(bare) == 0, "_cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    ordered = materialize(_ordered(rows.drop("_x")), "conversation-faults")
    free = ordered.where("_n > 0 and _fault in ('', 'truncated')")
    edits = _searched(free.select("_c", "_m", F.substring("_r", 1, 1).alias("_i"), (F.col("_fault") == "truncated").alias("_cut")), window_bits, group_bits)
    edits = edits.drop("_c").withColumnRenamed("_m", "_m0")
    known = ordered.join(edits, F.col("_m") == F.col("_m0"), "left")
    # texts meet their edits in a grouping: equal turns are one before the shuffle, whatever their number
    key, rest = ["_c", "_t", "_r", "_h"], {"_n": "long", "_fault": "string", "_e": "string", "_z": "string"}
    texts = rows.where("_n > 0").select(*key, "_x", *[F.lit(None).cast(t).alias(c) for c, t in rest.items()])
    both = texts.unionByName(known.select(*key, F.lit(None).cast("string").alias("_x"), *rest))
    both = both.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_x", *rest)])
    return both.repartition("_c").sortWithinPartitions(*key).select("_c", *_ROW)


def repair_report(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  window_bits: int = WINDOW_BITS, group_bits: int = GROUP_BITS) -> DataFrame:
    """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    A column ``copies`` (see :func:`damage`) counts how often a turn stands there, 0 for not at all; without it each row
    counts once.  Turns are ordered by turn number, nulls first, then role, then a hash of the text.  A null role or text is
    one space, null ids form a conversation, equal rows are repeats.  A role counts by its first character; an empty or
    other role must be rerolled or deleted.  A conversation without turns has zeros, no audit and the digest of nothing.
    Other columns are not read; an empty table gives no rows.
    """
    rows = _with_edits(turns, id_col, turn_col, role_col, text_col, window_bits, group_bits)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kinds = {**dict.fromkeys(counts, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, report, batch = None, None, None
        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(x).to_pylist() for x in ("_c", *_ROW))):
                if report is None or c != conv:
                    if report is not None:
                        out.append((conv, *report.row()))
                    conv, report = c, _Report()
                report.add(*row)
            yield _batch(batch, out, kinds)
        if report is not None:
            yield _batch(batch, [(conv, *report.row())], kinds)

    kind = rows.schema["_c"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in counts)
    return rows.mapInArrow(work, f"_c {kind}, {longs}, audit string, repaired_sha256 string").withColumnRenamed("_c", id_col)


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   window_bits: int = WINDOW_BITS, group_bits: int = GROUP_BITS) -> DataFrame:
    """The turns of the repaired conversations: id, ``position`` from 0, turn (null if inserted), role, text and ``edit``.

    ``edit`` is the initial of Keep, Rerole or Insert.  Cases as in :func:`repair_report`; conversations without a turn left
    have no rows.
    """
    rows = _with_edits(turns, id_col, turn_col, role_col, text_col, window_bits, group_bits)
    turn_kind = rows.schema["_t"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, position, batch = None, None, 0, None

        def listed(edits, turn) -> Iterator[tuple]:
            nonlocal position
            for edit, role, text in edits:
                if edit != "D":
                    yield conv, position, None if edit == "I" else turn, role, text, edit
                    position += 1

        def kinds() -> dict[str, pa.DataType]:
            return {"position": pa.int64(), "_t": batch.schema.field("_t").type, "role": pa.string(), "text": pa.string(), "edit": pa.string()}

        for batch in batches:
            out = []
            for c, turn, role, text, n, _, edits, tail in zip(*(batch.column(x).to_pylist() for x in ("_c", *_ROW))):
                if repair is None or c != conv:
                    out += listed(repair.close(), None) if repair is not None else []
                    conv, repair, position = c, _Repair(), 0
                out += listed(repair.turn(role, text or "", n, edits, tail), turn)
            yield _batch(batch, out, kinds())
        if repair is not None:
            yield _batch(batch, list(listed(repair.close(), None)), kinds())

    kind = rows.schema["_c"].dataType.simpleString()
    out = rows.mapInArrow(work, f"_c {kind}, position long, _t {turn_kind}, role string, text string, edit string")
    return out.withColumnsRenamed({"_c": id_col, "_t": turn_col, "role": role_col, "text": text_col})
