import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from caseloom.llm import conversations as cv

GOOD = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def tiny(turns):
    """Cheapest, ASCII-least audit of turns (initial, truncated) by trying every list of edits, with two insertions at a place."""
    best = None
    n = len(turns)
    for acts in product("DKR", repeat=n):
        for gaps in product(range(3), repeat=n + 1):
            roles, audit, cost = [], "", 0
            for k in range(n + 1):
                roles += ["I"] * gaps[k]
                audit += "I" * gaps[k]
                cost += 3 * gaps[k]
                if k < n:
                    audit += acts[k]
                    cost += {"D": 4, "K": 0, "R": 3}[acts[k]] + (3 if turns[k][1] and acts[k] != "D" else 0)
                    roles += [] if acts[k] == "D" else [turns[k][0]] if acts[k] == "K" else ["I"]
            if best is not None and (cost, audit) >= best:
                continue
            if any(GOOD.match("".join(r)) for r in product(*[("u", "a") if x == "I" else (x or "-",) for x in roles])):
                best = (cost, audit)
    return best


def closed(turns):
    cost, audit, state = cv.search(turns, cv.START, cv.CLOSING)
    return cost, audit + cv.CLOSED_BY[state]


def test_search_against_all_edit_lists():
    for n in (0, 1, 2):
        for turns in product(product("suax", (False, True)), repeat=n):
            assert closed(turns) == tiny(turns), turns
    r = np.random.default_rng(0)
    for _ in range(40):
        turns = [("suau"[r.integers(4)], bool(r.random() < .3)) for _ in range(3)]
        assert closed(turns) == tiny(turns), turns


def table_search(turns):
    """The same result by a plain table over (turn, state), from the end."""
    n = len(turns)
    rest = [{s: (cv.CLOSING[s], cv.CLOSED_BY[s]) for s in cv.STATES}]
    for initial, cut in reversed(turns):
        now = {}
        for s in cv.STATES:
            options, extra, at, marks = [(4 + rest[0][s][0], "D" + rest[0][s][1])], 3 if cut else 0, s, ""
            for inserted in range(4):
                nxt = cv.ASSISTANT if at == cv.USER else cv.USER
                need = "a" if at == cv.USER else "u"
                to = [("R", nxt, 3)] + ([("K", nxt, 0)] if initial == need else []) + ([("K", cv.SYSTEM, 0)] if initial == "s" and at == cv.START else [])
                options += [(3 * inserted + c + extra + rest[0][q][0], marks + e + rest[0][q][1]) for e, q, c in to]
                at, marks = nxt, marks + "I"
            now[s] = min(options)
        rest.insert(0, now)
    return rest[0][cv.START]


@pytest.mark.parametrize("seed", range(4))
def test_search_on_longer_lists(seed):
    r = np.random.default_rng(seed)
    for n in (5, 20, 128):
        for p in (.05, .5, .95):
            turns = [("ua"[int(k) % 2] if r.random() > p else "suax"[r.integers(4)], bool(r.random() < p / 2)) for k in range(n)]
            assert closed(turns) == table_search(turns)
            bound = cv.lower_bounds(turns)
            for i in range(0, n, 7):
                assert all(bound[i][s] <= cv.search(turns[i:], s, cv.CLOSING)[0] for s in cv.STATES)


def test_windows_combine(seed=1):
    r = np.random.default_rng(seed)
    for n in (2, 9, 40):
        turns = [("suaa"[r.integers(4)], bool(r.random() < .2)) for _ in range(n)]
        parts = [cv.window_answers(turns[k:k + 4]) for k in range(0, n, 4)]
        total = parts[0]
        for p in parts[1:]:
            total = cv.combined(total, p)
        last = cv.whole_path(total)
        audit = "".join(cv.search(turns[4 * k:4 * k + 4], e, tuple(0 if s == to else cv.NEVER for s in cv.STATES))[1]
                        for k, (e, to) in enumerate(cv.path(parts, cv.START, last)))
        assert audit + cv.CLOSED_BY[last] == table_search(turns)[1]


def brute(rows):
    """conv -> contract row, from undamaged rows (conv, turn, role, text); turns of one number and role must be equal."""
    out = {}
    text = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in rows}:
        seq = []
        for c, t, role, x in rows:
            if c != conv:
                continue
            role, x = text(role), text(x)
            code = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
            x, role = ("" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x), ("user" if code == 4 else role)
            seq += [(t, role, x)] * (0 if code == 0 else 2 if code == 3 else 1)
        seq.sort(key=lambda s: (s[0] is not None, s[0] or 0, s[1], hashlib.sha256(s[2].encode()).digest()))
        seen, faults, free = set(), [], []
        for t, role, x in seq:
            bare = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not BLANK.search(x) else "duplicate" if (role, x) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, x))
            faults.append(fault)
            if fault in ("", "truncated"):
                free.append((role[:1], fault == "truncated"))
        cost, marks = table_search(free)
        audit, final, state, at = "", [], cv.START, 0

        def put(initial_role):
            nonlocal state
            role = ("assistant" if state == cv.USER else "user") if initial_role is None else initial_role
            state = cv.SYSTEM if role[0] == "s" else cv.ASSISTANT if state == cv.USER else cv.USER
            return role

        for (t, role, x), fault in zip(seq, faults):
            if fault in ("blank", "duplicate"):
                audit += "D"
                continue
            while marks[at] == "I":
                final.append(put(None) + ":")
                audit += "I"
                at += 1
            audit += marks[at]
            if marks[at] != "D":
                final.append(put(role if marks[at] == "K" else None) + ":" + x)
            at += 1
        final += [put(None) + ":" for _ in marks[at:]]
        audit += marks[at:]
        turns = [t for t, _, _ in seq if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(seq, seq[1:])]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost + 4 * sum(f in ("blank", "duplicate") for f in faults), audit,
                     hashlib.sha256("\n".join(final).encode()).hexdigest())
    return out


def conversation_rows(seed):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "so", "é?", "", " \n", None, "tail. \t", "ünï", "two\nlines."] + [f"text {i}." for i in range(30)]
    roles = ["user", "assistant", "system", "tool", None, ""]
    rows = []
    for conv in range(80):
        for turn in range(int(r.integers(1, 14))):
            role = ["user", "assistant"][turn % 2] if r.random() < .7 else roles[int(r.choice(6, p=[.35, .35, .15, .05, .05, .05]))]
            rows.append((conv, turn * int(r.integers(1, 3)) if conv % 5 else turn, role, texts[r.integers(len(texts))]))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of many." if t % 3 else "again and again.") for t in range(700)]
    rows += [(None, 1, "user", "x" * 50000), (None, None, "assistant", "y."), (501, None, None, None), (502, 1, "user", "same.")]
    rows += [(502, 1, "user", "same.")] * 40 + [(503, 2 ** 40, "system", "s."), (503, -5, "user", "u.")]
    seen, out = {}, []
    for row in rows:  # the order of different turns with one number is not part of the contract
        if seen.setdefault(row[:2], row) == row:
            out.append(row)
    return out


@pytest.mark.parametrize("bits", [(cv.WINDOW_BITS, cv.GROUP_BITS), (2, 2)])
def test_repair_report(spark, bits):
    rows = conversation_rows(7)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, _m int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_report(cv.damage(df), window_bits=bits[0], group_bits=bits[1]).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_repaired_turns(spark):
    rows = conversation_rows(8)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    damaged = cv.damage(df)
    report = {r.conv_id: r for r in cv.repair_report(damaged).collect()}
    found = {}
    for r in cv.repaired_turns(damaged, window_bits=3, group_bits=2).collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, r in report.items():
        turns = sorted(found.get(conv, []), key=lambda x: x.position)
        assert [t.position for t in turns] == list(range(len(turns)))
        assert "".join(t.edit for t in turns) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256
        assert GOOD.match("".join(t.role[0] for t in turns))


def test_other_names_and_no_rows(spark):
    df = spark.createDataFrame([("c1", 3, "system", "Be kind."), ("c1", 4, "user", "Hi."), ("c2", 1, "assistant", "")], "chat string, n int, who string, says string")
    got = sorted(tuple(r) for r in cv.repair_report(df, "chat", "n", "who", "says").collect())
    assert [g[:8] for g in got] == [("c1", 0, 0, 0, 0, 0, 3, "KKI"), ("c2", 0, 1, 0, 0, 0, 4, "D")]
    empty = df.limit(0)
    assert cv.repair_report(empty, "chat", "n", "who", "says").count() == 0 == cv.repaired_turns(empty, "chat", "n", "who", "says").count()
