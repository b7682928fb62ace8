"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that mean "no value".
MISSING_TOKENS = ["", "UNKNOWN", "UNDEFINED", "nan", "None", "-", "<NA>"]
AUDIT_MISSING_TOKENS = ["", "UNKNOWN", "UNDEFINED", "nan", "None", "-"]
PAD, UNK, EOS = 0, 1, 2
SPECIALS = ["<PAD>", "<UNK>", "<EOS>"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def activity_label(*cols) -> Column:
    """Selected attributes joined with ``|``; a null attribute contributes an empty text."""
    return F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def clean(c) -> Column:
    c = _c(c).cast("string")
    return F.when(c.isNull() | c.isin(MISSING_TOKENS), F.lit("<MISSING>")).otherwise(c)


def is_missing_text(c) -> Column:
    c = _c(c)
    return c.isNull() | c.isin(AUDIT_MISSING_TOKENS)


def numeric(c) -> Column:
    """Parse a text attribute; unparsable, missing or non-finite values become null."""
    c = _c(c).cast("string")
    v = F.when(c.isin(MISSING_TOKENS), F.lit(None)).otherwise(c.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def epoch_us(ts) -> Column:
    """Microseconds since the epoch of a zone-less UTC timestamp, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), _c(ts))


def local_time(ts, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def hash_order(seed, *cols) -> Column:
    """First 60 bits of md5(seed:col:...) as a long: a portable, seeded random order key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_key(seed, *cols) -> Column:
    """The same order as :func:`hash_order` as 15 hex digits; cheaper where only the order matters."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])), 1, 15)


def hash_unit(seed, *cols) -> Column:
    """Uniform value in [0, 1) with 52 bits, a pure function of its inputs."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def prefix_bucket(k) -> Column:
    k = _c(k)
    return (
        F.when(k == 1, "1").when(k == 2, "2").when(k == 3, "3").when(k <= 5, "4-5")
        .when(k <= 10, "6-10").when(k <= 20, "11-20").otherwise("21-10000")
    )


def distance_bucket(d) -> Column:
    d = _c(d)
    return F.when(d <= 2, "1-2").when(d <= 5, "3-5").when(d <= 10, "6-10").otherwise("11+")


def first_argmax(arr: Column) -> Column:
    """0-based index of the maximum, lowest index on ties."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def decompose_activity(label, family: str) -> Column:
    """Activity label -> array of components, by label family."""
    s = _c(label)
    if family == "status":
        rest = F.when(F.instr(s, "|") > 0, F.substring(s, F.instr(s, "|") + 1, F.length(s))).otherwise("")
        return F.array(F.concat(F.lit("status="), F.substring_index(s, "|", 1)), F.concat(F.lit("sub="), rest))
    if family == "agent":
        base = F.substring_index(s, "|", 1)
        status = F.when(F.instr(s, "|") > 0, F.substring(s, F.instr(s, "|") + 1, F.length(s))).otherwise("")
        app = F.substring_index(base, ".", 1)
        api = F.when(F.instr(base, ".") > 0, F.substring(base, F.instr(base, ".") + 1, F.length(base))).otherwise("")
        return F.array(F.concat(F.lit("app="), app), F.concat(F.lit("api="), api), F.concat(F.lit("status="), status))
    rx = r"^(.+?) ([A-Z_]+) by ([A-Z_ ]+)$"
    hit = s.rlike(rx)
    part = lambda i, tag, other: F.concat(F.lit(tag), F.when(hit, F.regexp_extract(s, rx, i)).otherwise(other))
    return F.array(part(1, "obj=", s), part(2, "act=", F.lit("<none>")), part(3, "actor=", F.lit("<none>")))


def rnd(c, n: int = 6) -> Column:
    return F.round(_c(c).cast("double"), n)
