"""Class distributions that list only the classes seen in a context.

A distribution is ``struct<ids array<int> (ascending), ps array<double>, rest double, size int>``: probabilities of the
listed classes, and ``rest`` for every other class of ``size``.  Scores, mixtures and draws work on it directly; its length
is that of the seen classes, whatever the vocabulary.  :func:`dense` lists all classes where an output asks for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SCHEMA = "struct<ids: array<int>, ps: array<double>, rest: double, size: int>"
EPS = 1e-12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas in it refer to it per element."""
    return F.transform(F.array(value), body)[0]


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def make(ids: Column, ps: Column, rest: Column, size) -> Column:
    return F.struct(ids.alias("ids"), ps.alias("ps"), rest.cast("double").alias("rest"), (size if isinstance(size, Column) else F.lit(size)).cast("int").alias("size"))


def uniform(size: int) -> Column:
    return make(F.array().cast("array<int>"), F.array().cast("array<double>"), F.lit(1.0 / size), size)


def smoothed(pairs: Column, weight: Column, size: int, alpha: float) -> Column:
    """From (id, count) structs sorted by id and their total, with ``alpha`` added to every class."""
    den = weight + alpha * size
    return bind(den, lambda d: make(F.transform(pairs, lambda e: e["y"].cast("int")), F.transform(pairs, lambda e: (e["n"] + alpha) / d), alpha / d, size))


def floored(pairs: Column, weight: Column, size: int, floor: float = 1e-6) -> Column:
    """Shares of the listed classes, ``floor`` for the others, scaled to sum to one."""
    raw = F.transform(pairs, lambda e: e["n"] / weight)
    return bind(F.struct(raw.alias("r"), (total(raw) + (size - F.size(raw)) * floor).alias("t")), lambda s: make(
        F.transform(pairs, lambda e: e["y"].cast("int")), F.transform(s["r"], lambda p: p / s["t"]), floor / s["t"], size))


def others(d) -> Column:
    """Number of classes that are not listed."""
    return _col(d)["size"] - F.size(_col(d)["ids"])


def prob(d, i) -> Column:
    d = _col(d)
    return bind(F.array_position(d["ids"], _col(i).cast("int")), lambda at: F.when(at > 0, F.get(d["ps"], (at - 1).cast("int"))).otherwise(d["rest"]))


def dense(d) -> Column:
    """Probabilities of all classes in order."""
    return bind(_col(d), lambda x: bind(F.map_from_arrays(x["ids"], x["ps"]), lambda m: F.transform(
        F.sequence(F.lit(0), x["size"] - 1), lambda i: F.coalesce(F.try_element_at(m, i), x["rest"]))))


def first_other(d) -> Column:
    """Lowest class that is not listed: ids are ascending, so an id equals its place only in an unbroken start."""
    return F.size(F.filter(_col(d)["ids"], lambda x, i: x == i))


def argmax(d) -> Column:
    """The most probable class, lowest id on ties."""
    d = _col(d)

    def pick(best: Column) -> Column:
        listed = F.get(d["ids"], (F.array_position(d["ps"], best) - 1).cast("int"))
        free = (others(d) > 0) & (best.isNull() | (d["rest"] >= best))
        tie = F.when(best == d["rest"], F.least(listed, first_other(d))).otherwise(first_other(d))
        return F.when(free, tie).otherwise(listed).cast("int")

    return bind(F.array_max(d["ps"]), pick)


def top(d) -> Column:
    d = _col(d)
    return F.greatest(F.array_max(d["ps"]), F.when(others(d) > 0, d["rest"]))


def rank(d, y) -> Column:
    """Classes before ``y``: more probable, or as probable with a lower id."""
    d, y = _col(d), _col(y)

    def count(py: Column) -> Column:
        listed = F.size(F.filter(d["ps"], lambda p, i: (p > py) | ((p == py) & (F.get(d["ids"], i) < y))))
        lower = y - F.size(F.filter(d["ids"], lambda x: x < y))  # unlisted ids below y
        return listed + F.when(d["rest"] > py, others(d)).when(d["rest"] == py, lower).otherwise(0)

    return bind(prob(d, y), count)


def clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0))


def over(d, f: Callable[[Column], Column]) -> Column:
    """Sum of ``f(p)`` over all classes."""
    d = _col(d)
    return total(F.transform(d["ps"], f)) + F.when(others(d) > 0, others(d) * f(d["rest"])).otherwise(0.0)


def entropy(d) -> Column:
    return -over(d, lambda p: p * F.ln(clip(p)))


def log_scale(d, t) -> Column:
    """Log of the sum of p ** (1 / t) over all classes."""
    d, t = _col(d), _col(t)
    return bind(F.ln(clip(top(d))) / t, lambda m: m + F.ln(over(d, lambda p: F.exp(F.ln(clip(p)) / t - m))))


def temper(d, t) -> Column:
    """Probabilities to the power 1 / t, scaled to sum to one."""
    d, t = _col(d), _col(t)
    power = lambda p, s: F.exp(F.ln(clip(p)) / t - s)
    return bind(log_scale(d, t), lambda s: make(d["ids"], F.transform(d["ps"], lambda p: power(p, s)), power(d["rest"], s), d["size"]))


def mixture(dists: Column) -> Column:
    """Mean of an array of distributions over the same classes."""
    def mean(ds: Column, f: Callable[[Column], Column]) -> Column:
        return total(F.transform(ds, f)) / F.size(ds)

    return bind(dists, lambda ds: bind(F.array_sort(F.array_distinct(F.flatten(F.transform(ds, lambda d: d["ids"])))), lambda ids: make(
        ids, F.transform(ids, lambda i: mean(ds, lambda d: prob(d, i))), mean(ds, lambda d: d["rest"]), ds[0]["size"])))


def divergence(p, q, eps: float = 1e-9) -> Column:
    """Kullback-Leibler divergence with ``eps`` added inside the logarithms."""
    p, q = _col(p), _col(q)
    term = lambda a, b: a * (F.ln(a + eps) - F.ln(b + eps))
    return bind(F.array_union(p["ids"], q["ids"]), lambda ids: total(F.transform(ids, lambda i: term(prob(p, i), prob(q, i))))
                + (p["size"] - F.size(ids)) * term(p["rest"], q["rest"]))


def intervals(d) -> Column:
    """The cumulative distribution in order of ids, as far as a draw needs it: one interval per listed class or unbroken run
    of others, with its upper bound ``up``, the mass below it ``lo``, and its classes ``at`` ... ``until`` - 1."""
    d = _col(d)

    def add(a: Column, at: Column, until: Column, up: Column) -> Column:
        part = F.struct(up.alias("up"), a["mass"].alias("lo"), at.cast("int").alias("at"), until.cast("int").alias("until"))
        return F.struct(up.alias("mass"), until.cast("int").alias("next"), F.concat(a["parts"], F.array(part)).alias("parts"))

    def gap(a: Column, until: Column) -> Column:
        """A run of classes that are not listed."""
        return F.when(until > a["next"], add(a, a["next"], until, a["mass"] + (until - a["next"]) * d["rest"])).otherwise(a)

    kind = "struct<mass: double, next: int, parts: array<struct<up: double, lo: double, at: int, until: int>>>"
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("next"), F.array().alias("parts")).cast(kind)
    step = lambda a, e: bind(gap(a, e["ids"]), lambda b: add(b, e["ids"], e["ids"] + 1, b["mass"] + e["ps"])).cast(kind)
    listed = F.aggregate(F.arrays_zip(d["ids"].alias("ids"), d["ps"].alias("ps")), start, step)
    return bind(listed, lambda a: bind(gap(a, d["size"])["parts"], lambda p: F.struct(
        p["up"].alias("up"), p["lo"].alias("lo"), p["at"].alias("at"), p["until"].alias("until"), d["rest"].alias("rest"), d["size"].alias("size"))))


def draw_interval(c, u) -> Column:
    """The class at ``u`` of :func:`intervals`; the last class where rounding leaves a gap.

    ``u`` is computed once: a lambda computes an expression from outside again for every element.
    """
    c, last = _col(c), _col(c)["size"] - 1

    def inside(i: Column, u: Column) -> Column:
        at, until = F.get(c["at"], i), F.get(c["until"], i)
        k = F.floor((u - F.get(c["lo"], i)) / c["rest"])
        return F.when(until - at > 1, F.least(at + F.greatest(k, F.lit(0)), until - 1).cast("int")).otherwise(at)

    return bind(_col(u), lambda u: bind(F.size(F.filter(c["up"], lambda x: x <= u)), lambda i: F.coalesce(inside(i, u), last)))


def draw(d, u) -> Column:
    """The class at ``u`` of the cumulative distribution in order of ids."""
    return bind(intervals(d), lambda c: draw_interval(c, u))
