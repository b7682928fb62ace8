"""Document quality as a short-circuit cascade.

Each rule is a condition on text statistics.  Its cost and its rejection rate are estimated on a bounded sample, and
the rules run in the order of rejections per second.  They become one CASE expression, which stops at the first
rejection, so costly statistics are computed only for documents that passed the cheap rules.  The verdict is a
conjunction and does not depend on the order; only the named reason does.

Built-in functions only.  Texts are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.common import WS, let, text_of, total
from caseloom.session import materialize

#: Rows on which cost and selectivity are estimated; they order the rules and decide nothing else.
SAMPLE_ROWS = 400


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS + "+"), "")


def _equal_neighbour(s: Column, key: Callable[[Column], Column]) -> Column:
    """Elements of a sorted array whose key equals that of the element before or after."""
    return F.filter(s, lambda x, j: ((j > 0) & (key(F.get(s, j - 1)) == key(x)))
                    | ((j + 1 < F.size(s)) & (key(F.get(s, j + 1)) == key(x))))


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in ``w``.

    Windows are first sorted as packed longs (leading hash bits, position), which finds every window that could
    repeat; only those are compared as words, so equal leading bits never count as a repeat.
    """
    n = F.size(w)
    bits = F.ceil(F.log2(n + F.lit(1.0))).cast("int")

    def packed(b: Column) -> Column:
        return F.sort_array(F.transform(F.slice(w, F.lit(1), n - 2), lambda x, i: F.call_function(
            "shiftleft", F.call_function("shiftright", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), b), b)
            .bitwiseOR(i.cast("long"))))

    def starts(b: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - F.lit(1)
        return let(packed(b), lambda s: F.transform(
            _equal_neighbour(s, lambda x: F.call_function("shiftright", x, b)), lambda x: x.bitwiseAND(mask).cast("int")))

    def exact(found: Column) -> Column:
        named = F.sort_array(F.transform(found, lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i"))))
        return let(named, lambda s: F.sort_array(F.transform(_equal_neighbour(s, lambda x: x["w"]), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return total(F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(3), F.get(p, k + 1) - x))
                                 .otherwise(3).cast("long")))

    some = let(bits, lambda b: let(starts(b), lambda c: F.when(F.size(c) > 0, let(exact(c), covered))
                                   .otherwise(F.lit(0).cast("long"))))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(some)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _without(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


#: Statistics by name, as functions of (text, words).
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: _without(t, "[#*$%&|<>]"),
    "n_upper": lambda t, w: _without(t, r"\p{Lu}"),
    "n_lines": lambda t, w: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t, w: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "n_repeat_words": lambda t, w: let(w, _repeat_words),
}


@dataclass(frozen=True)
class Rule:
    """``fails`` maps a lookup of statistics to the rejecting condition."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The contract's base rules.
BASE_RULES = (
    Rule("too_short", lambda f: f("n_words") < 50),
    Rule("repetition", lambda f: f("n_repeat_words") * 100 > f("n_words") * 50),
)
#: Further rules of this operator.
MORE_RULES = (
    Rule("symbols", lambda f: f("n_symbols") * 5 > f("n_words")),
    Rule("shouting", lambda f: f("n_upper") * 2 > f("word_chars")),
    Rule("same_lines", lambda f: f("n_dup_lines") * 2 > f("n_lines")),
    Rule("word_length", lambda f: (f("word_chars") < f("n_words") * 2) | (f("word_chars") > f("n_words") * 100)),
)
RULES = BASE_RULES + MORE_RULES


def _inline(text: Column) -> Callable[[str], Column]:
    return lambda name: FEATURES[name](text, words(text))


def rejection(rules, lookup: Callable[[str], Column]) -> Column:
    """Name of the first rule in order that rejects, null if none does; later rules are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.fails(lookup), F.lit(r.name)) if out is None else out.when(r.fails(lookup), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def order_rules(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by estimated rejections per second, best first (ties by name).

    An empty sample keeps the given order.
    """
    sample = materialize(docs.select(text_of(text_col).alias("t")).limit(sample_rows), "quality-sample")
    n = sample.count()
    if not n:
        return list(rules)
    took, rejected = {}, {}
    for r in rules:
        cond = F.coalesce(r.fails(_inline(F.col("t"))), F.lit(False)).cast("int")
        began = time.perf_counter()
        rejected[r.name] = sample.agg(F.sum(cond)).first()[0] or 0
        took[r.name] = time.perf_counter() - began
    return sorted(rules, key=lambda r: (-rejected[r.name] / n / max(took[r.name], 1e-6), r.name))


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: id, the statistics, ``base_failed`` and ``kept``.

    Null, empty and blank texts have no words and fail.  Repeated rows are judged each for itself; an empty table
    gives no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_w", words(F.col("_t")))
    d = d.select("_id", *[f(F.col("_t"), F.col("_w")).alias(k) for k, f in FEATURES.items()])
    reason = rejection(order_rules(docs, text_col, rules), F.col)
    base = F.col("n_words") < 50
    base = base | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return d.select(F.col("_id").alias(id_col), *FEATURES, base.alias("base_failed"),
                    (~base & reason.isNull()).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they came; null and empty texts are rejected."""
    return docs.where(rejection(order_rules(docs, text_col, rules), _inline(text_of(text_col))).isNull())
