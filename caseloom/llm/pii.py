"""Personal data: base patterns, and terms that give a protected value away.

Base spans are found by four patterns with checks.  The method then asks, over the whole corpus, how much a term tells
about a protected value (an e-mail address, a network address, ...): with document frequencies, a term t discloses a
value c when their pointwise mutual information reaches ``threshold`` times the information content of c, i.e. when
seeing t removes that share of the uncertainty about c.  Such terms are spans of kind ``term`` in the documents that
hold c.  Most values stand in one document, so c is also what a value has in common with others: its mail domain,
network, number prefix and kind.  P(c | t) is estimated from the other witnesses of t, with one count of prior weight at
the rate of c, so there is no least support, and one witness alone says nothing.  The co-occurrence must be beyond
chance: a log-likelihood ratio above ``min_evidence`` and above that of the best of as many random pairs as there are.
A witness is a class of near copies among the documents with values, so copies count once and a fixed phrase in
different texts counts in each; all counts are exact.

Built-in functions only; whole texts; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.llm.common import let, measured_side, running_total, text_of, total
from caseloom.session import materialize

# The contract's four patterns.  Possessive repeats and the guard in front keep the same leftmost matches but never
# retry inside a run that has already failed, so a long run of letters or digits costs linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM = r"[\p{L}\p{N}]+"
#: Passages in a text's sketch, those of them that look for near copies, and the similarity from which texts are copies.
SKETCH, KEYS, ALIKE = 24, 6, 0.5
#: Placeholder texts of :func:`redact`, by kind.
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _luhn(digits: Column) -> Column:
    def part(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2).cast("long")

    return total(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), part)) % 10 == 0


def _card_ok(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^0-9]", ""),
               lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone_ok(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)


#: (kind, pattern, cheap condition without which nothing can match, check of a match)
KINDS = (
    ("email", _EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    ("ip", _IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
    ("card", _CARD, lambda t: t.rlike("[0-9][\\x20-]?[0-9]"), _card_ok),
    ("phone", _PHONE, lambda t: t.rlike(r"\+[0-9]"), _phone_ok),
)
_SPANS = "array<struct<s:bigint,e:bigint,v:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs (s, e, v).

    The pieces between matches and the matches themselves give the positions as running sums of their lengths.
    """

    def located(m: Column, gap: Column) -> Column:
        step = F.transform(m, lambda x, i: (F.length(F.get(gap, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
                           .cast("long"))
        return let(running_total(step), lambda at: F.transform(m, lambda x, i: F.struct(
            F.get(at, i).alias("s"), (F.get(at, i) + F.length(x)).alias("e"), x.alias("v"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) > 0, let(F.split(text, pattern, -1), lambda gap: located(m, gap))).otherwise(F.array().cast(_SPANS)))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans by kind, each an array of (s, e, v)."""
    def of(pattern, may, ok) -> Column:
        return F.when(may(text), F.filter(matches(text, pattern), lambda x: ok(x["v"]))).otherwise(F.array().cast(_SPANS))

    return {k: of(*rule) for k, *rule in KINDS}


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


#: What a value shares with others, by kind: mail domain, networks of two and three bytes, issuer, country and area.
SHARED = {
    "email": (lambda v: F.regexp_extract(v, "@.*", 0),),
    "ip": (lambda v: F.concat(F.substring_index(v, ".", 2), F.lit(".*")), lambda v: F.concat(F.substring_index(v, ".", 3), F.lit(".*"))),
    "card": (lambda v: F.concat(F.substring(F.regexp_replace(v, "[^0-9]", ""), 1, 6), F.lit("*")),),
    "phone": (lambda v: F.concat(F.lit("+"), F.substring(F.regexp_replace(v, "[^0-9]", ""), 1, 5), F.lit("*")),),
}


def _values(kind: str, spans: Column) -> Column:
    """The values, and what they share with others, as names."""
    def names(x: Column) -> Column:
        v = F.lower(x["v"])
        return F.array(*[F.concat(F.lit(kind + ":"), n) for n in (v, *(f(v) for f in SHARED[kind]), F.lit("*"))])

    return F.flatten(F.transform(spans, names))


def _terms(text: Column) -> Column:
    """Lower-case terms of a text without its protected values."""
    clean = reduce(lambda t, k: F.when(k[2](t), F.regexp_replace(t, k[1], " ")).otherwise(t), KINDS, text)
    return F.array_remove(F.split(F.lower(clean), r"[^\p{L}\p{N}]+"), "")


def _sketch(terms: Column) -> Column:
    """The ``SKETCH`` smallest hashes of a text's three-word passages."""
    def passages(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(terms, lambda w: F.slice(F.array_sort(F.array_distinct(
        F.slice(passages(w), F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))))), 1, SKETCH))


def _alike(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the passages behind two sketches."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return let(both, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def witnesses(texts: DataFrame) -> DataFrame:
    """(text hash ``_x``, class ``_g``) of the texts that are near copies of a text with a smaller hash.

    Each of the ``KEYS`` smallest passages proposes the smallest text that shows it; a proposal counts where the sketches
    are alike by ``ALIKE``.  Links always lead to a smaller hash and are followed to their end.
    """
    keyed = texts.select("_x", "_s", F.explode(F.slice("_s", 1, KEYS)).alias("_k"))
    first = keyed.groupBy("_k").agg(F.min(F.struct("_x", "_s")).alias("_b"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    near = keyed.join(first, "_k").where((F.col("_b._x") < F.col("_x")) & (_alike(F.col("_s"), F.col("_b._s")) >= ALIKE))
    near = materialize(near.groupBy("_x").agg(F.min("_b._x").alias("_g")), "pii-copies")
    while True:
        up = near.select(F.col("_x").alias("_g"), F.col("_g").alias("_up"))
        step = materialize(near.join(up, "_g", "left").select("_x", F.coalesce("_up", "_g").alias("_g"), F.col("_up").isNotNull().alias("_moved")), "pii-copies")
        near = step.select("_x", "_g")
        if not step.where("_moved").limit(1).count():
            return near


def disclosing_terms(docs: DataFrame, threshold: float, min_evidence: float,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text hash, terms) of the documents in which a term gives a protected value away.

    Corpus counts cover all documents; those with values count by class of near copies, the others one by one.  Counts per
    value and term are aggregated on the map side, so a value held by a third of all documents is only a larger count.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).withColumn("_x", F.xxhash64("_t"))
    found = F.concat(*[_values(k, s) for k, s in base_spans(F.col("_t")).items()])
    held = d.where(F.col("_t").rlike("@|[0-9]")).withColumn("_vs", F.array_distinct(found)).where(F.size("_vs") > 0)
    seen = let(_terms(F.col("_t")), lambda w: F.struct(F.array_distinct(w).alias("ws"), _sketch(w).alias("s")))
    held = materialize(held.withColumn("_o", seen).select("_id", "_x", "_vs", F.col("_o.ws").alias("_ws"), F.col("_o.s").alias("_s")), "pii-held")
    copies = measured_side(witnesses(held.select("_x", "_s").dropDuplicates(["_x"])), "pii-witnesses", 16)
    held = held.drop("_s").join(copies, "_x", "left").withColumn("_g", F.coalesce("_g", "_x"))
    mine = held.select("_id", "_x", "_g", "_ws", F.explode("_vs").alias("_v"))
    values = mine.groupBy("_v", "_g").agg(F.count(F.lit(1)).alias("_c")).groupBy("_v").agg(F.count(F.lit(1)).alias("_nv"))
    values = measured_side(values.where(F.col("_nv") > 1), "pii-values", 96)  # one witness has no other
    mine = mine.join(values, "_v").select("_id", "_x", "_g", "_v", "_nv", F.explode("_ws").alias("_w"))
    pairs = mine.groupBy("_v", "_nv", "_w", "_g").agg(F.count(F.lit(1)).alias("_c")).groupBy("_v", "_nv", "_w").agg(
        F.count(F.lit(1)).alias("_cw"), F.sum("_c").alias("_held"))
    pairs = pairs.where(F.col("_cw") > 1)
    freq = materialize(d.select(F.explode(F.array_distinct(_terms(F.col("_t")))).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_nw"))
                       .where(F.col("_nw") > 1), "pii-frequencies")
    size = held.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_g").alias("classes")).first()
    n = max(d.count() - size["rows"] + size["classes"], 1)
    j = pairs.join(freq, "_w").withColumn("_nw", F.col("_nw") - F.col("_held") + F.col("_cw"))
    rate = F.col("_nv") / F.lit(float(n))
    pmi = F.log((F.col("_cw") - 1 + rate) / F.col("_nw") / rate)
    evidence = max(min_evidence, 2 * math.log(max(freq.count() * values.count(), 1)))
    content = F.log(F.lit(float(n)) / F.col("_nv"))

    def g(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    a, r, c = F.col("_cw").cast("double"), F.col("_nv").cast("double"), F.col("_nw").cast("double")
    b, e = r - a, c - a
    f = F.lit(float(n)) - r - c + a
    # two-by-two log-likelihood ratio
    llr = 2 * (g(a, r * c / n) + g(b, r * (n - c) / n) + g(e, (n - r) * c / n) + g(f, (n - r) * (n - c) / n))
    flagged = j.where((content > 0) & (pmi >= threshold * content) & (llr >= evidence)).select("_v", "_w")
    flagged = measured_side(flagged, "pii-flagged", 96)
    return mine.join(flagged, ["_v", "_w"]).groupBy("_id", "_x").agg(F.collect_set("_w").alias("_terms"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
               min_evidence: float = 30.0) -> DataFrame:
    """``docs`` with array columns ``_email``, ``_ip``, ``_card``, ``_phone`` and ``_term`` of (s, e, v).

    Null and empty texts have no spans; repeated rows get equal spans; every other column passes through.
    Terms are whole words outside base spans.
    """
    out = docs.withColumns({f"_{k}": s for k, s in base_spans(text_of(text_col)).items()})
    hits = disclosing_terms(docs, threshold, min_evidence, id_col, text_col)
    hits = measured_side(hits.withColumnsRenamed({"_id": "_hid", "_x": "_hx"}), "pii-hits", 4096)
    out = out.join(hits, (F.xxhash64(text_of(text_col)) == F.col("_hx")) & F.col(id_col).eqNullSafe(F.col("_hid")), "left")
    base = F.concat(*[F.col(f"_{k}") for k, *_ in KINDS])
    spans = F.filter(matches(text_of(text_col), _TERM), lambda x: F.array_contains(F.col("_terms"), F.lower(x["v"]))
                     & ~F.exists(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return out.withColumn("_term", F.when(F.col("_terms").isNull(), F.array().cast(_SPANS)).otherwise(spans)).drop(
        "_hid", "_hx", "_terms")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: id, counts by kind, ``base_sha256`` and ``spans`` (kind:start:end, comma-joined)."""
    d = find_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", **limits)
    kinds = [k for k, *_ in KINDS]
    base = F.concat(*[_named(k, F.col(f"_{k}")) for k in kinds])
    return d.select(F.col("_id").alias(id_col), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in kinds],
                    F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(base, _named("term", F.col("_term"))), ",").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with every span of the text replaced by the mask of its kind; null texts stay null.

    Overlapping spans become one mask, that of the first.  Other columns pass through.
    """
    own = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    d, t = find_spans(own, "_id", "_text", **limits), F.col("_text")
    def masked(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(MASK[kind]).alias("m")))

    marks = F.sort_array(F.concat(*map(masked, MASK)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring(t, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), x["m"])
        fresh = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(marks, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    some = reduce(lambda a, b: a | b, [F.size(f"_{k}") > 0 for k in MASK])
    text = F.when(some, done).otherwise(t)
    return d.select(*[(text if c == text_col else F.col("_doc")[c]).alias(c) for c in docs.columns])
