"""Records in JSON tool results, with the built-in VARIANT functions.

A result is read as JSON where it is JSON.  Otherwise the first array inside it that parses counts, else the first object;
brackets inside string literals do not count.  Nothing leaves the JVM and no row is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.operators.sparse import bind

RECORDS, RECORD = "array<variant>", "map<string,variant>"
SUMMARY = "struct<count: bigint, id_field: string, first_ids: array<string>, keys: array<string>, values: map<string,string>>"
#: A string literal, a bracket, a run of other characters, or a lone quote.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+|"'


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _enclosed(tokens: Column, opening: str, closing: str) -> Column:
    """The first balanced part between ``opening`` and ``closing`` that is JSON; later parts are read only where earlier ones fail."""

    def part(at: Column) -> Column:
        rest = F.slice(tokens, at + 1, F.size(tokens))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

        def step(a: Column, t: Column) -> Column:
            depth = a["depth"] + F.when(t == opening, 1).when(t == closing, -1).otherwise(0)
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), (depth == 0).alias("done")))

        return F.aggregate(rest, start, step, lambda a: F.when(a["done"], F.array_join(F.slice(rest, F.lit(1), a["n"]), "")))

    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i) == opening)
    tried = F.aggregate(places, F.lit(None).cast("string"), lambda a, i: F.when(a.isNotNull(), a).otherwise(
        bind(part(i), lambda text: F.when(_parses(text), text))))
    return F.when(F.size(tokens) > 0, tried)


def json_text(c) -> Column:
    """The JSON text of a result, or null."""

    def inside(text: Column) -> Column:
        return bind(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: F.coalesce(_enclosed(t, "[", "]"), _enclosed(t, "{", "}")))

    return bind(_column(c), lambda text: F.when(text.isNull(), None).when(_parses(text), text).otherwise(inside(text)))


def variant(c) -> Column:
    return F.try_parse_json(json_text(c))


def _text(v: Column) -> Column:
    """A value as text: strings bare, all else as JSON; null for a JSON null."""
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def _names(record: Column) -> Column:
    return F.map_keys(record)


def record_summary(c, first: int = 5, shown: int = 6, width: int = 40) -> Column:
    """Summary of a list of records (``count``, ``id_field``, the ``first`` ids, ``keys``) or of one record (``values`` in place
    of ids: the first ``shown`` keys with ``width`` characters); null where there is none.

    All records are read and all keys listed in order.  The id field is the first key that is ``id`` or ends in ``_id``; a
    record without it has a null id.
    """
    none = F.lit(None).cast(SUMMARY)

    def make(count, id_field, ids, keys, values) -> Column:
        return F.struct(count.cast("long").alias("count"), id_field.cast("string").alias("id_field"), ids.cast("array<string>").alias("first_ids"),
                        keys.alias("keys"), values.cast("map<string,string>").alias("values")).cast(SUMMARY)

    null = F.lit(None)

    def several(records: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.flatten(F.transform(records, _names))))
        return bind(keys, lambda ks: bind(F.get(F.filter(ks, lambda k: (k == "id") | k.endswith("_id")), F.lit(0)), lambda key: make(
            F.size(records), key, F.when(key.isNotNull(), F.transform(F.slice(records, 1, first), lambda r: _text(F.try_element_at(r, key)))), ks, null)))

    def single(record: Column) -> Column:
        value = lambda k: F.substring(_text(F.try_element_at(record, k)), 1, width)
        return bind(F.array_sort(_names(record)), lambda ks: make(
            F.lit(1), null, null, ks, F.map_from_entries(F.transform(F.slice(ks, 1, shown), lambda k: F.struct(k, value(k))))))

    def summary(v: Column) -> Column:
        listed = F.transform(F.try_variant_get(v, "$", RECORDS), lambda x: F.try_variant_get(x, "$", RECORD))
        return bind(listed, lambda rs: F.when((F.size(rs) > 0) & F.forall(rs, lambda r: r.isNotNull()), several(rs)).otherwise(
            bind(F.try_variant_get(v, "$", RECORD), lambda r: F.when(r.isNotNull(), single(r)).otherwise(none))))

    return bind(variant(c), lambda v: F.when(v.isNotNull(), summary(v)).otherwise(none))


def signature(c) -> Column:
    """``(a, b?)`` from a documentation record: parameter names, with a question mark where one is not required."""

    def show(ps: Column) -> Column:
        given = F.filter(F.transform(ps, lambda p: F.try_variant_get(p, "$", RECORD)), lambda p: p.isNotNull())
        need = lambda p: F.coalesce(F.try_variant_get(F.try_element_at(p, F.lit("required")), "$", "boolean"), F.lit(False))
        name = lambda p: F.coalesce(_text(F.try_element_at(p, F.lit("name"))), F.lit(""))
        return F.concat(F.lit("("), F.array_join(F.transform(given, lambda p: F.concat(name(p), F.when(need(p), "").otherwise("?"))), ", "), F.lit(")"))

    return bind(F.try_variant_get(variant(c), "$.parameters", RECORDS), lambda ps: F.when(ps.isNotNull(), show(ps)))


def listed_names(c) -> Column:
    """Names in a list of descriptions; from a text that is no JSON, what stands after ``"name":``."""
    records = lambda v: F.filter(F.transform(F.try_variant_get(v, "$", RECORDS), lambda x: F.try_variant_get(x, "$.name", "string")), lambda n: n.isNotNull())
    loose = F.regexp_extract_all(F.coalesce(_column(c), F.lit("")), F.lit(r'"name":\s*"([a-z_]+)"'), F.lit(1))
    empty = F.array().cast("array<string>")
    return bind(variant(c), lambda v: F.when(v.isNull(), loose).otherwise(F.coalesce(records(v), empty)))
