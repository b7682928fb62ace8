"""Masking of secrets as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Secret key names, the three masking rules, their version, and the form of a mask.
SECRET_KEYS = ("password", "passwd", "secret", "api_key", "apikey", "access_token", "auth_token", "token", "verification_code", "otp")
_KEY = "|".join(SECRET_KEYS)
PAIR_RULE = rf"""(\b["']?(?:{_KEY})["']?\s*:\s*["'])((?!<REDACTED:)[^"'\n]*)(["']|$)"""
ASSIGN_RULE = rf"""(\b\w*(?:{_KEY})\w*\s*=\s*["'])((?!<REDACTED:)[^"'\n]*)(["']|$)"""
JWT_RULE = r"\b(eyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{10,})+)\b"
RULES_VERSION = "2"
MASK_HEAD = "<REDACTED:"

#: Java flags: any case, every script's letters and spaces, ``$`` before a line feed only.
_PAIR, _ASSIGN, _JWT = f"(?iuUmd){PAIR_RULE}", f"(?iuUmd){ASSIGN_RULE}", f"(?U){JWT_RULE}"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _mask(value: Column, salt: str) -> Column:
    return F.concat(F.lit(MASK_HEAD), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 8), F.lit(">"))


def _mask_matches(c: Column, rule: str, secret: int, groups: int, salt: str) -> Column:
    """The text with group ``secret`` of every match masked: what stands between matches, interleaved with the matches."""
    part = lambda i: F.regexp_extract_all(c, F.lit(rule), F.lit(i))
    pieces = [F.transform(part(i), lambda m: _mask(m, salt)) if i == secret else part(i) for i in range(1, groups + 1)]
    masked = F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(pieces)]), lambda z: F.concat(*[z[f"g{i}"] for i in range(groups)]))
    text = F.array_join(F.flatten(F.zip_with(F.split(c, rule, -1), masked, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))), "")
    return F.when(c.rlike(rule), text).otherwise(c)


def masks(c) -> Column:
    """Number of masks in a text."""
    return F.regexp_count(_column(c), F.lit(MASK_HEAD)).cast("long")


def redact(c, salt: str = "") -> Column:
    """struct<text, n>: whole text masked by the three rules, each on the result of the one before, and the number of matches.

    Built-in functions only; null stays null with a null count.
    """
    found = lambda x, rule: F.regexp_count(x, F.lit(rule)).cast("long")
    none = F.lit(None).cast("struct<text:string,n:bigint>")
    out = _bind(_column(c), lambda t: F.when(t.isNull(), none).otherwise(
        _bind(_mask_matches(t, _PAIR, 2, 3, salt), lambda a: _bind(
            _mask_matches(a, _ASSIGN, 2, 3, salt), lambda b: F.struct(
                _mask_matches(b, _JWT, 1, 1, salt).alias("text"), (found(t, _PAIR) + found(a, _ASSIGN) + found(b, _JWT)).alias("n"))))))
    return F.struct(out["text"].alias("text"), out["n"].alias("n"))


def mask_value(c: Column, salt: str = "") -> Column:
    """Whole-value mask of a secret field; empty and already masked values stay."""
    return F.when(c.isNull() | (c == "") | c.startswith(MASK_HEAD), c).otherwise(_mask(c, salt))


def _walk(col: Column, dtype: T.DataType, salt: str, secret: Column | None = None) -> Column:
    """``col`` with all its texts masked; ``secret`` says whether the name above a text is a secret key."""
    if isinstance(dtype, T.StringType):
        text = redact(col, salt)["text"]
        return text if secret is None else F.when(secret, mask_value(col, salt)).otherwise(text)
    if isinstance(dtype, T.StructType):
        fields = [_walk(col[f.name], f.dataType, salt, F.lit(True) if f.name.lower() in SECRET_KEYS else None).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _walk(x, dtype.elementType, salt))
    if isinstance(dtype, T.MapType):
        named = lambda k: F.lower(k).isin(*SECRET_KEYS) if isinstance(dtype.keyType, T.StringType) else None
        return F.transform_values(col, lambda k, v: _walk(v, dtype.valueType, salt, named(k)))
    return col


def redact_columns(df: DataFrame, salt: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every text masked, whole documents included: texts in structs, arrays and maps; a field named like a secret is masked whole.

    Columns in ``keep`` (keys, error names) stay as they are.
    """
    walk = lambda f: _walk(F.col(f.name), f.dataType, salt, F.lit(True) if f.name.lower() in SECRET_KEYS else None)
    return df.select(*[(F.col(f.name) if f.name in keep else walk(f)).alias(f.name) for f in df.schema.fields])


def redact_documents(df: DataFrame, salt: str = "") -> DataFrame:
    """:func:`redact_columns` plus ``redaction``: the version of the rules and the number of masks this pass added."""
    plain = df.drop("redaction")
    before = masks(F.to_json(F.struct(*plain.columns)))
    d = redact_columns(plain.withColumn("_before", before), salt)
    added = masks(F.to_json(F.struct(*plain.columns))) - F.col("_before")
    return d.withColumn("redaction", F.struct(F.lit(RULES_VERSION).alias("rules_version"), added.alias("n_redactions"))).drop("_before")
