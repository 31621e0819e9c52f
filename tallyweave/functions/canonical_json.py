"""Canonical JSON of any column, built from its type: keys in order, no blanks, nulls kept, strings unescaped but where JSON needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_CONTROLS = [(chr(c), _SHORT.get(chr(c), f"\\u{c:04x}")) for c in range(32)]


def _string(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for raw, code in _CONTROLS:
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def _double(c: Column) -> Column:
    """The shortest digits that Spark gives, plain from 1e-4 up to below 1e16, else with an exponent of two digits or more."""
    text = c.cast("double").cast("string")
    sign, size = F.when(F.startswith(text, F.lit("-")), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    mantissa, power = F.split_part(size, F.lit("E"), F.lit(1)), F.split_part(size, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=[0-9])0+$", "")  # one digit stands before the point
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    large = F.concat(F.substr(F.concat(digits, zeros(power + 1 - F.length(digits))), F.lit(1), power + 1), F.lit("."), F.coalesce(F.nullif(F.substr(digits, power + 2, F.lit(99)), F.lit("")), F.lit("0")))
    small = F.concat(F.lit("0."), zeros(-power - 1), digits)
    rest = F.substr(digits, F.lit(2), F.lit(99))
    apart = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    shown = F.when(power.isNull(), size).when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(apart)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("null")).otherwise(F.concat(sign, shown))


def _known(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        parts = [F.concat(_string(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical(e["value"], kind.valueType).alias("value"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double(c)
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return c.cast("string")
    if isinstance(kind, T.TimestampType):
        return _string(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    if isinstance(kind, T.BinaryType):
        return _string(F.base64(c))
    return _string(c.cast("string"))


def canonical(c: Column, kind: T.DataType) -> Column:
    """The canonical JSON text of a column of this type; null is the word null, as are NaN and the infinities.

    Keys are ordered by code point. Timestamps are shown in the session's zone with milliseconds.
    """
    return F.when(c.isNull(), F.lit("null")).otherwise(_known(c, kind))


def sealed(c: Column, kind: T.DataType) -> Column:
    """sha256, bytes and text of a column's canonical JSON."""
    text = canonical(c, kind)
    return F.struct(F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), text.alias("text"))
