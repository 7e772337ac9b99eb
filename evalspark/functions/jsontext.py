"""JSON texts as VARIANT values, read strictly.

``try_parse_json`` reads the first value of a text and ignores what follows it.
:func:`json_value` accepts a text only if it is one JSON value and nothing else:
the text is parsed as the first element of an array whose second element is a
mark that the text cannot contain by itself, so a remainder of any kind either
breaks the array or moves the mark.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def json_value(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value; NULL for any other text."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))
    return let(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == F.md5(text), F.try_variant_get(v, "$[0]", "variant")))


def kind(value: Column) -> Column:
    """'object', 'array', 'string', 'number', 'boolean' or 'null' of a VARIANT; NULL for none."""
    return let(F.schema_of_variant(value), lambda t: (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
         .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")))


def member(value: Column, key: str) -> Column:
    """A field of an object, whatever signs its name has; NULL where it is missing."""
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def object_in(text: Column) -> Column:
    """The object that a model's reply is, or holds from its first to its last brace.

    The whole text counts if it is JSON at all, so a list or a number is no object
    even with braces inside.
    """
    start = F.instr(text, "{")
    size = F.length(text) - F.instr(F.reverse(text), "}") + 2 - start
    inner = let(F.substring(text, start, size), lambda t: F.when((start > 0) & (size > 1), json_value(t)))
    found = let(json_value(text), lambda whole: F.when(whole.isNotNull(), whole).otherwise(inner))
    return let(found, lambda v: F.when(kind(v) == "object", v))


def as_number(value: Column) -> Column:
    """A VARIANT as a double: numbers, booleans as 1 and 0, numeric strings; NULL for all else."""
    return let(kind(value), lambda k: F.when(k == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")).when(
        k.isin("number", "string"), F.try_variant_get(value, "$", "double")))


def is_true(value: Column) -> Column:
    """Truth of a VARIANT: zero, empty and null values are false."""
    return let(kind(value), lambda k: (
        F.when(k == "boolean", F.try_variant_get(value, "$", "boolean"))
         .when(k == "number", F.try_variant_get(value, "$", "double") != 0)
         .when(k == "null", F.lit(False))
         .otherwise(~F.to_json(value).isin('""', "[]", "{}"))))


def as_text(value: Column) -> Column:
    """A string VARIANT as it is, any other as JSON; NULL for null."""
    return let(kind(value), lambda k: F.when(k == "string", F.try_variant_get(value, "$", "string")).when(k != "null", F.to_json(value)))
