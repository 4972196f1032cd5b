"""Checks on JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def empty_to_null(payload: Column | str) -> Column:
    return F.nullif(F.col(payload) if isinstance(payload, str) else payload, F.lit(""))


def is_single_document(text: Column | str) -> Column:
    """True for text that is one JSON value with nothing after it.

    The lenient parsers stop at the end of the first value. Wrapped as an array element the
    text must come out as one element. Only text with a closing bracket can end that wrapper
    early; it must also come out as one member of an object, which the bracket breaks.
    """
    text = F.col(text) if isinstance(text, str) else text
    element = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    member = F.size(F.json_object_keys(F.concat(F.lit('{"p":'), text, F.lit("}"))))
    return F.coalesce((element == 1) & (~text.contains("]") | (member == 1)), F.lit(False))


def is_strict_json(text: Column | str) -> Column:
    """True for text a strict JSON parser accepts (duplicate keys allowed)."""
    text = F.col(text) if isinstance(text, str) else text
    return is_single_document(text) & F.try_parse_json(text).isNotNull()
