"""JSON text to events, as strictly as the services that write it expect.

A document is parsed once, into a variant, and taken apart into one variant per field, so the
kind of each value is still known: text fields must hold a string or null, payloads may hold
anything. Keys match case-sensitively, the last of duplicate keys counts, unknown keys are
ignored. Numbers in payloads keep their digits: `tag` is the `number_tag` of the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from trailspark.functions.numbers import is_tagged, tagged, untagged
from trailspark.functions.payload import is_single_document
from trailspark.functions.times import rfc3339_to_timestamp
from trailspark.schema import EVENT_COLUMNS, PAYLOADS, TEXT

# A client may send an id; it is checked like any text and then dropped.
_TEXT_FIELDS = ("id",) + TEXT + ("created_at",)
_EVENT = "struct<" + ", ".join(f"{c}: variant" for c in ("id",) + EVENT_COLUMNS) + ">"


def _document(body: Column, tag: Column) -> Column:
    """The variant of one JSON value, parsed once; keys are checked in the text as it came."""
    return F.when(is_single_document(body), F.try_parse_json(tagged(body, tag)))


def parse_event(body: Column, tag: Column) -> Column:
    """Struct of variants; NULL where the text is not one JSON object."""
    return as_event(_document(body, tag))


def parse_envelope(body: Column, tag: Column) -> Column:
    """Struct of the variant `events`; NULL where the text is not one JSON object."""
    return F.try_variant_get(_document(body, tag), "$", "struct<events: variant>")


def elements(events: Column) -> Column:
    """The elements of a JSON array, each a variant; NULL for anything else."""
    return F.try_variant_get(events, "$", "array<variant>")


def is_null(value: Column) -> Column:
    """True where a variant is absent or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_event(value: Column) -> Column:
    """Struct of variants from a JSON object; NULL for anything else."""
    return F.try_variant_get(value, "$", _EVENT)


def event_time(event: Column) -> Column:
    """`created_at` as a time; NULL where it is not given and where it is not RFC 3339."""
    return rfc3339_to_timestamp(_string(event["created_at"]))


def has_wrong_type(event: Column, time: Column, tag: Column) -> Column:
    """True when a text field holds something else or a given time is not one."""
    kinds = {c: F.coalesce(F.schema_of_variant(event[c]), F.lit("VOID")) for c in _TEXT_FIELDS}
    wrong = [~kind.isin("STRING", "VOID") for kind in kinds.values()]
    wrong += [is_tagged(_string(event[c]), tag) for c in _TEXT_FIELDS]
    return reduce(lambda a, b: a | b, wrong) | ((kinds["created_at"] != "VOID") & time.isNull())


def event_struct(event: Column, time: Column, tag: Column) -> Column:
    """The typed event; payloads as JSON text."""
    typed = {c: _string(event[c]) for c in TEXT}
    typed |= {c: untagged(F.to_json(event[c]), tag) for c in PAYLOADS}
    typed["created_at"] = time
    return F.struct(*(typed[c].alias(c) for c in EVENT_COLUMNS))


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")
