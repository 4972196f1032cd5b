"""Events, groups and pages as JSON text, fields without a value left out."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailspark.functions.payload import is_strict_json
from trailspark.functions.times import timestamp_to_rfc3339
from trailspark.operators.listing import LARGEST_PAGE
from trailspark.schema import EVENT_COLUMNS, GROUP_KEYS, GROUP_MEASURES, LIST_COLUMNS, PAYLOADS

# The JSON fields left out when empty.
OMITTED_WHEN_EMPTY = ("service", "category", "request_id", "client_ip")

_TIMES = ("created_at", "bucket_start", "first_seen", "last_seen")


def _json(columns: tuple[str, ...], omitted: tuple[str, ...], payloads: Callable[[str], Column]) -> Column:
    """One JSON object; payloads are put in as the text they are, so no digit of them changes."""

    def value(name: str) -> Column:
        if name in _TIMES:
            return timestamp_to_rfc3339(F.col(name))
        return F.nullif(F.col(name), F.lit("")) if name in omitted else F.col(name)

    members = []
    for opaque, run in groupby(columns, lambda c: c in PAYLOADS):
        if opaque:
            members += [F.concat(F.lit(f'"{c}":'), payloads(c)) for c in run]
        else:
            body = F.to_json(F.struct(*(value(c).alias(c) for c in run)))
            members.append(F.nullif(F.btrim(body, F.lit("{}")), F.lit("")))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _one_line(payload: str) -> Column:
    """JSON has line breaks between its tokens only."""
    return F.translate(F.col(payload), "\r\n", "  ")


def _checked(payload: str) -> Column:
    """A payload that is not JSON is left out."""
    return F.when(is_strict_json(payload), _one_line(payload))


def event_json(*, known_json: bool = False) -> Column:
    """A listed event as JSON; say `known_json` for events whose payloads were checked when written."""
    return _json(LIST_COLUMNS, OMITTED_WHEN_EMPTY, _one_line if known_json else _checked)


def group_json() -> Column:
    """A group as JSON; only the service is left out when empty."""
    return _json(GROUP_KEYS + GROUP_MEASURES, ("service",), _checked)


def message_json(*, known_json: bool = False) -> Column:
    """An event as the body of a queue message; say `known_json` for payloads just decoded."""
    return _json(EVENT_COLUMNS, OMITTED_WHEN_EMPTY, _one_line if known_json else _checked)


def encode_messages(events: DataFrame, *, known_json: bool = False) -> DataFrame:
    """Events to queue messages: one `value` per event, the column name of the sinks."""
    return events.select(message_json(known_json=known_json).alias("value"))


def page_json(events: DataFrame, next_cursor: str | None, *, known_json: bool = False) -> DataFrame:
    """A page (100 rows at most, in order) as one JSON document; no events give null."""
    newest = [F.desc("created_at"), F.desc("id")]
    return _document(events, "events", event_json(known_json=known_json), newest, next_cursor)


def groups_json(groups: DataFrame) -> DataFrame:
    """A list of groups (100 rows at most) as one JSON document."""
    latest = [F.desc("last_seen"), *(F.asc(k) for k in GROUP_KEYS)]
    return _document(groups, "groups", group_json(), latest, None)


def _document(rows: DataFrame, name: str, body: Column, order: list[Column], cursor: str | None) -> DataFrame:
    """The first rows in order, a page at most, collected in that order."""
    n = F.row_number().over(Window.orderBy(*order))
    page = rows.orderBy(*order).limit(LARGEST_PAGE)
    listed = page.select(n.alias("n"), body.alias("body")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda e: e["body"]), ","
        ).alias("items")
    )
    items = F.when(F.col("items") == "", F.lit("null")).otherwise(
        F.concat(F.lit("["), F.col("items"), F.lit("]"))
    )
    tail = F.lit(f',"next_cursor":"{cursor}"}}' if cursor else "}")
    return listed.select(F.concat(F.lit(f'{{"{name}":'), items, tail).alias("json"))
