"""The event list: newest first, paged by cursor, or exported whole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from trailspark.functions.category import DEFAULT_RULES, CategoryRules, category_column
from trailspark.functions.cursor import encode_cursor, from_micros
from trailspark.functions.times import time_literal
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.windows import in_window, newest_first
from trailspark.schema import LIST_COLUMNS, TEXT, text

# Page sizes.
DEFAULT_PAGE = 50
LARGEST_PAGE = 100


def page_size(limit: int) -> int:
    """Sizes outside 1..100 give the default, not the nearest bound."""
    return limit if 1 <= limit <= LARGEST_PAGE else DEFAULT_PAGE


def _newest_first() -> list:
    return [F.desc("created_at"), F.desc("id")]


def list_columns(events: DataFrame, rules: CategoryRules = DEFAULT_RULES) -> DataFrame:
    """The 15 columns of the list, category computed, text defaults filled in."""
    return events.select(
        *(
            category_column(rules=rules).alias(c) if c == "category" else text(c) if c in TEXT else F.col(c)
            for c in LIST_COLUMNS
        )
    )


def list_events(
    events: DataFrame, flt: EventFilter | None = None, rules: CategoryRules = DEFAULT_RULES
) -> DataFrame:
    """One page and the row after it, which only says that more follow.

    One lazy pass, for use inside a larger query; `fetch_page` reads less of a large table.
    """
    flt = flt or EventFilter()
    matching = list_columns(filter_events(events, flt, rules=rules), rules)
    return matching.orderBy(*_newest_first()).limit(page_size(flt.limit) + 1)


@dataclass(frozen=True)
class Page:
    """At most 100 events, newest first, and the cursor of the next page if there is one."""

    events: list[Row]
    next_cursor: str | None
    schema: StructType

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, self.schema)


def fetch_page(
    events: DataFrame,
    flt: EventFilter | None = None,
    *,
    newest: datetime | None = None,
    strict_cursor: bool = False,
    rules: CategoryRules = DEFAULT_RULES,
) -> Page:
    """One page of the list.

    First the keys of the page, from the filter columns alone and from the newest windows
    alone; then the full rows of those keys (101 at most), read from their days and times only
    and under the same filter.
    """
    flt = flt or EventFilter()
    size = page_size(flt.limit)
    matching = filter_events(events, flt, strict_cursor=strict_cursor, rules=rules)
    micros = F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros")
    keys: list[Row] = []
    for window in newest_first(flt, newest):
        top = in_window(matching, window).select("created_at", "id").orderBy(*_newest_first())
        keys += top.limit(size + 1 - len(keys)).select(micros, "id").collect()
        if len(keys) > size:
            break
    schema = list_columns(events, rules).schema
    if not keys:
        return Page([], None, schema)

    more, keys = len(keys) > size, keys[:size]
    last = from_micros(keys[-1]["micros"])
    chosen = matching.filter(F.col("id").isin([k["id"] for k in keys]) & _at_times(events.schema, keys))
    rows = list_columns(chosen, rules).orderBy(*_newest_first()).limit(size).collect()
    return Page(rows, encode_cursor(last, keys[-1]["id"]) if more else None, schema)


def _at_times(schema: StructType, keys: list[Row]) -> Column:
    """Rows at the very times of the keys, and in their days: files are sorted by time."""
    times = sorted({from_micros(k["micros"]) for k in keys})
    kind = schema["created_at"].dataType
    found = F.col("created_at").isin([time_literal(t, kind) for t in times])
    if "created_date" in schema.names:
        found &= F.col("created_date").isin(sorted({t.date() for t in times}))
    return found


def walk_pages(
    events: DataFrame, flt: EventFilter | None = None, *, newest: datetime | None = None,
    rules: CategoryRules = DEFAULT_RULES,
) -> Iterator[Page]:
    """Pages until the cursor runs out; for a whole trail use `export_trail`."""
    flt = flt or EventFilter()
    while True:
        page = fetch_page(events, flt, newest=newest, rules=rules)
        yield page
        if page.next_cursor is None:
            return
        flt = replace(flt, cursor=page.next_cursor)


def export_trail(
    events: DataFrame, path: str, flt: EventFilter | None = None, rules: CategoryRules = DEFAULT_RULES
) -> None:
    """Every matching event in list order; the files of `path`, by name, are that order.

    The sort key ends in the id, so a moment that holds very many events still splits over
    tasks.
    """
    matching = list_columns(filter_events(events, flt, with_cursor=False, rules=rules), rules)
    matching.orderBy(*_newest_first()).write.mode("overwrite").parquet(path)
