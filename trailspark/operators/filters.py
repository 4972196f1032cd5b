"""The event filter: parameters to one conjunctive predicate."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from trailspark.functions.category import DEFAULT_RULES, CategoryRules, category_column, implied_service
from trailspark.functions.cursor import decode_cursor
from trailspark.functions.status import in_range, status_column
from trailspark.functions.times import as_utc, parse_rfc3339, time_literal
from trailspark.functions.values import WHITE_SPACE, clean_values
from trailspark.schema import OPTIONAL_TEXT

#: Columns a filter compares for equality, besides the category.
EQUALITY_COLUMNS = (
    "service", "scope_type", "scope_id", "actor", "action", "target_type", "target_id", "request_id",
)


@dataclass(frozen=True)
class EventFilter:
    scope_type: str = ""
    scope_id: str = ""
    service: str = ""
    actor: str = ""
    action: str = ""
    category: str = ""
    target_type: str = ""
    target_id: str = ""
    request_id: str = ""
    exclude_categories: Sequence[str] = ()
    exclude_services: Sequence[str] = ()
    exclude_actions: Sequence[str] = ()
    status_min: int = 0
    status_max: int = 0
    since: datetime | None = None
    until: datetime | None = None
    cursor: str = ""
    limit: int = 0

    @classmethod
    def from_params(cls, params: Mapping[str, Sequence[str]]) -> EventFilter:
        """Filter from query parameters; numbers and times that do not parse are left out."""

        def first(name: str) -> str:
            values = params.get(name, ())
            return values[0] if values else ""

        def listed(name: str, plural: str) -> tuple[str, ...]:
            return tuple(v for key in (name, name + "[]", plural) for v in params.get(key, ()))

        return cls(
            **{name: first(name) for name in EQUALITY_COLUMNS},
            category=first("category"),
            cursor=first("cursor"),
            exclude_categories=listed("exclude_category", "exclude_categories"),
            exclude_services=listed("exclude_service", "exclude_services"),
            exclude_actions=listed("exclude_action", "exclude_actions"),
            status_min=_integer(first("status_min")),
            status_max=_integer(first("status_max")),
            limit=_integer(first("limit")),
            since=parse_rfc3339(first("since")),
            until=parse_rfc3339(first("until")),
        )

    def cursor_position(self, strict: bool = False) -> tuple[datetime, str] | None:
        """Where the page starts; None for the first page, and for a bad cursor unless strict."""
        if not self.cursor:
            return None
        try:
            return decode_cursor(self.cursor)
        except ValueError:
            if strict:
                raise
            return None


def _integer(value: str) -> int:
    number = re.fullmatch(r"([+-]?)0*([0-9]{1,19})", value, flags=re.ASCII)
    if number and -(2**63) <= int(number[1] + number[2]) < 2**63:
        return int(number[1] + number[2])
    return 0


def time_bounds(
    schema: StructType,
    lower: datetime | None = None,
    upper: datetime | None = None,
    upper_inclusive: bool = True,
) -> list[Column]:
    """Bounds on `created_at`, each with the bound on the partition date it implies."""
    created_at = F.col("created_at")
    kind = schema["created_at"].dataType
    dated = "created_date" in schema.names
    parts = []
    if lower is not None:
        parts.append(created_at >= time_literal(lower, kind))
        if dated:
            parts.append(F.col("created_date") >= F.lit(as_utc(lower).date()))
    if upper is not None:
        limit = time_literal(upper, kind)
        parts.append(created_at <= limit if upper_inclusive else created_at < limit)
        if dated:
            parts.append(F.col("created_date") <= F.lit(as_utc(upper).date()))
    return parts


def _equal(column: Column, value: str) -> list[Column]:
    value = value.strip(WHITE_SPACE)
    return [column == value] if value else []


def _not_in(column: Column, values: Iterable[str], nullable: bool) -> list[Column]:
    cleaned = clean_values(values)
    if not cleaned:
        return []
    outside = ~column.isin(cleaned)
    # a row older than the column reads '' and '' is never listed
    return [outside | column.isNull() if nullable else outside]


def build_predicate(
    flt: EventFilter,
    schema: StructType,
    *,
    with_cursor: bool = True,
    strict_cursor: bool = False,
    rules: CategoryRules = DEFAULT_RULES,
) -> Column:
    """Conjunction of everything the filter asks for, on the columns as stored.

    Plain column comparisons reach the Parquet scan; the bounds a cursor or a category
    implies are added because the optimizer does not derive them from an OR or a CASE.
    """
    parts: list[Column] = []
    for name in EQUALITY_COLUMNS:
        parts += _equal(F.col(name), getattr(flt, name))
    if flt.category or flt.exclude_categories:
        category = category_column(rules=rules)
        parts += _equal(category, flt.category)
        parts += _not_in(category, flt.exclude_categories, nullable=False)
    implied = implied_service(flt.category.strip(WHITE_SPACE), F.col("service"), rules)
    if implied is not None:
        parts.append(implied)
    parts += _not_in(F.col("service"), flt.exclude_services, nullable="service" in OPTIONAL_TEXT)
    parts += _not_in(F.col("action"), flt.exclude_actions, nullable=False)
    status = in_range(status_column(schema), flt.status_min, flt.status_max)
    if status is not None:
        parts.append(status)
    parts += time_bounds(schema, flt.since, flt.until)
    position = flt.cursor_position(strict_cursor) if with_cursor else None
    if position is not None:
        at = time_literal(position[0], schema["created_at"].dataType)
        created_at = F.col("created_at")
        parts += time_bounds(schema, upper=position[0])
        parts.append((created_at < at) | ((created_at == at) & (F.col("id") < position[1])))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_events(
    events: DataFrame,
    flt: EventFilter | None = None,
    *,
    with_cursor: bool = True,
    strict_cursor: bool = False,
    rules: CategoryRules = DEFAULT_RULES,
) -> DataFrame:
    """The events that match; columns as stored, partition columns kept."""
    return events.filter(
        build_predicate(
            flt or EventFilter(), events.schema,
            with_cursor=with_cursor, strict_cursor=strict_cursor, rules=rules,
        )
    )
