"""Newest-first time windows, so that a top-k reads only the recent part of the trail.

A page or a list of recent groups needs the newest rows that match, and the table is laid
out by time. The windows are disjoint and run backwards from the upper bound of the filter,
each several times longer than the one before; the caller stops once it has its rows. The
last window has no lower bound, so nothing is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from trailspark.functions.times import as_utc, floor_hour, minus
from trailspark.operators.filters import EventFilter, time_bounds

SPANS = tuple(timedelta(hours=h) for h in (1, 24, 24 * 8, 24 * 64, 24 * 512, 24 * 4096))


def newest_first(
    flt: EventFilter,
    newest: datetime | None = None,
    with_cursor: bool = True,
    spans: tuple[timedelta, ...] = SPANS,
) -> Iterator[tuple[datetime | None, datetime | None]]:
    """(lower inclusive, upper exclusive) windows; lower bounds fall on full hours.

    `newest` is the time the walk starts from when the filter has no upper bound; later
    events still belong to the first window, which is open above.
    """
    position = flt.cursor_position() if with_cursor else None
    ends = [as_utc(t) for t in (flt.until, position and position[0]) if t]
    start = floor_hour(min(ends) if ends else as_utc(newest or datetime.now(timezone.utc)))
    upper = None
    for span in spans:
        lower = minus(start, span)
        if lower is None or (flt.since is not None and lower <= as_utc(flt.since)):
            break
        yield lower, upper
        upper = lower
    yield None, upper


def in_window(events: DataFrame, window: tuple[datetime | None, datetime | None]) -> DataFrame:
    for bound in time_bounds(events.schema, window[0], window[1], upper_inclusive=False):
        events = events.filter(bound)
    return events
