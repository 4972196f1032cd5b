"""Event ids that a replay gives again."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_id(*coordinates: Column | str) -> Column:
    """UUID text (version 8, custom) from the coordinates of an event in its source.

    Coordinates say where the event came from (topic, partition, offset; or file and row),
    not what it holds, so two honest identical events keep two ids. Each is written with
    its length so that no two lists of coordinates read the same.
    """
    parts = []
    for coordinate in coordinates:
        value = F.col(coordinate) if isinstance(coordinate, str) else coordinate
        value = value.cast("string")
        parts += [F.length(value).cast("string"), F.lit(":"), value, F.lit(";")]
    digest = F.sha2(F.concat(*parts), 256)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-8"),
        F.substring(digest, 14, 3), F.lit("-8"),
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
