"""Events as the table wants them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.identity import event_id
from trailspark.functions.payload import empty_to_null
from trailspark.functions.times import ZERO_TIME, time_literal
from trailspark.schema import EVENT_COLUMNS, PAYLOADS, STORED_COLUMNS, TEXT, text


def normalize(events: DataFrame, arrival: Column) -> DataFrame:
    """Missing text reads '', empty payloads are NULL, an unset time is the arrival time.

    Other columns (coordinates, reasons) pass through.
    """
    zero = time_literal(ZERO_TIME, events.schema["created_at"].dataType)
    created_at = F.col("created_at")
    return events.withColumns(
        {c: text(c) for c in TEXT}
        | {c: empty_to_null(c) for c in PAYLOADS}
        | {"created_at": F.coalesce(F.when(created_at != zero, created_at), arrival)}
    )


def map_wire(records: DataFrame, arrival: Column) -> DataFrame:
    """Wire records to event columns, in place.

    Wire text has no NULL of its own, payloads are bytes holding JSON, and the time, named
    `timestamp`, may be absent. Check the result with `reject_reason`; other columns pass
    through.
    """
    others = [c for c in records.columns if c not in EVENT_COLUMNS and c != "timestamp"]
    return records.select(
        *others,
        *(text(c) for c in TEXT),
        *(F.col(c).cast("string").alias(c) for c in PAYLOADS),
        F.coalesce("timestamp", arrival).alias("created_at"),
    ).select(*others, *EVENT_COLUMNS)


def assign_id(events: DataFrame, *coordinates: str) -> DataFrame:
    """Stored columns, the id derived from the coordinates of each event in its source."""
    return events.withColumn("id", event_id(*coordinates)).select(*STORED_COLUMNS)
