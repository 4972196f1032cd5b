"""The one record type of the trail, and the columns derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# The names of the fields of events and groups, in the order of the result.

#: Text an event cannot be admitted without, in the order it is checked.
REQUIRED_TEXT = ("actor", "action", "target_type", "scope_type")
#: Text that may be missing on input and then reads ''.
OPTIONAL_TEXT = ("service", "target_id", "scope_id", "request_id", "client_ip")
TEXT = REQUIRED_TEXT + OPTIONAL_TEXT
#: Opaque JSON documents, kept as JSON text.
PAYLOADS = ("before_state", "after_state", "metadata")

#: Event columns as a client sends them; `id` is always assigned on our side.
EVENT_COLUMNS = (
    "service", "actor", "action", "target_type", "target_id", "scope_type", "scope_id",
    "before_state", "after_state", "metadata", "request_id", "client_ip", "created_at",
)
STORED_COLUMNS = ("id",) + EVENT_COLUMNS
#: The listing: stored columns with the category after the service.
LIST_COLUMNS = ("id", "service", "category") + EVENT_COLUMNS[1:]

GROUP_KEYS = (
    "bucket_start", "category", "service", "actor", "action",
    "target_type", "target_id", "scope_type", "scope_id",
)
GROUP_MEASURES = ("count", "success_count", "failure_count", "first_seen", "last_seen")

#: Physical columns of the event table, in no result: the status as the metadata hold it,
#: so that status filters and summaries need not read the payload, and the partition columns.
STATUS_COLUMN = "http_status"
PARTITION_COLUMNS = ("created_date", "batch")


def _field(name: str) -> StructField:
    return StructField(name, TimestampType() if name == "created_at" else StringType())


EVENT_STRUCT = StructType([_field(c) for c in EVENT_COLUMNS])
STORED_SCHEMA = StructType([_field(c) for c in STORED_COLUMNS])
TABLE_SCHEMA = StructType(
    STORED_SCHEMA.fields
    + [StructField(STATUS_COLUMN, IntegerType())]
    + [StructField("created_date", DateType()), StructField("batch", StringType())]
)
GROUP_SCHEMA = StructType(
    [StructField("bucket_start", TimestampType())]
    + [StructField(c, StringType()) for c in GROUP_KEYS[1:]]
    + [StructField(c, LongType()) for c in GROUP_MEASURES[:3]]
    + [StructField(c, TimestampType()) for c in GROUP_MEASURES[3:]]
)

#: A queue delivery: the body plus what the broker knows about earlier attempts.
#: `x_death` is NULL when the header is absent.
DELIVERY_SCHEMA = StructType(
    [
        StructField("body", StringType()),
        StructField("x_death", ArrayType(StructType([StructField("count", LongType())]))),
        StructField("redelivered", BooleanType()),
    ]
)


def text(name: str) -> Column:
    """A text column with its '' default, also for rows older than the column."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def stored(df: DataFrame) -> DataFrame:
    """The 14 stored columns, defaults filled in."""
    return df.select(*(text(c) if c in TEXT else F.col(c) for c in STORED_COLUMNS))
