"""The event table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from trailspark.schema import GROUP_SCHEMA, STATUS_COLUMN, TABLE_SCHEMA
from trailspark.sources.tables import read_or_empty


def read_events(spark: SparkSession, path: str, *, status_stored: bool = False) -> DataFrame:
    """Events as stored, with the physical columns the filters prune on.

    The schema is given, not inferred: files older than a column read NULL there, which every
    result shows as ''. Filters see the plain column and so still reach the scan.

    The status is read from the metadata, which is right for files of any age. Every file
    `append_events` writes has the status beside the metadata, and `compact_days` fills it in:
    for a table of such files only, say `status_stored=True`, and filters on the status reach
    the scan while roll-ups do without the metadata.
    """
    events = read_or_empty(spark, TABLE_SCHEMA, path)
    return events if status_stored else events.drop(STATUS_COLUMN)


def read_rollup(
    spark: SparkSession, path: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Group rows of the days asked for, as written, one part per batch.

    `merge_groups` makes the parts one.
    """
    partitions = [StructField("bucket_date", DateType()), StructField("batch", StringType())]
    parts = read_or_empty(spark, StructType(GROUP_SCHEMA.fields + partitions), path)
    if since is not None:
        parts = parts.filter(F.col("bucket_date") >= F.lit(since))
    if until is not None:
        parts = parts.filter(F.col("bucket_date") <= F.lit(until))
    return parts.select(*GROUP_SCHEMA.names)
