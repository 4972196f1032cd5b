"""Writing the event table.

Layout: `created_date=…/batch=…`. Days prune by partition and rows within a file run newest
first, so that row groups hold narrow times. Compacted files also carry Bloom filters for the
lookups by request, actor and target, whose values are spread over all times; in the small
files of micro-batches the filters would outweigh the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.functions.status import http_status
from trailspark.functions.times import as_utc, utc_date
from trailspark.schema import PARTITION_COLUMNS, STATUS_COLUMN, stored
from trailspark.sinks.layout import by_time
from trailspark.sources.events import read_events
from trailspark.sources.lookups import LOOKUP_COLUMNS

# Adaptive filters are as large as the values they hold need.
BLOOM_FILTERS = {"parquet.bloom.filter.adaptive.enabled": "true"} | {
    f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKUP_COLUMNS
}
COMPACTED = "compacted"


def append_events(events: DataFrame, path: str, batch: str, *, bulk: bool = False) -> None:
    """Append one batch of normalized events with ids; no rows write nothing.

    Writing the same batch again replaces it, so a retry after a lost acknowledgement leaves
    each event once. A micro-batch is written without a shuffle, each task the few days it
    holds. Say `bulk` for a large load whose tasks hold many days: it is laid out like
    compacted days.
    """
    physical = {STATUS_COLUMN: http_status(), "created_date": utc_date(F.col("created_at")), "batch": F.lit(batch)}
    rows = stored(events).withColumns(physical)
    if bulk:
        write_days(by_time(rows), path, BLOOM_FILTERS)
    else:
        write_days(rows.sortWithinPartitions(*PARTITION_COLUMNS, F.desc("created_at"), F.desc("id")), path)


def compact_days(
    spark: SparkSession,
    source: str,
    target: str,
    since: datetime | None = None,
    until: datetime | None = None,
) -> None:
    """Rewrite whole days of an append table into another table, replacing them there.

    The small files of the micro-batches become even ones. Every day `since` and `until`
    touch is rewritten whole.
    """
    events = read_events(spark, source, status_stored=True)
    if since is not None:
        events = events.filter(F.col("created_date") >= F.lit(as_utc(since).date()))
    if until is not None:
        events = events.filter(F.col("created_date") <= F.lit(as_utc(until).date()))
    status = F.coalesce(STATUS_COLUMN, http_status())
    write_days(by_time(events.withColumns({"batch": F.lit(COMPACTED), STATUS_COLUMN: status})), target, BLOOM_FILTERS)


def write_days(
    events: DataFrame, path: str, options: Mapping[str, str] | None = None,
    partitions: tuple[str, ...] = PARTITION_COLUMNS,
) -> None:
    """Rows as they lie in their tasks, replacing the folders they belong to."""
    (
        events.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(options or {}))
        .partitionBy(*partitions)
        .parquet(path)
    )
