"""The ingest stream: deliveries to the event table, bad ones set aside.

A micro-batch commits its offsets only after everything is written, so a failure replays it.
A replay carries the arrival time of the first attempt (the batch time in the offset log) and
the same coordinates, hence the same ids and the same partitions, which it replaces.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.functions.category import DEFAULT_RULES, CategoryRules
from trailspark.operators.delivery import (
    DECODE_ERROR,
    DEFAULT_MAX_REDELIVERIES,
    MAX_REDELIVERIES,
    decode_messages,
)
from trailspark.operators.groups import group_events, write_rollup
from trailspark.operators.normalize import assign_id, normalize
from trailspark.session import ensure_session
from trailspark.sinks.dead_letters import write_dead_letters
from trailspark.sinks.events import append_events
from trailspark.sinks.ledger import write_ledger
from trailspark.sinks.ranges import not_read_by_others, write_ranges
from trailspark.sources.messages import BLOCK, COORDINATES, number_lines


@dataclass(frozen=True)
class IngestTables:
    """Where a stream writes; the roll-up is optional.

    Streams that share `ranges` store each message once, though they read the same sources.
    """

    events: str
    dead_letters: str
    ledger: str
    rollup: str | None = None
    ranges: str | None = None


def with_arrival(deliveries: DataFrame) -> DataFrame:
    """Adds `arrived_at`; on a stream it is the batch time, the same in every replay."""
    return deliveries.withColumn("arrived_at", F.current_timestamp())


def batch_key(query: str, batch_id: int) -> str:
    """Names a batch in every table; batch numbers alone restart with a new checkpoint."""
    return f"{query}-{batch_id:012d}"


def write_batch(
    decoded: DataFrame,
    batch_id: int,
    tables: IngestTables,
    *,
    query: str,
    rules: CategoryRules = DEFAULT_RULES,
) -> None:
    """Write one micro-batch: events, dead letters, roll-up part, and last its ledger row.

    `decoded` is `decode_messages` of deliveries `with_arrival`. It feeds several writes and
    is kept for them; a lost executor's share is decoded again. Lines of text get their number
    in the file as their position.
    """
    batch = batch_key(query, batch_id)
    kept = decoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        decoded = number_lines(kept) if BLOCK in kept.columns else kept
        if tables.ranges:
            decoded = not_read_by_others(decoded, tables.ranges, query=query)
        reason = F.col("dead_reason")
        totals = decoded.agg(
            F.count("*").alias("read"),
            F.count_if(reason.isNull()).alias("written"),
            F.count_if(reason == MAX_REDELIVERIES).alias(MAX_REDELIVERIES),
            F.count_if(reason == DECODE_ERROR).alias(DECODE_ERROR),
            F.max("arrived_at").alias("arrived_at"),
        ).first()
        if totals["read"] == 0:
            return
        good = decoded.filter(reason.isNull()).select(*COORDINATES, "arrived_at", "event.*")
        events = assign_id(normalize(good, F.col("arrived_at")), F.lit(query), *COORDINATES)
        started = time.monotonic()
        append_events(events, tables.events, batch)
        write_seconds = time.monotonic() - started
        if totals["written"] < totals["read"]:
            write_dead_letters(decoded, tables.dead_letters, batch)
        if tables.rollup:
            write_rollup(group_events(events, rules=rules), tables.rollup, batch)
        if tables.ranges:
            write_ranges(decoded, tables.ranges, batch, query=query)
        write_ledger(
            decoded.sparkSession, tables.ledger, batch,
            query=query, batch_id=batch_id, totals=totals, write_seconds=write_seconds,
        )
    finally:
        kept.unpersist()


def start_ingest(
    deliveries: DataFrame,
    tables: IngestTables,
    checkpoint: str,
    *,
    query: str = "ingest",
    flush_interval: str = "2 seconds",
    available_now: bool = False,
    max_redeliveries: int = DEFAULT_MAX_REDELIVERIES,
    rules: CategoryRules = DEFAULT_RULES,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start the stream; with `available_now` it ends once what is there is read.

    How much one micro-batch takes is an option of the source. `after_batch` runs after the
    writes and before the offsets are committed; what it raises makes the batch replay.
    """
    ensure_session(deliveries.sparkSession)

    def write(df: DataFrame, batch_id: int) -> None:
        write_batch(df, batch_id, tables, query=query, rules=rules)
        if after_batch:
            after_batch(batch_id)

    decoded = decode_messages(with_arrival(deliveries), max_redeliveries)
    writer = decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": flush_interval}
    return writer.trigger(**trigger).start()
