"""Compacting what has landed into a trail, one commit at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from trailspark.functions.status import http_status
from trailspark.operators.groups import merge_groups, spread_rollup
from trailspark.schema import GROUP_SCHEMA, STATUS_COLUMN
from trailspark.sinks.events import BLOOM_FILTERS, write_days
from trailspark.sinks.layout import Layout, by_time
from trailspark.sinks.lookups import write_lookups
from trailspark.sources.events import read_events
from trailspark.sources.tables import read_or_empty
from trailspark.sources.trail import (
    COMMIT_SCHEMA,
    Snapshot,
    TrailTables,
    compacted_rows,
    is_covered,
    landed_rows,
    read_snapshot,
    source_of,
)


def compact_trail(
    spark: SparkSession,
    tables: TrailTables,
    since: date | None = None,
    until: date | None = None,
    *,
    layout: Layout = by_time,
    growth: float = 0.0,
) -> int | None:
    """Take the events that landed for these days into a new version of each; the number of the commit.

    None if there is nothing to take in. `growth` leaves a day for later until what has landed
    is that share of its version: with 1.0 versions double, so that a row is written again a
    logarithmic number of times however often this runs.
    """

    def write(rows: DataFrame, version: str) -> None:
        status = F.coalesce(STATUS_COLUMN, http_status())
        write_days(layout(rows.withColumns({"batch": F.lit(version), STATUS_COLUMN: status})), tables.compacted, BLOOM_FILTERS)
        write_lookups(read_events(spark, tables.compacted).filter(F.col("batch") == version), tables.lookups, version)

    return _compact(spark, tables, since, until, growth, write)


def compact_rollup(
    spark: SparkSession, tables: TrailTables, since: date | None = None, until: date | None = None, *, growth: float = 0.0
) -> int | None:
    """The same for the parts of the roll-up, which a version holds merged: a group of a day once."""

    def write(rows: DataFrame, version: str) -> None:
        merged = spread_rollup(merge_groups(rows.select(*GROUP_SCHEMA.names)), version)
        write_days(merged, tables.compacted, partitions=("bucket_date", "batch"))

    return _compact(spark, tables, since, until, growth, write)


def _compact(
    spark: SparkSession, tables: TrailTables, since: date | None, until: date | None, growth: float,
    write: Callable[[DataFrame, str], None],
) -> int | None:
    """A day's new version is its old one and the batches that landed since.

    Files and index are written first and nobody sees them before the commit; what a compaction
    that failed left is never read. The commit is one small file, and a number is taken once: of
    two compactions at a time the second fails and can run again.
    """
    day, snapshot = tables.kind.day, read_snapshot(spark, tables)
    # one listing of the landed files serves the rows and the commit, so they agree
    landed = landed_rows(spark, tables, snapshot, since, until)
    parts = landed.groupBy(F.col(day).alias("day"), source_of(F.col("batch")).alias("source"))
    found = parts.agg(F.max("batch").alias("through"), F.count("*").alias("n")).collect()
    arrived: dict[date, int] = {}
    for row in found:
        arrived[row["day"]] = arrived.get(row["day"], 0) + row["n"]
    held = {r["day"]: r["rows"] for r in snapshot.rows}
    days = sorted(d for d, n in arrived.items() if n >= growth * held.get(d, 0))
    if not days:
        return None
    number = snapshot.commit + 1
    version = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    before = Snapshot(snapshot.commit, [r for r in snapshot.rows if r["day"] in set(days)])
    write(landed.filter(F.col(day).isin(days)).unionByName(compacted_rows(spark, tables, before)), version)
    _commit(spark, tables, number, version, before, [r for r in found if r["day"] in set(days)])
    return number


def _commit(
    spark: SparkSession, tables: TrailTables, number: int, version: str, before: Snapshot, taken: list[Row]
) -> None:
    """The whole state of each day of the commit, so that a day's last commit says all of it."""
    state = {(r["day"], r["source"]): r["through"] for r in (*before.rows, *taken)}
    written = read_or_empty(spark, tables.kind.schema, tables.compacted).filter(F.col("batch") == version)
    counts = {r[0]: r[1] for r in written.groupBy(tables.kind.day).count().collect()}
    rows = [(day, source, last, version, counts.get(day, 0), number) for (day, source), last in state.items()]
    commit = spark.createDataFrame(rows, COMMIT_SCHEMA).drop("commit").coalesce(1)
    commit.write.mode("errorifexists").parquet(f"{tables.commits}/commit={number}")


def superseded(spark: SparkSession, tables: TrailTables, keep: int = 1) -> list[str]:
    """Folders that no commit from the last but `keep` on reads: landed batches and old versions.

    Readers that began before those commits still need them; remove them when none is left.
    """
    last = read_snapshot(spark, tables).commit
    if last <= keep:
        return []
    kept = [read_snapshot(spark, tables, as_of=n) for n in range(last - keep, last + 1)]
    landed = read_or_empty(spark, tables.kind.schema, tables.landed)
    found = _folders(landed.filter(is_covered(tables.kind, kept[0])), tables, tables.landed)
    live = [f"{r['day']}/{r['version']}" for snapshot in kept for r in snapshot.rows]
    listed = F.concat_ws("/", F.col(tables.kind.day).cast("string"), "batch")
    # a version above the last commit's may belong to a compaction that is at work
    old = read_or_empty(spark, tables.kind.schema, tables.compacted).filter(
        ~listed.isin(live) & (F.col("batch") < f"v{last:08d}")
    )
    return found + _folders(old, tables, tables.compacted)


def _folders(rows: DataFrame, tables: TrailTables, root: str) -> list[str]:
    day = tables.kind.day
    found = rows.select(F.col(day).alias("day"), "batch").distinct().collect()
    return sorted(f"{root}/{day}={r['day']}/batch={r['batch']}" for r in found)


def remove_superseded(spark: SparkSession, tables: TrailTables, keep: int = 1) -> list[str]:
    """Delete those folders; the list of them."""
    folders = superseded(spark, tables, keep)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return folders
