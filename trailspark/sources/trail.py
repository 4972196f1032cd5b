"""One trail over landed and compacted rows, of events and of the roll-up.

Rows land in small files, a folder per day and batch, and are compacted later into a table of
even files, a folder per day and version. A commit says which version of a day counts and what
it covers of the landed batches: the batches of a stream have rising numbers, so the last one
covered says it for all before it, and a commit has a row per day and source, not per batch.

A reader takes the state of the last commit when it begins: the versions of that commit and
every landed batch that it does not cover. Batches that land later for a compacted day are not
covered and so belong to the trail at once. Both conditions are on partition columns, so folders
that do not count are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from trailspark.schema import GROUP_SCHEMA, STATUS_COLUMN, TABLE_SCHEMA
from trailspark.sources.lookups import files_with
from trailspark.sources.tables import read_or_empty

#: `source` is the stream or load a batch belongs to, `through` its last batch that is covered,
#: `rows` is how many rows the day's version has.
COMMIT_SCHEMA = "day date, source string, through string, version string, rows bigint, commit bigint"


@dataclass(frozen=True)
class Kind:
    """What a trail is of: its columns, partition columns included, and which of them is the day."""

    schema: StructType
    day: str


EVENTS = Kind(TABLE_SCHEMA, "created_date")
ROLLUP = Kind(
    StructType(GROUP_SCHEMA.fields + [StructField("bucket_date", DateType()), StructField("batch", StringType())]),
    "bucket_date",
)


@dataclass(frozen=True)
class TrailTables:
    """`landed` is what `append_events` or `write_rollup` writes; the others belong to compaction.

    The look-up index is of events only.
    """

    landed: str
    compacted: str
    commits: str
    lookups: str = ""
    kind: Kind = EVENTS


@dataclass(frozen=True)
class Snapshot:
    """The state of one commit: a row per compacted day and source. `commit` is 0 before the first."""

    commit: int
    rows: list[Row]

    def versions(self) -> dict[date, str]:
        return {r["day"]: r["version"] for r in self.rows}


def in_days(day: str, since: date | None, until: date | None) -> Column:
    found = F.lit(True)
    if since is not None:
        found &= F.col(day) >= F.lit(since)
    if until is not None:
        found &= F.col(day) <= F.lit(until)
    return found


def read_snapshot(
    spark: SparkSession, tables: TrailTables, since: date | None = None, until: date | None = None,
    as_of: int | None = None,
) -> Snapshot:
    """The last commit of each day, or the last one up to `as_of`.

    The driver gets a row per compacted day and source; the file listing of the same table is
    larger.
    """
    commits = read_or_empty(spark, COMMIT_SCHEMA, tables.commits)
    if as_of is not None:
        commits = commits.filter(F.col("commit") <= as_of)
    last = commits.agg(F.max("commit")).first()[0]
    if last is None:
        return Snapshot(0, [])
    commits = commits.filter((F.col("commit") <= last) & in_days("day", since, until))
    latest = commits.groupBy("day").agg(F.max("commit").alias("commit"))
    return Snapshot(last, commits.join(latest, ["day", "commit"]).collect())


def source_of(batch: Column) -> Column:
    """The stream of a numbered batch; any other batch is a source of its own."""
    return F.regexp_replace(batch, "-[0-9]{12}$", "")


def _by_day(day: str, values: dict[date, str]) -> Column:
    """The value of the day of a row, NULL for a day without one: a look-up by position."""
    first, last = min(values), max(values)
    days = ((first + timedelta(days=k)) for k in range((last - first).days + 1))
    listed = F.array(*(F.lit(values.get(d)).cast("string") for d in days))
    return F.get(listed, F.date_diff(F.col(day), F.lit(first)))


def is_covered(kind: Kind, snapshot: Snapshot) -> Column:
    """True for the landed folders whose events are in the compacted table."""
    through: dict[str, dict[date, str]] = {}
    for row in snapshot.rows:
        through.setdefault(row["source"], {})[row["day"]] = row["through"]
    covered = F.lit(False)
    for source, days in through.items():
        of_source = source_of(F.col("batch")) == source
        covered |= of_source & F.coalesce(F.col("batch") <= _by_day(kind.day, days), F.lit(False))
    return covered


def landed_rows(
    spark: SparkSession, tables: TrailTables, snapshot: Snapshot, since: date | None = None, until: date | None = None
) -> DataFrame:
    """Landed rows that the snapshot does not cover."""
    kind = tables.kind
    landed = read_or_empty(spark, kind.schema, tables.landed).filter(in_days(kind.day, since, until))
    return landed.filter(~is_covered(kind, snapshot)) if snapshot.rows else landed


def compacted_rows(spark: SparkSession, tables: TrailTables, snapshot: Snapshot) -> DataFrame:
    """Rows of the versions of the snapshot."""
    day, versions = tables.kind.day, snapshot.versions()
    rows = read_or_empty(spark, tables.kind.schema, tables.compacted)
    if not versions:
        return rows.filter("false")
    counts = in_days(day, min(versions), max(versions)) & (F.col("batch") == _by_day(day, versions))
    return rows.filter(F.coalesce(counts, F.lit(False)))


def read_trail(
    spark: SparkSession,
    tables: TrailTables,
    since: date | None = None,
    until: date | None = None,
    *,
    as_of: int | None = None,
    status_stored: bool = True,
    lookup: tuple[str, str] | None = None,
) -> DataFrame:
    """Every row of the days asked for, once; events as `read_events` gives them.

    Group rows of a roll-up are parts still: `merge_groups` makes them one.

    `lookup` names a column and a value: compacted files that the look-up index shows to be
    without the value are left out. The value is not filtered for; give it in the filter too.
    """
    snapshot = read_snapshot(spark, tables, since, until, as_of)
    compacted = compacted_rows(spark, tables, snapshot)
    if lookup is not None and snapshot.rows:
        paths = files_with(spark, tables.lookups, snapshot.versions(), *lookup)
        if paths is not None:
            compacted = _files(spark, tables.compacted, paths, compacted)
    rows = landed_rows(spark, tables, snapshot, since, until).unionByName(compacted)
    return rows if status_stored else rows.drop(STATUS_COLUMN)


def _files(spark: SparkSession, root: str, paths: list[str], like: DataFrame) -> DataFrame:
    if not paths:
        return like.filter("false")
    return spark.read.schema(like.schema).option("basePath", root).parquet(*paths)
