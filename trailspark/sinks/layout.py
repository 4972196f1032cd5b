"""Layouts of compacted days.

`by_time` sorts a day by time, which serves pages. `by_lookup` serves the other access paths as
well: scope, service, actor, target and time each get a rank, equally full by a sample, and
rows are sorted by the ranks with their bits interleaved, the highest bits first. Rows that are
near in any of the columns then tend to be near in the file, so that the least and greatest
values of row groups and pages rule out most of them whichever column is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.times import utc_clock
from trailspark.schema import PARTITION_COLUMNS, STATUS_COLUMN, STORED_COLUMNS

Layout = Callable[[DataFrame], DataFrame]

#: Bits of a rank, and rows looked at to make the ranks equally full. The sample decides where
#: rows lie, never which rows there are.
RANK_BITS = 6
SAMPLE_ROWS = 50_000
_CELL_BITS = 8


def _paths() -> dict[str, Column]:
    return {
        "scope": F.concat_ws("/", "scope_type", "scope_id"),
        "service": F.coalesce("service", F.lit("")),
        "actor": F.coalesce("actor", F.lit("")),
        "target": F.concat_ws("/", "target_type", "target_id"),
        "time": F.date_format(utc_clock(F.col("created_at")), "yyyyMMddHHmmss"),
    }


def by_time(events: DataFrame) -> DataFrame:
    """Rows by day and hour, in partitions of even size, newest first.

    Rebalancing splits an hour that holds a large part of the rows and merges thin ones, from
    the sizes seen in the shuffle; it needs no sampling pass over the rows.
    """
    spread = events.withColumn("_hour", F.hour(utc_clock(F.col("created_at")))).hint("rebalance", "created_date", "_hour")
    return _columns(spread.sortWithinPartitions(*PARTITION_COLUMNS, F.desc("created_at"), F.desc("id")))


def by_lookup(events: DataFrame) -> DataFrame:
    """Rows by day and place on the curve; equal places newest first."""
    placed = events.withColumn("_place", place(events))
    bits = RANK_BITS * len(_paths())
    cell = F.shiftright("_place", bits - _CELL_BITS)
    spread = placed.withColumn("_cell", cell).hint("rebalance", "created_date", "_cell")
    return _columns(spread.sortWithinPartitions(*PARTITION_COLUMNS, "_place", F.desc("created_at"), F.desc("id")))


def _columns(events: DataFrame) -> DataFrame:
    return events.select(*STORED_COLUMNS, STATUS_COLUMN, *PARTITION_COLUMNS)


def place(events: DataFrame) -> Column:
    """The interleaved ranks of a row."""
    paths = _paths()
    n = events.count()
    sample = events.select(*(c.alias(name) for name, c in paths.items()))
    if n > SAMPLE_ROWS:
        sample = sample.sample(SAMPLE_ROWS / n, seed=1)
    rows = sample.collect()
    ranks = [rank(column, bounds([r[name] for r in rows])) for name, column in paths.items()]
    return interleave(ranks)


def bounds(values: list[str], bits: int = RANK_BITS) -> list[str]:
    """At most 2^bits - 1 values that part the sorted values evenly; a frequent value is one rank."""
    ordered, parts = sorted(values), 1 << bits
    if not ordered:
        return []
    return sorted({ordered[len(ordered) * k // parts] for k in range(1, parts)})


def rank(value: Column, ordered: list[str]) -> Column:
    """How many bounds are at most the value, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < ordered[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(ordered))


def interleave(ranks: list[Column], bits: int = RANK_BITS) -> Column:
    """Bit k of every rank before bit k - 1 of any."""
    total = F.lit(0).cast("bigint")
    for k in range(bits):
        for j, value in enumerate(ranks):
            bit = F.shiftright(value.cast("bigint"), k).bitwiseAND(F.lit(1))
            total = total.bitwiseOR(F.shiftleft(bit, k * len(ranks) + len(ranks) - 1 - j))
    return total
