"""Hourly summaries of similar events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, functions as F

from trailspark.functions.category import DEFAULT_RULES, CategoryRules, category_column
from trailspark.functions.status import is_failure, is_success, status_column
from trailspark.functions.times import utc_date, utc_hour_start
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.listing import page_size
from trailspark.operators.windows import in_window, newest_first
from trailspark.schema import GROUP_KEYS, GROUP_MEASURES, text


def group_events(
    events: DataFrame, flt: EventFilter | None = None, rules: CategoryRules = DEFAULT_RULES
) -> DataFrame:
    """One row per hour and combination of category and the seven dimensions.

    `count` exceeds `success_count + failure_count` by the events without a status and with
    one below 200. All five measures combine before the shuffle, so a group that holds most
    of the rows costs one row per task.
    """
    matching = filter_events(events, flt, with_cursor=False, rules=rules)
    kind = events.schema["created_at"].dataType
    keyed = matching.select(
        utc_hour_start(F.col("created_at"), kind).alias("bucket_start"),
        category_column(rules=rules).alias("category"),
        *(text(c) for c in GROUP_KEYS[2:]),
        status_column(events.schema).alias("status"),
        "created_at",
    )
    return keyed.groupBy(*GROUP_KEYS).agg(
        F.count("*").alias("count"),
        F.count_if(is_success(F.col("status"))).alias("success_count"),
        F.count_if(is_failure(F.col("status"))).alias("failure_count"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


def merge_groups(partial: DataFrame) -> DataFrame:
    """Group rows of separate parts of the trail (the deltas of micro-batches) made one."""
    return partial.groupBy(*GROUP_KEYS).agg(
        *(F.sum(c).alias(c) for c in GROUP_MEASURES[:3]),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def _latest_first() -> list[Column]:
    """Latest group first; equal times in the order of the keys."""
    return [F.desc("last_seen"), *(F.asc(k) for k in GROUP_KEYS)]


def top_groups(
    events: DataFrame, flt: EventFilter | None = None, rules: CategoryRules = DEFAULT_RULES
) -> DataFrame:
    """The groups seen last, as one lazy pass; `fetch_groups` reads less of a large table."""
    flt = flt or EventFilter()
    return group_events(events, flt, rules).orderBy(*_latest_first()).limit(page_size(flt.limit))


def fetch_groups(
    events: DataFrame,
    flt: EventFilter | None = None,
    *,
    newest: datetime | None = None,
    rules: CategoryRules = DEFAULT_RULES,
) -> list[Row]:
    """The groups seen last (100 at most).

    A group lies within one hour and windows are cut on full hours, so the groups of a newer
    window all come before those of an older one.
    """
    flt = flt or EventFilter()
    size = page_size(flt.limit)
    groups: list[Row] = []
    for window in newest_first(flt, newest, with_cursor=False):
        latest = group_events(in_window(events, window), flt, rules).orderBy(*_latest_first())
        groups += latest.limit(size - len(groups)).collect()
        if len(groups) == size:
            break
    return groups


def spread_rollup(groups: DataFrame, batch: str) -> DataFrame:
    """Adds `bucket_date` and `batch`; rebalancing by day gives each day few files of even size,
    however uneven the days.
    """
    dated = groups.withColumn("bucket_date", utc_date(F.col("bucket_start"))).withColumn("batch", F.lit(batch))
    return dated.hint("rebalance", "bucket_date")


def write_rollup(groups: DataFrame, path: str, batch: str) -> None:
    """Group rows under `bucket_date`/`batch`; writing a batch again replaces it."""
    (
        spread_rollup(groups, batch)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket_date", "batch")
        .parquet(path)
    )


def bucket_histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts of a numeric column: one row per bound and one for `+Inf`.

    Every row also has the sum and the count of all values.
    """
    ordered = sorted(bounds)
    labels = [f"{b:g}" for b in ordered] + ["+Inf"]
    column = F.col(value)
    totals = df.agg(
        *(F.count_if(column <= b).alias(f"b{i}") for i, b in enumerate(ordered)),
        F.count(column).alias("n"),
        F.coalesce(F.sum(column), F.lit(0)).alias("total"),
    )
    counts = [F.col(f"b{i}") for i in range(len(ordered))] + [F.col("n")]
    buckets = F.array(
        *(F.struct(F.lit(le).alias("le"), c.alias("bucket_count")) for le, c in zip(labels, counts))
    )
    return totals.select(F.inline(buckets), F.col("n").alias("value_count"), F.col("total").alias("value_sum"))
