"""Pages, exports and groups over the event table."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.plans import plan, scan_part
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.groups import (
    bucket_histogram,
    fetch_groups,
    group_events,
    merge_groups,
    top_groups,
    write_rollup,
)
from trailspark.operators.listing import export_trail, fetch_page, list_columns, list_events, walk_pages
from trailspark.operators.render import group_json, groups_json, page_json
from trailspark.operators.windows import newest_first
from trailspark.schema import GROUP_KEYS, GROUP_SCHEMA
from trailspark.sources.events import read_rollup

NEWEST = datetime(2024, 1, 31, tzinfo=timezone.utc)
FILTERS = [
    EventFilter(category="security_change", limit=20),
    EventFilter(actor="user-1", status_min=400, limit=33),
    EventFilter(since=datetime(2024, 1, 10, 3, 20, tzinfo=timezone.utc),
                until=datetime(2024, 1, 12, tzinfo=timezone.utc), limit=7),
    EventFilter(actor="nobody"),
]


def ordered(events, flt):
    rows = list_columns(filter_events(events, flt, with_cursor=False))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).collect()


@pytest.mark.parametrize("flt", FILTERS)
def test_page_walk_is_the_ordered_trail(table, flt):
    wanted = ordered(table, flt)
    pages = list(walk_pages(table, flt, newest=NEWEST))
    assert [r for p in pages for r in p.events] == wanted
    assert all(len(p.events) == flt.limit for p in pages[:-1])
    assert pages[-1].next_cursor is None


def test_ties_are_ordered_by_id(table):
    tied = table.withColumn("created_at", F.date_trunc("day", "created_at"))
    flt = EventFilter(category="security_change", limit=90)
    rows = ordered(tied, flt)
    assert len({r["created_at"] for r in rows}) < len(rows) / 3
    assert [r for p in walk_pages(tied, flt, newest=NEWEST) for r in p.events] == rows


@pytest.mark.parametrize("flt", FILTERS)
def test_fetched_page_is_the_lazy_page(table, flt):
    lazy = list_events(table, flt).collect()
    page = fetch_page(table, flt, newest=NEWEST)
    size = flt.limit or 50
    assert page.events == lazy[:size]
    assert (page.next_cursor is not None) == (len(lazy) > size)


def test_events_later_than_the_start_of_the_walk_are_found(table):
    start = datetime(2024, 1, 5, tzinfo=timezone.utc)
    flt = EventFilter(limit=40)
    assert fetch_page(table, flt, newest=start).events == fetch_page(table, flt, newest=NEWEST).events
    assert fetch_page(table, flt).events == fetch_page(table, flt, newest=NEWEST).events


def test_a_page_of_the_last_size_has_no_cursor(table):
    n = filter_events(table, EventFilter(actor="user-1", category="router_access")).count()
    assert 1 <= n <= 100
    page = fetch_page(table, EventFilter(actor="user-1", category="router_access", limit=n))
    assert len(page.events) == n and page.next_cursor is None


def test_windows_are_disjoint_and_complete():
    until = datetime(2024, 1, 20, 18, 30, tzinfo=timezone.utc)
    for flt in (EventFilter(), EventFilter(until=until), EventFilter(until=until, since=until - timedelta(days=3))):
        windows = list(newest_first(flt))
        assert windows[0][1] is None and windows[-1][0] is None
        assert [lower for lower, _ in windows[:-1]] == [upper for _, upper in windows[1:]]
        lowers = [lower for lower, _ in windows[:-1]]
        assert lowers == sorted(lowers, reverse=True)
        assert all((t.minute, t.second, t.microsecond) == (0, 0, 0) for t in lowers)
    assert len(list(newest_first(EventFilter(until=until, since=until - timedelta(days=3))))) == 3


def test_windows_prune_days(table):
    from trailspark.operators.windows import in_window

    window = next(newest_first(EventFilter(), NEWEST))
    assert "created_date" in scan_part(in_window(table, window), "PartitionFilters")


def test_the_list_takes_the_top_without_a_full_sort(table):
    text = plan(list_events(table, FILTERS[0]))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_export_files_are_in_list_order(spark, table, tmp_path):
    flt = EventFilter(exclude_categories=["system"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export_trail(table, str(tmp_path / "out"), flt)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    assert len(files) > 1
    rows = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert rows == ordered(table, flt)


@pytest.mark.parametrize("flt", FILTERS[:3])
def test_fetched_groups_are_the_top_groups(table, flt):
    assert fetch_groups(table, flt, newest=NEWEST) == top_groups(table, flt).collect()


def test_group_counts_add_up(table):
    for flt in FILTERS[:3]:
        groups = group_events(table, flt)
        total = groups.agg(F.sum("count").alias("n"), F.sum("success_count").alias("s"), F.sum("failure_count").alias("f")).first()
        assert total["n"] == filter_events(table, flt).count()
        assert total["s"] + total["f"] <= total["n"]
        assert groups.count() == groups.select(*GROUP_KEYS).distinct().count()
        assert groups.filter("first_seen > last_seen OR date_trunc('hour', first_seen) != bucket_start").count() == 0


def test_groups_of_parts_merge_to_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "rollup")
    halves = [table.filter(F.xxhash64("id") % 2 == 0), table.filter(F.xxhash64("id") % 2 != 0)]
    for n, half in enumerate(halves):
        for _ in range(2):  # a batch written again replaces itself
            write_rollup(group_events(half), path, f"b{n}")
    merged, whole = merge_groups(read_rollup(spark, path)), group_events(table)
    assert merged.schema.simpleString() == whole.schema.simpleString()
    assert sorted(merged.collect()) == sorted(whole.collect())

    target, day = str(tmp_path / "days"), date(2024, 1, 7)
    for _ in range(2):
        write_rollup(merge_groups(read_rollup(spark, path, day, day)), target, "compacted")
    compacted = read_rollup(spark, target)
    assert sorted(compacted.collect()) == sorted(whole.filter(F.to_date("bucket_start") == F.lit(day)).collect())
    assert "2024-01-07" in scan_part(read_rollup(spark, path, day, day), "PartitionFilters")


def test_group_aggregation_combines_before_the_shuffle(table):
    text = plan(group_events(table))
    assert "partial_count" in text and "Python" not in text
    assert "metadata" not in text and "client_ip" not in text


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (700,), (None,)], "v int")
    rows = [tuple(r) for r in bucket_histogram(df, "v", [5, 1, 500]).collect()]
    assert rows == [("1", 1, 4, 712), ("5", 2, 4, 712), ("500", 3, 4, 712), ("+Inf", 4, 4, 712)]
    empty = bucket_histogram(df.filter("v < 0"), "v", [1]).collect()
    assert [tuple(r) for r in empty] == [("1", 0, 0, 0), ("+Inf", 0, 0, 0)]


def test_page_document(spark, table):
    import json

    page = fetch_page(table, FILTERS[0], newest=NEWEST)
    document = json.loads(page_json(page.to_df(spark), page.next_cursor).first()[0])
    assert [e["id"] for e in document["events"]] == [r["id"] for r in page.events]
    assert document["next_cursor"] == page.next_cursor
    first = document["events"][0]
    assert first["category"] == "security_change" and first["created_at"].endswith("Z")
    assert ("request_id" in first) == (page.events[0]["request_id"] != "")
    empty = fetch_page(table, EventFilter(actor="nobody"))
    assert page_json(empty.to_df(spark), empty.next_cursor).first()[0] == '{"events":null}'


def test_groups_document(spark, table):
    import json

    groups = spark.createDataFrame(fetch_groups(table, FILTERS[0], newest=NEWEST), GROUP_SCHEMA)
    document = json.loads(groups_json(groups).first()[0])
    seen = [g["last_seen"] for g in document["groups"]]
    assert len(seen) == 20 and seen == sorted(seen, reverse=True)
    assert set(document["groups"][0]) >= {"bucket_start", "count", "success_count", "failure_count", "first_seen"}
    blank = groups.limit(1).withColumn("service", F.lit(""))
    assert "service" not in json.loads(blank.select(group_json()).first()[0])
