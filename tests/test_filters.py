"""The event filter."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.plans import plan, scan_part
from trailspark.functions.cursor import encode_cursor
from trailspark.operators.filters import EventFilter, build_predicate, filter_events
from trailspark.operators.listing import list_columns, page_size
from trailspark.schema import TABLE_SCHEMA

AT = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc)


def test_from_params():
    got = EventFilter.from_params(
        {
            "actor": ["a", "b"], "category": ["system"], "limit": ["+7"], "status_min": ["200"], "status_max": ["4xx"],
            "since": ["2024-01-15T12:00:00Z"], "until": ["yesterday"], "exclude_category": ["a"],
            "exclude_category[]": ["b,c"], "exclude_categories": ["d"], "exclude_services": ["s"], "unknown": ["x"],
        }
    )
    assert got == EventFilter(
        actor="a", category="system", limit=7, status_min=200, since=AT,
        exclude_categories=("a", "b,c", "d"), exclude_services=("s",),
    )


@pytest.mark.parametrize("text", ["", " 7", "7 ", "1_0", "٣", "9223372036854775808", "0x10", "7.0"])
def test_numbers_that_do_not_parse_are_left_out(text):
    assert EventFilter.from_params({"limit": [text]}).limit == 0


@pytest.mark.parametrize("limit, size", [(-1, 50), (0, 50), (1, 1), (100, 100), (101, 50)])
def test_page_size(limit, size):
    assert page_size(limit) == size


def test_blank_filter_keeps_all(table):
    blank = EventFilter(actor=" ", scope_id="", exclude_actions=[" ,", ""])
    assert filter_events(table, blank).count() == table.count()
    assert filter_events(table).count() == table.count()


def test_bad_cursor_is_the_first_page_unless_strict(table):
    bad = EventFilter(cursor="nonsense")
    assert filter_events(table, bad).count() == table.count()
    with pytest.raises(ValueError):
        filter_events(table, bad, strict_cursor=True)


def test_cursor_is_left_out_on_request(table):
    flt = EventFilter(cursor=encode_cursor(AT, "x"))
    assert filter_events(table, flt, with_cursor=False).count() == table.count()
    assert filter_events(table, flt).count() < table.count()


def test_bounds_are_inclusive(spark):
    rows = [(f"i{n}", f"2024-01-15 1{n}:00:00") for n in range(4)]
    events = spark.createDataFrame(rows, "id string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    flt = EventFilter(since=AT.replace(hour=11), until=AT)
    assert sorted(r["id"] for r in filter_events(events, flt).collect()) == ["i1", "i2"]


def test_rows_older_than_a_column_read_blank(spark):
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLE_SCHEMA)
    row = {f.name: None for f in TABLE_SCHEMA} | {"id": "1", "action": "user.create", "created_at": AT}
    events = spark.createDataFrame([row], columns)
    kept = (
        EventFilter(exclude_services=["web"]), EventFilter(category="security_change"),
        EventFilter(exclude_categories=["system"]),
    )
    for flt in kept:
        assert filter_events(events, flt).count() == 1, flt
    assert filter_events(events, EventFilter(service="web")).count() == 0
    listed = list_columns(events).first()
    assert (listed["service"], listed["request_id"], listed["category"]) == ("", "", "security_change")


def test_plain_predicates_reach_the_scan(table):
    flt = EventFilter(
        service="web-svc", actor="user-1", request_id="req-1", exclude_actions=["x"], since=AT,
        cursor=encode_cursor(AT.replace(day=20), "i"),
    )
    matching = filter_events(table, flt)
    pushed = scan_part(matching, "PushedFilters")
    for part in (
        "EqualTo(service,web-svc)", "EqualTo(actor,user-1)", "EqualTo(request_id,req-1)", "Not(EqualTo(action,x))",
        "GreaterThanOrEqual(created_at,2024-01-15", "LessThanOrEqual(created_at,2024-01-20",
        "Or(LessThan(created_at,2024-01-20",
    ):
        assert part in pushed, part
    pruned = scan_part(matching, "PartitionFilters")
    assert "created_date" in pruned and "2024-01-15" in pruned and "2024-01-20" in pruned


def test_a_category_pushes_the_service_it_implies(table):
    for category, part in (("router_access", "EqualTo(service,gateway)"), ("system", "Not(EqualTo(service,gateway))")):
        assert part in scan_part(filter_events(table, EventFilter(category=category)), "PushedFilters")


def test_payloads_are_read_only_when_asked_for(table):
    assert "metadata" not in plan(filter_events(table, EventFilter(actor="user-1")).select("id"))
    assert "metadata" not in plan(filter_events(table, EventFilter(status_min=200)).select("id"))
    assert "metadata" in plan(filter_events(table.drop("http_status"), EventFilter(status_min=200)).select("id"))


def test_the_stored_status_reaches_the_scan(table):
    matching = filter_events(table, EventFilter(status_min=200, status_max=399))
    pushed = scan_part(matching, "PushedFilters")
    assert "GreaterThanOrEqual(http_status,200)" in pushed and "LessThanOrEqual(http_status,399)" in pushed
    assert matching.count() == filter_events(table.drop("http_status"), EventFilter(status_min=200, status_max=399)).count()


def test_predicate_is_a_plain_column(table):
    flt = EventFilter(actor="user-1", status_min=400)
    direct = table.filter(build_predicate(flt, table.schema))
    assert direct.count() == filter_events(table, flt).count() > 0
    assert filter_events(table, replace(flt, status_min=0)).count() > direct.count()
