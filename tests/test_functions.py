"""Scalar rules on small literal tables."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trailspark.functions.category import (
    BUSINESS_VERBS,
    READ_VERBS,
    SECURITY_DOMAINS,
    SECURITY_VERBS,
    CategoryRules,
    category_column,
    implied_service,
)
from trailspark.functions.cursor import (
    cursor_column,
    cursor_id,
    cursor_time,
    decode_cursor,
    encode_cursor,
)
from trailspark.functions.identity import event_id
from trailspark.functions.payload import is_strict_json
from trailspark.functions.status import http_status
from trailspark.functions.times import parse_rfc3339, rfc3339_to_timestamp, timestamp_to_rfc3339
from trailspark.functions.values import clean_values, clean_values_column

CATEGORIES = [
    ("gateway", "GET /admin/audit/groups", "sensitive_read"),
    ("gateway", "user.create", "router_access"),
    ("svc", "user.create", "security_change"),
    ("svc", "tenant.member.assign", "security_change"),
    ("svc", "user.", "security_change"),
    ("svc", "a.session.x", "security_change"),
    ("svc", ".role.x", "security_change"),
    ("svc", "campaign.create", "business_mutation"),
    ("svc", "userland.create", "business_mutation"),
    ("svc", "superuser.create", "business_mutation"),
    ("svc", ".create", "business_mutation"),
    ("svc", "report.export", "sensitive_read"),
    ("svc", "GET /admin/audit", "system"),
    ("svc", "role.x", "security_change"),
    ("svc", "Role.x", "system"),
    ("svc", "create", "system"),
    ("svc", "user", "system"),
    ("svc", "", "system"),
    ("svc", "x.user", "system"),
    ("svc", "campaign.create\n", "system"),
    ("svc", "campaign\n.assign", "security_change"),
    (None, "report.view", "sensitive_read"),
    (None, "GET /admin/audit", "system"),
]


def by_pattern(service: str, action: str) -> str:
    """The rules stated once more, as patterns over the whole action."""
    if service == "gateway":
        return "sensitive_read" if action.startswith("GET /admin/audit") else "router_access"
    domains, security, business, reads = (
        "|".join(words) for words in (SECURITY_DOMAINS, SECURITY_VERBS, BUSINESS_VERBS, READ_VERBS)
    )
    if re.search(rf"(^|\.)({domains})\.", action) or re.search(rf"\.({security})\Z", action):
        return "security_change"
    if re.search(rf"\.({business})\Z", action):
        return "business_mutation"
    return "sensitive_read" if re.search(rf"\.({reads})\Z", action) else "system"


def test_category_table(spark):
    df = spark.createDataFrame(CATEGORIES, "service string, action string, wanted string")
    wrong = df.withColumn("got", category_column()).filter("NOT got <=> wanted").collect()
    assert wrong == []


WORDS = ["", "user", "users", "session", "sts", "create", "assign", "view", "x", "create\n", "\nuser", "Role", "role"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=4), min_size=200, max_size=400))
def test_category_equals_patterns(spark, actions):
    rows = [(s, ".".join(a)) for a in actions for s in ("svc", "gateway")]
    df = spark.createDataFrame(rows, "service string, action string")
    got = df.select("service", "action", category_column().alias("c")).collect()
    assert [r["c"] for r in got] == [by_pattern(r["service"], r["action"]) for r in got]


def test_category_rules_are_parameters(spark):
    rules = CategoryRules(gateway="edge", audit_read_prefix="READ /trail")
    df = spark.createDataFrame([("edge", "READ /trail/1"), ("gateway", "READ /trail")], "service string, action string")
    assert [r[0] for r in df.select(category_column(rules=rules)).collect()] == ["sensitive_read", "system"]


def test_implied_service_holds_for_every_row(spark):
    df = spark.createDataFrame(CATEGORIES, "service string, action string, wanted string")
    for category in {c for _, _, c in CATEGORIES}:
        implied = implied_service(category, F.col("service"))
        if implied is not None:
            rows = df.filter(category_column() == category)
            assert rows.filter(implied).count() == rows.count()


STATUSES = [
    ('{"http_status":200}', 200),
    ('{"http_status":"404"}', 404),
    ('{"http_status":"00200"}', 200),
    ('{"http_status":200,"http_status":500}', 500),
    ('{"http_status":500,"x":"http_status","http_status":"201"}', 201),
    ('{"http\\u005fstatus":418}', 418),
    ('{"a":{"http_status":200}}', None),
    ('{"http_status":"200\\n"}', None),
    ('{"http_status":" 200"}', None),
    ('{"http_status":"+200"}', None),
    ('{"http_status":-200}', None),
    ('{"http_status":200.0}', None),
    ('{"http_status":true}', None),
    ('{"http_status":{"a":1}}', None),
    ('{"http_status":""}', None),
    ('{"http_status":null}', None),
    ('{"http_status":99999999999}', None),
    ('{"a":1}', None),
    ("[1]", None),
    ('[{"http_status":200}]', None),
    ('"http_status"', None),
    ("null", None),
    (None, None),
]


def test_http_status_table(spark):
    df = spark.createDataFrame(STATUSES, "metadata string, wanted int")
    assert df.withColumn("got", http_status()).filter("NOT got <=> wanted").collect() == []


TEXTS = [
    "{}", "[]", '{"a":1}', " 1 ", '"x"', "null", "true", '{"a":{"b":[1,2]}}', '{"a":1,"a":2}', "1.5e3", '["]"]',
    '{"a":1} x', '{"a":1}{"b":2}', "1 2", '{"a":1}]', '{"a":1}], [{}', "1], [2", '1}', "{'a':1}", '{"a":NaN}',
    "NaN", "007", "", " ", "{", "[1,]", '{"a":1,}', "tru", "/* c */ 1", '"a\tb"', "\"a", "01", "-", "+1", "[1]]",
]


def test_strict_json_agrees_with_a_strict_parser(spark):
    def strict(text: str) -> bool:
        def refuse(constant):
            raise ValueError(constant)

        try:
            json.loads(text, parse_constant=refuse)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", is_strict_json("t").alias("ok")).collect()}
    assert got == {t: strict(t) for t in TEXTS}


def test_strict_json_of_null_is_false(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(is_strict_json("t")).first()[0] is False


def test_cursor_round_trip(spark):
    at, key = datetime(2026, 5, 17, 12, 0, 0, 123456, timezone.utc), "00000000-0000-0000-0000-000000000001"
    cursor = encode_cursor(at, key)
    assert decode_cursor(cursor) == (at, key)
    df = spark.createDataFrame([(key,)], "id string").withColumn(
        "created_at", F.lit("2026-05-17 12:00:00.123456Z").cast("timestamp")
    )
    coded = df.withColumn("cursor", cursor_column())
    row = coded.select(
        "cursor", cursor_id("cursor").alias("i"), (cursor_time("cursor") == F.col("created_at")).alias("same")
    ).first()
    assert (row["cursor"], row["i"], row["same"]) == (cursor, key, True)


@given(st.datetimes(timezones=st.just(timezone.utc)), st.text(min_size=1).filter(lambda s: s.isprintable()))
def test_cursor_round_trip_of_any_time(at, key):
    assert decode_cursor(encode_cursor(at, key)) == (at, key)


@pytest.mark.parametrize("cursor", ["x", "!!!!", "MTIz", "YWJjfGRlZg==", "é", "MTIzfA==", "OTk5OTk5OTk5OTk5OTk5OTk5OTk5OTl8eA=="])
def test_bad_cursors(cursor):
    with pytest.raises(ValueError):
        decode_cursor(cursor)


TIMES = [
    ("2026-05-17T12:00:00Z", "2026-05-17 12:00:00"),
    ("2026-05-17T12:00:00.1234569+02:00", "2026-05-17 10:00:00.123456"),
    ("0001-01-01T00:00:00Z", "0001-01-01 00:00:00"),
    ("2026-05-17T12:00:00", None),
    ("2026-05-17 12:00:00Z", None),
    ("2026-05-17t12:00:00Z", None),
    ("2026-05-17", None),
    ("2026-02-30T12:00:00Z", None),
    ("2026-05-17T24:00:00Z", None),
    ("2026-05-17T12:00:60Z", None),
    ("2026-05-17T12:00:00Z\n", None),
    ("", None),
]


def test_rfc3339(spark):
    df = spark.createDataFrame(TIMES, "t string, wanted string")
    got = df.withColumn("got", rfc3339_to_timestamp(F.col("t")).cast("string"))
    assert got.filter("NOT got <=> wanted").collect() == []
    for text, wanted in TIMES:
        parsed = parse_rfc3339(text)
        assert (parsed and parsed.replace(tzinfo=None)) == (wanted and datetime.fromisoformat(wanted))


def test_rfc3339_out_cuts_zeros(spark):
    times = ["2026-05-17 12:00:00", "2026-05-17 12:00:00.25", "2026-05-17 12:00:10.100001", "2026-05-17 12:00:00.000100"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp"))
    got = [r[0] for r in df.select(timestamp_to_rfc3339(F.col("t"))).collect()]
    assert got == [
        "2026-05-17T12:00:00Z", "2026-05-17T12:00:00.25Z", "2026-05-17T12:00:10.100001Z", "2026-05-17T12:00:00.0001Z",
    ]


VALUE_LISTS = [
    (["sensitive_read, router_access", "router_access"], ["sensitive_read", "router_access"]),
    ([" a ,, b", " b\t", ""], ["a", "b"]),
    ([" , "], []),
    ([], []),
]


def test_clean_values(spark):
    assert [clean_values(raw) for raw, _ in VALUE_LISTS] == [wanted for _, wanted in VALUE_LISTS]
    df = spark.createDataFrame(VALUE_LISTS, "raw array<string>, wanted array<string>")
    assert df.withColumn("got", clean_values_column("raw")).filter("NOT got <=> wanted").collect() == []


def test_event_ids_depend_on_coordinates_only(spark):
    df = spark.range(10_000).select(event_id(F.lit("a"), "id").alias("i"), event_id(F.lit("a"), "id").alias("j"))
    assert df.filter("i != j").count() == 0
    assert df.select("i").distinct().count() == 10_000
    shape = r"\A[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}\z"
    assert df.filter(~F.col("i").rlike(shape)).count() == 0
    split = spark.range(1).select(event_id(F.lit("ab"), F.lit("c")).alias("i"), event_id(F.lit("a"), F.lit("bc")).alias("j"))
    assert split.filter("i = j").count() == 0
