"""What is let in, what is set aside, and what is stored."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trailspark.operators.admission import (
    MAX_RPC_EVENTS,
    admit_envelopes,
    admitted_events,
    batch_decisions,
    reject_reason,
    with_reason,
)
from trailspark.operators.delivery import death_count, decode_messages
from trailspark.operators.normalize import assign_id, map_wire, normalize
from trailspark.operators.render import encode_messages
from trailspark.schema import DELIVERY_SCHEMA, EVENT_COLUMNS, EVENT_STRUCT, PAYLOADS, TEXT
from trailspark.sinks.messages import split_encodable, write_messages
from trailspark.sources.envelopes import decode_envelopes, explode_events, read_envelopes
from trailspark.sources.messages import COORDINATES, from_files, from_kafka, from_text

GOOD = {"actor": "clerk-7", "action": "invoice.void", "target_type": "invoice", "scope_type": "branch"}


def events(spark, *given: dict):
    return spark.createDataFrame([{c: e.get(c) for c in EVENT_COLUMNS} for e in given], EVENT_STRUCT)


def envelopes(spark, *bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    return decode_envelopes(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, body string"))


VALIDATION = [
    (GOOD, None),
    (GOOD | {"actor": ""}, "actor is required"),
    (GOOD | {"action": None}, "action is required"),
    (GOOD | {"target_type": ""}, "target_type is required"),
    (GOOD | {"scope_type": ""}, "scope_type is required"),
    (GOOD | {"scope_type": "", "action": ""}, "action is required"),
    (GOOD | {"actor": " "}, None),
    ({}, "actor is required"),
]


def test_required_fields(spark):
    got = events(spark, *(e for e, _ in VALIDATION)).select(reject_reason()).collect()
    assert [r[0] for r in got] == [reason for _, reason in VALIDATION]


def test_payloads_that_do_not_encode(spark):
    given = events(
        spark, GOOD, GOOD | {"metadata": "{bad"}, GOOD | {"before_state": ""}, GOOD | {"after_state": '{"a":1} x'},
        GOOD | {"metadata": "{bad", "actor": ""}, GOOD | {"after_state": '{"a":1,"a":2}'},
    )
    got = [r["reason"] for r in with_reason(given).collect()]
    assert got == [None, "encode_error", None, "encode_error", "actor is required", None]
    good, bad = split_encodable(given)
    assert (good.count(), bad.count()) == (3, 3)


def test_batches(spark):
    second = {"actor": "clerk-9", "action": "invoice.pay", "target_type": "invoice", "scope_type": "branch"}
    decoded = envelopes(
        spark,
        {"events": [GOOD, second]},
        {"events": []},
        {"events": [GOOD, second | {"actor": ""}]},
        {"events": [GOOD, None]},
        {},
        {"events": None},
    )
    admitted = {r["n"]: (r["n_events"], r["reason"]) for r in admit_envelopes(decoded).collect()}
    assert admitted == {
        0: (2, None), 1: (0, "events required"), 2: (2, "actor is required"), 3: (2, "nil event"),
        4: (0, "events required"), 5: (0, "events required"),
    }
    rows = explode_events(decoded.filter("n IN (0, 1, 3)")).orderBy("n", "pos").collect()
    assert [(r["n"], r["pos"], r["is_null"], r["action"]) for r in rows] == [
        (0, 0, False, "invoice.void"), (0, 1, False, "invoice.pay"), (1, None, True, None),
        (3, 0, False, "invoice.void"), (3, 1, True, None),
    ]


@pytest.mark.parametrize("size, reason", [(1, None), (1000, None), (1001, "batch size 1001 exceeds maximum 1000")])
def test_batch_sizes(spark, size, reason):
    decoded = envelopes(spark, {"events": [GOOD] * size})
    assert admit_envelopes(decoded, MAX_RPC_EVENTS).first()["reason"] == reason
    assert admit_envelopes(decoded).first()["reason"] is None


UNDECODABLE = [
    "[]", "null", "{bad", '{"events":[5]}', '{"events":5}', '{"events":[{"actor":5}]}', '{"events":[]} x', "",
    '{"events":[{"created_at":"today"}]}', '{"events":[[]]}', '{"events":{"actor":"u"}}',
]


def test_undecodable_envelopes(spark):
    rows = envelopes(spark, *UNDECODABLE, {"events": [GOOD | {"id": "mine", "extra": 1}]}).orderBy("n").collect()
    assert [r["decode_error"] for r in rows] == [True] * len(UNDECODABLE) + [False]


def test_envelopes_from_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "whole").mkdir()
    body = {"events": [GOOD, GOOD]}
    (tmp_path / "lines" / "a.json").write_text(json.dumps(body) + "\n" + json.dumps(body) + "\n")
    (tmp_path / "whole" / "a.json").write_text(json.dumps(body, indent=2))
    lines = decode_envelopes(read_envelopes(spark, str(tmp_path / "lines")))
    whole = decode_envelopes(read_envelopes(spark, str(tmp_path / "whole"), whole_files=True))
    assert [lines.count(), whole.count()] == [2, 1]
    assert lines.select("source_file", "source_row").distinct().count() == 2
    assert explode_events(whole).filter("actor = 'clerk-7'").count() == 2


def flat_batches(spark):
    """One batch with a third of all events, valid but for its last; many small ones."""
    rows = []
    for n in range(600):
        batch = 0 if n % 3 == 0 else 1 + n // 30
        actor = "" if n in (597, 64, 65, 400) else "u"
        rows.append((batch, n, actor, "act" if n != 64 else "", "t", "s"))
    return spark.createDataFrame(
        rows, "batch int, pos int, actor string, action string, target_type string, scope_type string"
    )


def test_batches_are_hashed_not_sorted(spark):
    from tests.plans import plan

    text = plan(batch_decisions(flat_batches(spark), "batch", "pos"))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort " not in text


@pytest.mark.parametrize("max_events", [None, 100])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_flat_batches_against_brute_force(spark, max_events, threshold):
    given = flat_batches(spark)
    batches: dict[int, list] = {}
    for r in given.collect():
        batches.setdefault(r["batch"], []).append(r)

    def reason(rows):
        if max_events and len(rows) > max_events:
            return f"batch size {len(rows)} exceeds maximum {max_events}"
        for r in sorted(rows, key=lambda r: r["pos"]):
            if not r["actor"]:
                return "actor is required"
            if not r["action"]:
                return "action is required"
        return None

    wanted = {batch: (len(rows), reason(rows)) for batch, rows in batches.items()}
    decided = batch_decisions(given, "batch", "pos", max_events)
    assert {r["batch"]: (r["n_events"], r["reason"]) for r in decided.collect()} == wanted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        kept = sorted(r["pos"] for r in admitted_events(given, "batch", "pos", max_events).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == sorted(r["pos"] for b, rows in batches.items() if wanted[b][1] is None for r in rows)


def test_normalize(spark):
    arrival = F.lit("2026-05-17 12:00:00").cast("timestamp")
    given = events(spark, GOOD | {"metadata": "", "before_state": "{}"}, {}).withColumn("k", F.lit(1))
    first, second = normalize(given, arrival).select("*", F.col("created_at").cast("string").alias("at")).collect()
    assert [first[c] for c in ("service", "target_id", "metadata", "before_state", "at", "k")] == [
        "", "", None, "{}", "2026-05-17 12:00:00", 1,
    ]
    assert [second[c] for c in TEXT] == [""] * len(TEXT)
    unset = given.withColumn("created_at", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    assert {r[0] for r in normalize(unset, arrival).select(F.col("created_at").cast("string")).collect()} == {
        "2026-05-17 12:00:00"
    }


def test_map_wire(spark):
    arrival = F.lit("2026-05-17 12:00:00").cast("timestamp")
    wire = (
        events(spark, GOOD | {"metadata": '{"a":1}'})
        .withColumns({c: F.col(c).cast("binary") for c in PAYLOADS})
        .withColumnRenamed("created_at", "timestamp")
    )
    row = map_wire(wire, arrival).select("*", F.col("created_at").cast("string").alias("at")).first()
    assert (row["metadata"], row["service"], row["at"]) == ('{"a":1}', "", "2026-05-17 12:00:00")


BODIES = [
    ('{"actor":"u","metadata":{"b": [1, 2]},"after_state":"text"}', None, False, None),
    ('{"actor":"u","unknown":1}', None, False, None),
    ('{"actor":"u","id":"client"}', None, None, None),
    ("{}", None, False, None),
    ("{bad", None, False, "decode_error"),
    ("[1]", None, False, "decode_error"),
    ("null", None, False, "decode_error"),
    ('{"actor":"u"} trailing', None, False, "decode_error"),
    ('{"actor":5,"action":"x"}', None, False, "decode_error"),
    ('{"actor":"u","action":{"z":1}}', None, False, "decode_error"),
    ('{"actor":"u","created_at":"yesterday"}', None, False, "decode_error"),
    ('{"actor":"u","created_at":7}', None, False, "decode_error"),
    ("{bad", [(3,)], False, "max_redeliveries"),
    ("{}", [(3,), (0,)], False, "max_redeliveries"),
    ("{}", [(2,), (9,)], False, None),
    ("{}", [], True, None),
    ("{}", [(None,)], True, None),
]


def test_message_bodies(spark):
    given = spark.createDataFrame([b[:3] for b in BODIES], DELIVERY_SCHEMA)
    rows = decode_messages(given, 3).collect()
    assert [r["dead_reason"] for r in rows] == [b[3] for b in BODIES]
    assert (rows[0]["event"]["metadata"], rows[0]["event"]["after_state"]) == ('{"b":[1,2]}', '"text"')


def test_redelivery_without_header_counts_once(spark):
    given = spark.createDataFrame([("{}", None, True), ("{}", None, False), ("{}", [], True)], DELIVERY_SCHEMA)
    assert [r[0] for r in given.select(death_count()).collect()] == [1, 0, 0]
    assert [r["dead_reason"] for r in decode_messages(given, 1).collect()] == ["max_redeliveries", None, None]
    assert [r["dead_reason"] for r in decode_messages(given, 0).collect()] == [None, None, None]


def test_a_filter_on_the_outcome_does_not_decode_again(spark):
    from tests.plans import plan

    given = spark.createDataFrame([b[:3] for b in BODIES], DELIVERY_SCHEMA)
    text = plan(decode_messages(given).filter("dead_reason IS NULL").select("event.*"))
    assert text.count("parseJson") == 1


def test_messages_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "messages")
    write_messages(table, path)
    decoded = decode_messages(from_text(spark, path))
    assert decoded.filter("dead_reason IS NOT NULL").count() == 0
    back = normalize(decoded.select("event.*"), F.current_timestamp()).select(*EVENT_COLUMNS)
    sent = table.select(*EVENT_COLUMNS)
    assert back.exceptAll(sent).count() == sent.exceptAll(back).count() == 0


def test_message_fields(spark):
    given = events(spark, GOOD | {"metadata": '{"a":1}', "client_ip": ""})
    body = json.loads(encode_messages(given).first()["value"])
    assert body == GOOD | {"metadata": {"a": 1}}


def test_kafka_records(spark):
    records = spark.createDataFrame(
        [(bytearray(b'{"actor":"u"}'), "trail", 3, 41)], "value binary, topic string, partition int, offset long"
    )
    row = from_kafka(records).first()
    assert (row["body"], row["source"], row["position"], row["x_death"], row["redelivered"]) == (
        '{"actor":"u"}', "trail/3", 41, None, None,
    )


def test_file_coordinates_do_not_depend_on_the_split(spark, tmp_path):
    path = str(tmp_path / "deliveries")
    rows = spark.range(2000).select(
        F.concat(F.lit('{"actor":"'), "id", F.lit('"}')).alias("body"),
        F.lit(None).cast("array<struct<count:bigint>>").alias("x_death"), F.lit(False).alias("redelivered"),
    )
    rows.repartition(3).write.parquet(path)

    def ids():
        decoded = decode_messages(from_files(spark, path))
        stored = normalize(decoded.select(*COORDINATES, "event.*"), F.current_timestamp())
        return {(r["id"], r["actor"]) for r in assign_id(stored, *COORDINATES).select("id", "actor").collect()}

    first = ids()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert ids() == first and len({i for i, _ in first}) == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_over_the_size_limit_have_a_reason_of_their_own(spark):
    from trailspark.streaming.publish import published, refused

    body = json.dumps({"events": [GOOD]})
    large = json.dumps({"events": [GOOD | {"metadata": {"é": "x" * 100}}]}, ensure_ascii=False)
    rows = [(body, "f", 0), (large, "f", 1), ("{oops" + "x" * 500, "f", 2), ("{oops", "f", 3), (None, "f", 4)]
    given = spark.createDataFrame(rows, "body string, source_file string, source_row bigint")
    limit = len(large.encode()) - 1
    got = sorted((r["body"] or "", r["reason"]) for r in refused(given, max_bytes=limit).collect())
    wanted = [(large, "body too large"), (rows[2][0], "body too large"), ("{oops", "decode_error"), ("", "decode_error")]
    assert got == sorted(wanted)
    assert published(given, max_bytes=limit).count() == 1
    assert refused(given, max_bytes=limit + 1).filter("reason = 'body too large'").count() == 1
    assert published(given).count() == 2


def test_only_heavy_refused_batches_are_split(spark):
    from trailspark.operators.admission import batch_decisions, heavy_batches

    n = F.col("id")
    batch = F.when(n % 3 == 0, 0).when(n % 50 == 1, None).otherwise(n % 5000 + 1)
    given = spark.range(30_000).select(
        n.alias("pos"), batch.alias("batch"),
        F.when((n == 9) | (n == 101) | (n == 100), "").otherwise("a").alias("actor"),
        *(F.lit("x").alias(c) for c in ("action", "target_type", "scope_type")),
    )
    heavy = {r["_heavy"]: r["_pieces"] for r in heavy_batches(batch_decisions(given, "batch", "pos"), "batch").collect()}
    sizes = {r["batch"]: r["count"] for r in given.groupBy("batch").count().collect()}
    assert heavy == {b: -(-k * 1000 // 30_000) for b, k in sizes.items() if k * 1000 > 30_000}
    assert set(heavy) == {0, None}
    refused = {r["batch"] for r in given.filter("actor = ''").select("batch").collect()}
    kept = sorted(r["pos"] for r in admitted_events(given, "batch", "pos").collect())
    assert kept == sorted(r["pos"] for r in given.collect() if r["batch"] not in refused) and refused == {0, None, 101}
