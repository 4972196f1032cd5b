"""The event table, its layout, and the stream that fills it."""

from __future__ import annotations

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.plans import scan_part
from trailspark.operators.delivery import decode_messages
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.groups import group_events, merge_groups
from trailspark.operators.listing import fetch_page
from trailspark.plans.audit_view import table_events
from trailspark.plans.catalog import delivery_files, run_ingest
from trailspark.schema import EVENT_COLUMNS, STORED_COLUMNS
from trailspark.session import cluster_conf, shared_dir
from trailspark.sinks.dead_letters import read_dead_letters
from trailspark.sinks.events import append_events, compact_days
from trailspark.sinks.ledger import (
    batch_size_histogram,
    ledger_totals,
    read_ledger,
    write_seconds_histogram,
)
from trailspark.sources.events import read_events, read_rollup
from trailspark.sources.envelopes import read_envelopes, stream_envelopes
from trailspark.sources.messages import from_files, from_kafka, stream_text
from trailspark.streaming.ingest import IngestTables, batch_key, start_ingest
from trailspark.streaming.outbox import (
    Outbox,
    outbox_messages,
    outbox_refusals,
    publish_totals,
    read_commits,
    start_outbox,
    start_relay,
    to_text,
    with_place,
)
from trailspark.streaming.publish import published, refused, start_publish


def same(left, right) -> bool:
    return left.exceptAll(right).count() == right.exceptAll(left).count() == 0


def parquet_files(path: str) -> list[str]:
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_an_empty_batch_writes_nothing(spark, table, tmp_path):
    path = str(tmp_path / "events")
    append_events(table.limit(0), path, "b0")
    assert parquet_files(path) == []


def test_append_adds_batches_and_replaces_a_repeated_one(spark, table, tmp_path):
    path = str(tmp_path / "events")
    halves = [table.filter("hash(id) % 2 = 0"), table.filter("hash(id) % 2 != 0")]
    append_events(halves[0], path, "b0")
    append_events(halves[1], path, "b1")
    append_events(halves[0], path, "b0")
    stored = read_events(spark, path, status_stored=True)
    assert same(stored.select(*STORED_COLUMNS), table.select(*STORED_COLUMNS))
    assert stored.filter("created_date != to_date(created_at)").count() == 0


def test_a_bulk_load_writes_few_files(spark, table, tmp_path):
    small, bulk = str(tmp_path / "small"), str(tmp_path / "bulk")
    mixed = table.repartition(8, F.xxhash64("id"))
    append_events(mixed, small, "b")
    append_events(mixed, bulk, "b", bulk=True)
    assert same(read_events(spark, small, status_stored=True), read_events(spark, bulk, status_stored=True))
    assert len(parquet_files(bulk)) < len(parquet_files(small)) / 2


def test_rows_of_a_file_run_newest_first(spark, table, tmp_path):
    path = str(tmp_path / "events")
    append_events(table.repartition(3), path, "b")
    for file in parquet_files(path)[:20]:
        keys = [(r["created_at"], r["id"]) for r in spark.read.parquet(file).select("created_at", "id").collect()]
        assert keys == sorted(keys, reverse=True)


def test_compaction_rewrites_whole_days_and_can_run_again(spark, sf_dir, tmp_path):
    source, target = str(tmp_path / "landed"), str(tmp_path / "days")
    given = table_events(spark, sf_dir).select(*STORED_COLUMNS)
    for n in range(3):
        append_events(given.filter(F.pmod(F.hash("id"), F.lit(3)) == n), source, f"b{n}")
    since, until = (datetime(2024, 1, d, 15, tzinfo=timezone.utc) for d in (4, 6))
    for _ in range(2):
        compact_days(spark, source, target, since, until)
    wanted = given.filter("to_date(created_at) BETWEEN DATE'2024-01-04' AND DATE'2024-01-06'")
    assert same(read_events(spark, target, status_stored=True).select(*STORED_COLUMNS), wanted)
    compact_days(spark, source, target)
    assert same(read_events(spark, target, status_stored=True).select(*STORED_COLUMNS), given)
    assert len(parquet_files(target)) < len(parquet_files(source))


def test_compacted_files_have_bloom_filters(spark, tmp_path):
    """Columns with few values have a dictionary instead, which serves the same lookups."""
    source, target = str(tmp_path / "landed"), str(tmp_path / "days")
    text = {c: F.lit("x") for c in STORED_COLUMNS if c not in ("id", "created_at")}
    text["request_id"] = F.sha2(F.col("id").cast("string"), 256)
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = spark.range(0, 100_000, 1, 1).withColumns(text | {"created_at": at, "id": F.col("id").cast("string")})
    append_events(rows, source, "b")
    compact_days(spark, source, target)
    jvm = spark._jvm.org.apache
    (file,) = parquet_files(target)
    reader = jvm.parquet.hadoop.ParquetFileReader.open(
        jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
    )
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        filtered = {c.getPath().toDotString() for c in columns if c.getBloomFilterOffset() > 0}
    finally:
        reader.close()
    assert filtered == {"request_id"}
    assert os.path.getsize(file) < 20_000_000


def test_an_hour_that_holds_most_rows_is_split(spark, tmp_path):
    source, target = str(tmp_path / "landed"), str(tmp_path / "days")
    text = {c: F.sha2(F.concat("id", F.lit(c)), 256) for c in STORED_COLUMNS if c not in ("id", "created_at")}
    hour = F.when(F.col("id") % 10 < 7, F.lit("2024-01-01 12:00:00")).otherwise(F.lit("2024-01-02 01:00:00"))
    rows = spark.range(0, 40_000, 1, 8).withColumns(
        text | {"created_at": hour.cast("timestamp"), "id": F.col("id").cast("string")}
    )
    append_events(rows, source, "b")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
    try:
        compact_days(spark, source, target)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([f for f in parquet_files(target) if "2024-01-01" in f]) > 2
    assert same(read_events(spark, target, status_stored=True).select("id", "created_at"), rows.select("id", "created_at"))


def test_lookup_by_request_reads_the_plain_column(spark, table):
    matching = filter_events(table, EventFilter(request_id="req-77"))
    assert "EqualTo(request_id,req-77)" in scan_part(matching, "PushedFilters")


def test_old_files_read_blank(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    given = table_events(spark, sf_dir).withColumns({"created_date": F.to_date("created_at"), "batch": F.lit("b")})
    late = ("service", "request_id", "client_ip")
    given.filter("event_id < 100").drop("event_id", *late).write.partitionBy("created_date", "batch").parquet(path)
    new = given.filter("event_id >= 100").drop("event_id")
    new.write.mode("append").partitionBy("created_date", "batch").parquet(path)
    events = read_events(spark, path)
    assert events.filter("service IS NULL").count() == 100
    assert group_events(events).agg(F.sum("success_count")).first()[0] > 0
    compacted = str(tmp_path / "compacted")
    compact_days(spark, path, compacted)
    assert same(group_events(events), group_events(read_events(spark, compacted, status_stored=True)))
    assert filter_events(events, EventFilter(service="web-svc")).filter("service IS NULL").count() == 0
    page = fetch_page(events, EventFilter(until=datetime(2024, 1, 2, tzinfo=timezone.utc), limit=5))
    assert {r[c] for r in page.events for c in late} == {""}
    assert group_events(events).filter("service IS NULL").count() == 0


def good(spark, sf_dir):
    decoded = decode_messages(from_files(spark, delivery_files(spark, sf_dir)))
    return decoded.filter("dead_reason IS NULL").select("event.*").select(
        *(F.coalesce(c, F.lit("")).alias(c) if c in ("service", "target_id", "scope_id", "request_id", "client_ip")
          else F.col(c) for c in EVENT_COLUMNS)
    )


@pytest.fixture(scope="module")
def ingested(spark, sf_dir):
    return run_ingest(spark, sf_dir)


@pytest.fixture(scope="module")
def replayed(spark, sf_dir):
    return run_ingest(spark, sf_dir, fail_after=1)


def test_stream_stores_every_good_event_once(spark, sf_dir, ingested):
    stored = read_events(spark, ingested.events, status_stored=True)
    assert same(stored.select(*EVENT_COLUMNS), good(spark, sf_dir))
    assert stored.select("id").distinct().count() == stored.count()
    assert stored.select("batch").distinct().count() > 1


def test_good_and_dead_are_all_there_is(spark, sf_dir, ingested):
    given = from_files(spark, delivery_files(spark, sf_dir))
    dead = read_dead_letters(spark, ingested.dead_letters)
    assert read_events(spark, ingested.events, status_stored=True).count() + dead.count() == given.count()
    decoded = decode_messages(given).filter("dead_reason IS NOT NULL")
    columns = ("body", "x_death", "redelivered", "source", "position")
    assert same(dead.select(*columns, "reason"), decoded.select(*columns, F.col("dead_reason").alias("reason")))


def test_replay_leaves_the_same_table(spark, ingested, replayed):
    for read, path in ((read_events, "events"), (read_dead_letters, "dead_letters")):
        plain, again = (read(spark, getattr(t, path)) for t in (ingested, replayed))
        kept = [c for c in plain.columns]
        assert same(plain.select(*kept), again.select(*kept))
    groups = [merge_groups(read_rollup(spark, t.rollup)) for t in (ingested, replayed)]
    assert same(*groups)


def test_rollup_of_the_stream_is_the_rollup_of_the_table(spark, ingested):
    assert same(
        merge_groups(read_rollup(spark, ingested.rollup)), group_events(read_events(spark, ingested.events, status_stored=True))
    )


def test_ledger_agrees_with_the_tables(spark, replayed):
    ledger = read_ledger(spark, replayed.ledger)
    totals = {r["outcome"]: r["events"] for r in ledger_totals(ledger).collect()}
    dead = {r["reason"]: r["count"] for r in read_dead_letters(spark, replayed.dead_letters).groupBy("reason").count().collect()}
    assert totals["written"] == read_events(spark, replayed.events, status_stored=True).count()
    assert {r: totals[r] for r in dead} == dead
    assert totals["read"] == totals["written"] + sum(dead.values())
    batches = ledger.count()
    assert ledger.select("batch_id").distinct().count() == batches
    for histogram in (batch_size_histogram(ledger), write_seconds_histogram(ledger)):
        rows = histogram.collect()
        counts = [r["bucket_count"] for r in rows]
        assert counts == sorted(counts) and counts[-1] == batches and rows[-1]["le"] == "+Inf"


def test_arrival_time_survives_a_replay(spark, tmp_path):
    """Events without a time get the time of the first attempt, also when the batch runs twice."""
    source, root = tmp_path / "in", str(tmp_path)
    source.mkdir()
    (source / "a.txt").write_text('{"actor":"u"}\n{"actor":"v"}\n{oops\n')
    tables = IngestTables(f"{root}/events", f"{root}/dead", f"{root}/ledger")
    seen = []

    def lose(batch_id):
        seen.append({(r["id"], r["actor"], r["created_at"]) for r in read_events(spark, tables.events, status_stored=True).collect()})
        raise RuntimeError("lost")

    def run(after_batch):
        start_ingest(
            stream_text(spark, str(source)), tables, f"{root}/checkpoint", available_now=True, after_batch=after_batch
        ).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(lose)
    run(None)
    run(None)
    stored = {(r["id"], r["actor"], r["created_at"]) for r in read_events(spark, tables.events, status_stored=True).collect()}
    assert [stored] == seen and {actor for _, actor, _ in stored} == {"u", "v"}
    assert read_dead_letters(spark, tables.dead_letters).count() == 1


def test_batch_documents_reach_the_table_once(spark, tmp_path):
    """Two streams in a row, the second stopped and started again while files arrive."""
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    event = '{"actor":"%s","action":"user.create","target_type":"t","scope_type":"s","created_at":"2024-01-01T00:00:00Z"}'
    tables = IngestTables(f"{root}/events", f"{root}/dead", f"{root}/ledger")

    def arrive(name, *bodies):
        (tmp_path / "in" / name).write_text("".join(b + "\n" for b in bodies))
        envelopes = stream_envelopes(spark, f"{root}/in")
        start_publish(envelopes, f"{root}/messages", f"{root}/c1", available_now=True).awaitTermination()

    def ingest(after_batch=None):
        messages = stream_text(spark, f"{root}/messages")
        start_ingest(
            messages, tables, f"{root}/c2", available_now=True, after_batch=after_batch
        ).awaitTermination()

    def lose(batch_id):
        raise RuntimeError("lost")

    arrive("a", '{"events":[%s,%s]}' % (event % "a1", event % "a2"), '{"events":[%s,%s]}' % (event % "x", event % ""))
    with pytest.raises(Exception, match="lost"):
        ingest(lose)
    arrive("b", '{"events":[%s]}' % (event % "b1"), '{"events":[]}', "oops")
    ingest()
    ingest()
    rows = read_events(spark, tables.events, status_stored=True).collect()
    assert sorted(r["actor"] for r in rows) == ["a1", "a2", "b1"] and len({r["id"] for r in rows}) == 3
    given = read_envelopes(spark, f"{root}/in")
    assert sorted(r["reason"] for r in refused(given).collect()) == [
        "actor is required", "decode_error", "events required",
    ]


def test_batch_keys_sort_by_number():
    assert batch_key("q", 2) < batch_key("q", 10) and batch_key("q", 2) != batch_key("r", 2)


def test_shared_dir_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named.rstrip("/")
    assert shared_dir(spark) == shared_dir(spark)


def test_cluster_conf_grows_with_the_shuffle():
    small, large = cluster_conf(1 << 30, 8), cluster_conf(10 << 40, 4000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(large["spark.sql.shuffle.partitions"]) > 50_000


def test_a_batch_is_published_with_one_commit(spark, tmp_path):
    """A stream that fails before a commit, and one that fails after, leave each document once."""
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    outbox = Outbox(f"{root}/records", f"{root}/commits")
    event = '{"actor":"%s","action":"user.create","target_type":"t","scope_type":"s"}'
    good, bad = '{"events":[%s,%s]}' % (event % "a", event % "b"), '{"events":[%s,%s]}' % (event % "a", event % "")

    def publish(**hooks):
        envelopes = stream_envelopes(spark, f"{root}/in")
        start_outbox(envelopes, outbox, f"{root}/c", available_now=True, **hooks).awaitTermination()

    def lose(batch_id):
        raise RuntimeError("lost")

    def state():
        return (
            sorted(r["value"] for r in outbox_messages(spark, outbox).collect()),
            sorted((r["body"], r["n_events"], r["reason"]) for r in outbox_refusals(spark, outbox).collect()),
            {r["outcome"]: r["n"] for r in publish_totals(read_commits(spark, outbox)).collect()},
        )

    assert state()[:2] == ([], [])
    (tmp_path / "in" / "a").write_text("\n".join([good, bad, "oops", '{"events":[]}', bad]) + "\n")
    with pytest.raises(Exception, match="lost"):
        publish(before_commit=lose)
    # written, and not to be seen
    assert len(parquet_files(outbox.records)) > 0 and state()[:2] == ([], [])
    with pytest.raises(Exception, match="lost"):
        publish(after_batch=lose)
    committed, files = state(), parquet_files(outbox.records)
    publish()
    assert state() == committed and parquet_files(outbox.records) == files
    assert committed[1] == sorted([
        ("oops", 0, "decode_error"), (bad, 2, "actor is required"), (bad, 2, "actor is required"),
        ('{"events":[]}', 0, "events required"),
    ])
    (tmp_path / "in" / "b").write_text(good + "\n")
    publish()
    messages, _, totals = state()
    assert messages == sorted(r["value"] for r in published(read_envelopes(spark, f"{root}/in")).collect())
    assert totals == {
        "documents": 6, "published_documents": 2, "refused_documents": 3, "undecodable_documents": 1,
        "published_events": 4, "refused_events": 4,
    }


def test_the_relay_sends_committed_batches_once(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    outbox = Outbox(f"{root}/records", f"{root}/commits")
    event = '{"actor":"%s","action":"user.create","target_type":"t","scope_type":"s"}'

    def publish(name, **hooks):
        (tmp_path / "in" / name).write_text('{"events":[%s]}\n' % (event % name))
        envelopes = stream_envelopes(spark, f"{root}/in")
        start_outbox(envelopes, outbox, f"{root}/c", available_now=True, **hooks).awaitTermination()

    send, sent = to_text(f"{root}/out"), []

    def failing(messages, batch):
        send(messages, batch)
        sent.append(batch)
        if len(sent) == 1:
            raise RuntimeError("lost")

    def relay():
        start_relay(spark, outbox, f"{root}/r", failing, available_now=True).awaitTermination()

    publish("a")
    with pytest.raises(Exception, match="lost"):
        relay()
    relay()
    publish("b")
    relay()
    assert sent[0] == sent[1] != sent[2]
    lines = sorted(r["value"] for r in spark.read.text(f"{root}/out").collect())
    assert lines == sorted(r["value"] for r in outbox_messages(spark, outbox).collect()) and len(lines) == 2
    records = spark.read.parquet(outbox.records)
    placed = with_place(records).select("value", F.expr("string(headers[0].value)").alias("place"))
    assert placed.select("place").distinct().count() == 2


def test_headers_of_a_broker(spark):
    schema = "value binary, topic string, partition int, offset bigint, headers array<struct<key string, value binary>>"
    cases = [
        (None, None, None), ([], None, None), ([("x-death", b'[{"count":3,"queue":"q"}]')], [3], None),
        ([("x-death", b"[]")], [], None), ([("x-death", b"{oops")], [], None), ([("x-death", None)], [], None),
        ([("x-death", b'[{"queue":"q"}]')], [None], None), ([("redelivered", b"true")], None, True),
        ([("redelivered", b"false"), ("x-death", b'[{"count":1},{"count":9}]')], [1, 9], False),
        ([("redelivered", None)], None, False), ([("x-death", b'[{"count":5}]'), ("x-death", b'[{"count":6}]')], [5], None),
    ]
    rows = [(b"{}", "t", 1, k, headers) for k, (headers, _, _) in enumerate(cases)]
    read = from_kafka(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    for row, (_, counts, redelivered) in zip(read, cases):
        assert (row["x_death"] if row["x_death"] is None else [d["count"] for d in row["x_death"]]) == counts
        assert row["redelivered"] is redelivered and row["source"] == "t/1"
    plain = from_kafka(spark.createDataFrame(rows, schema).drop("headers"))
    assert plain.filter("x_death IS NOT NULL OR redelivered IS NOT NULL").count() == 0
