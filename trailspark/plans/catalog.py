"""Every operator as a query over the test data: `(spark, sf_dir) -> DataFrame`.

Queries of sources, sinks and streams first write what they read (messages, deliveries, the
event table) from the `events` table, all of it, into the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from trailspark.functions.category import category_column
from trailspark.functions.cursor import cursor_column, cursor_id, cursor_time, encode_cursor
from trailspark.functions.identity import event_id
from trailspark.functions.once import compute_once
from trailspark.functions.status import http_status
from trailspark.functions.times import timestamp_to_rfc3339
from trailspark.functions.values import clean_values_column
from trailspark.operators.admission import (
    MAX_RPC_EVENTS,
    admit_envelopes,
    admitted_events,
    batch_decisions,
    reject_reason,
    with_reason,
)
from trailspark.operators.delivery import death_count, decode_messages, is_poison
from trailspark.operators.filters import EventFilter, filter_events
from trailspark.operators.groups import (
    bucket_histogram,
    fetch_groups,
    group_events,
    merge_groups,
    top_groups,
)
from trailspark.operators.listing import export_trail, fetch_page, list_columns, list_events
from trailspark.operators.normalize import map_wire, normalize
from trailspark.operators.render import encode_messages, event_json, group_json
from trailspark.plans.audit_view import audit_events, deliveries, intake, table_events
from trailspark.schema import EVENT_COLUMNS, GROUP_KEYS, GROUP_MEASURES, GROUP_SCHEMA, PAYLOADS, STORED_COLUMNS
from trailspark.session import ensure_session, shared_dir
from trailspark.sinks.dead_letters import read_dead_letters, write_dead_letters
from trailspark.sinks.events import append_events, compact_days
from trailspark.sinks.ledger import batch_size_histogram, ledger_totals, read_ledger
from trailspark.sinks.messages import write_messages
from trailspark.sinks.layout import by_lookup
from trailspark.sinks.trail import compact_trail
from trailspark.sources.envelopes import decode_envelopes, explode_events, read_envelopes, stream_envelopes
from trailspark.sources.events import read_events, read_rollup
from trailspark.sources.messages import COORDINATES, from_files, from_kafka, from_text, stream_files
from trailspark.sources.trail import TrailTables, read_trail
from trailspark.streaming.ingest import IngestTables, start_ingest
from trailspark.streaming.outbox import (
    Outbox,
    outbox_refusals,
    publish_totals,
    read_commits,
    start_outbox,
    start_relay,
    to_text,
)
from trailspark.streaming.publish import refused, start_publish

Query = Callable[[SparkSession, str], DataFrame]

# What the queries ask for; `oracle.py` states the same in SQL.
SINCE = datetime(2024, 1, 5, 6, 0, tzinfo=timezone.utc)
UNTIL = datetime(2024, 1, 20, 18, 30, tzinfo=timezone.utc)
NEWEST = datetime(2024, 1, 31, tzinfo=timezone.utc)
CURSOR = (datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc), "00000000-0000-0000-0000-000000004900")
ARRIVAL = "2024-02-01 00:00:00"
STATUS_BOUNDS = (99, 199, 299, 399, 499)

FILTERS: dict[str, EventFilter] = {
    "f_service": EventFilter(service="web-svc"),
    "f_scope": EventFilter(scope_type="tenant", scope_id="tenant-1"),
    "f_actor": EventFilter(actor="  user-1 ", scope_id="  "),
    "f_action": EventFilter(action="user.create"),
    "f_category": EventFilter(category="sensitive_read"),
    "f_category_router": EventFilter(category="router_access"),
    "f_target": EventFilter(target_type="order", target_id="t-2"),
    "f_request": EventFilter(request_id="req-77"),
    "f_exclude_category": EventFilter(exclude_categories=["system", " business_mutation ,system"]),
    "f_exclude_service": EventFilter(exclude_services=["gateway", " web-svc ,"]),
    "f_exclude_action": EventFilter(exclude_actions=["ui.click,report.view", "POST /checkout"]),
    "f_time": EventFilter(since=SINCE, until=UNTIL),
    "f_status": EventFilter(status_min=200, status_max=399),
    "f_status_min": EventFilter(status_min=400),
    "f_status_max": EventFilter(status_max=199),
    "f_cursor": EventFilter(cursor=encode_cursor(*CURSOR)),
    "f_bad_cursor": EventFilter(cursor="bm90IGEgY3Vyc29y", service="gateway"),
    "f_params": EventFilter.from_params(
        {
            "scope_type": [" tenant", "platform"], "status_min": ["400"], "status_max": ["9" * 5000],
            "exclude_service": ["gateway"], "exclude_service[]": ["orders-svc, "], "exclude_services": ["x"],
            "since": ["2024-01-05T08:00:00+02:00"], "until": ["tomorrow"], "limit": ["ten"], "cursor": ["?"],
        }
    ),
    "f_combined": EventFilter(
        scope_type="tenant", actor="user-0", exclude_services=["orders-svc"], status_min=200, status_max=499,
        since=SINCE, until=UNTIL, cursor=encode_cursor(*CURSOR),
    ),
}
PAGED = EventFilter(category="security_change", limit=100)
PAGE_LIMITS = (-1, 0, 1, 100, 101)
BATCH_CUTS = (4, 40, 120, 400, 900)


def plain_times(df: DataFrame) -> DataFrame:
    """Time stamps without a zone, as the `events` table has them."""
    times = [f.name for f in df.schema if isinstance(f.dataType, TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table several queries read, written by the first that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table holding the audit events, times cut to minutes."""
    path = _once(
        spark, sf_dir, "events",
        lambda p: append_events(table_events(spark, sf_dir, minutes=True), p, "load"),
    )
    return read_events(spark, path, status_stored=True)


def delivery_files(spark: SparkSession, sf_dir: str) -> str:
    """Delivery files in event order, two per core: a stream over them has several batches."""

    def write(path: str) -> None:
        files = 2 * spark.sparkContext.defaultParallelism
        deliveries(spark, sf_dir).repartitionByRange(files, "event_id").write.parquet(path)

    return _once(spark, sf_dir, "deliveries", write)


def envelope_files(spark: SparkSession, sf_dir: str) -> str:
    """Batch documents of 25 events, some null, some batches empty or cut short."""
    number = F.col("event_id")
    broken = (number % 59 == 0) | (number % 61 == 0)
    event = F.struct(
        *(timestamp_to_rfc3339(F.col(c)).alias(c) if c == "created_at" else F.col(c)
          for c in EVENT_COLUMNS if c not in PAYLOADS),
        F.when(~broken, F.try_parse_json("metadata")).alias("metadata"),
    )
    # the payload with long numbers goes in as text
    given = F.regexp_replace(F.to_json(event), r"\}\z", "")
    whole = F.concat(F.concat_ws(',"before_state":', given, "before_state"), F.lit("}"))
    text = F.when(number % 97 == 0, "null").otherwise(whole)
    batch = F.expr("event_id div 25")

    def write(path: str) -> None:
        batches = intake(spark, sf_dir).groupBy(batch.alias("batch")).agg(
            F.sort_array(F.collect_list(F.struct(number, text.alias("text")))).alias("list")
        )
        listed = F.array_join(F.transform("list", lambda e: e["text"]), ",")
        body = F.concat(F.lit('{"events":['), F.when(F.col("batch") % 20 == 3, "").otherwise(listed), F.lit("]}"))
        cut = F.length(body) - F.when(F.col("batch") % 20 == 7, 2).otherwise(0)
        batches.select(F.substring(body, F.lit(1), cut)).write.text(path)

    return _once(spark, sf_dir, "envelopes", write)


def message_files(spark: SparkSession, sf_dir: str) -> str:
    """The audit events as queue messages, one per line."""
    return _once(spark, sf_dir, "messages", lambda p: write_messages(table_events(spark, sf_dir), p))


# --- sources, sinks, table ---------------------------------------------------------------


def src_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelopes = read_envelopes(spark, envelope_files(spark, sf_dir), numbered=False)
    admitted = admit_envelopes(decode_envelopes(envelopes))
    return plain_times(explode_events(admitted).drop("source_file", "source_row"))


def map_wire_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = (
        intake(spark, sf_dir)
        .withColumnRenamed("created_at", "timestamp")
        .withColumns({c: F.col(c).cast("binary") for c in PAYLOADS})
    )
    return map_wire(wire, F.lit(ARRIVAL).cast("timestamp_ntz")).withColumn("reason", reject_reason()).drop("batch_id")


def src_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_messages(from_text(spark, message_files(spark, sf_dir), numbered=False))
    events = normalize(decoded.select("event.*", "dead_reason"), F.lit(ARRIVAL).cast("timestamp"))
    return plain_times(events)


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one file, read in many splits, with their numbers and ids."""

    def write(path: str) -> None:
        ordered = table_events(spark, sf_dir).orderBy("event_id").coalesce(1).sortWithinPartitions("event_id")
        encode_messages(ordered).write.text(path)

    path, numbered = _once(spark, sf_dir, "one-file", write), scratch(spark, "numbered")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = from_text(spark, path)
        lines.select("position", "body", event_id(F.lit("one-file"), "position").alias("id")).write.parquet(numbered)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.parquet(numbered)


def encoded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_messages(table_events(spark, sf_dir))


def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(event_table(spark, sf_dir))


def compacted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a time range rewritten into another table."""
    target = scratch(spark, "compacted")
    source = scratch(spark, "landed")
    append_events(table_events(spark, sf_dir), source, "load")
    compact_days(spark, source, target, SINCE, UNTIL)
    return plain_times(read_events(spark, target, status_stored=True))


def trail(spark: SparkSession, sf_dir: str) -> TrailTables:
    """The audit events in four loads, compacted twice in between.

    Days of the first compaction get events later; the second takes some of these days in again
    and lays them out for look-ups; the last load is in no compacted file.
    """

    def write(root: str) -> None:
        tables = _trail_tables(root)
        events = table_events(spark, sf_dir)
        load = F.col("event_id") % 4
        for n in range(4):
            append_events(events.filter(load == n), tables.landed, f"load-{n:012d}")
            if n == 1:
                compact_trail(spark, tables, SINCE.date(), UNTIL.date())
            if n == 2:
                compact_trail(spark, tables, date(2024, 1, 10), date(2024, 1, 25), layout=by_lookup)

    return _trail_tables(_once(spark, sf_dir, "trail", write))


def _trail_tables(root: str) -> TrailTables:
    return TrailTables(f"{root}/landed", f"{root}/compacted", f"{root}/commits", f"{root}/lookups")


def trail_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_trail(spark, trail(spark, sf_dir))
    return plain_times(events.select(*STORED_COLUMNS, "http_status", "created_date"))


def trail_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one request, from the files the look-up index names and what has landed since."""
    flt = FILTERS["f_request"]
    events = read_trail(spark, trail(spark, sf_dir), lookup=("request_id", flt.request_id))
    return plain_times(list_columns(filter_events(events, flt)))


def trail_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page across landed files and both layouts."""
    events = read_trail(spark, trail(spark, sf_dir), UNTIL.date() - timedelta(days=7), UNTIL.date())
    flt = EventFilter(scope_type="tenant", scope_id="tenant-1", until=UNTIL, limit=100)
    return plain_times(fetch_page(events, flt).to_df(spark))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "dead")
    decoded = decode_messages(from_files(spark, delivery_files(spark, sf_dir)))
    write_dead_letters(decoded, path, "load")
    return read_dead_letters(spark, path).select("reason", "body", death_count().alias("deaths"), "redelivered")


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose first files lack the three columns added later."""
    path = scratch(spark, "evolved")
    events = table_events(spark, sf_dir).withColumns(
        {"created_date": F.to_date("created_at"), "batch": F.lit("load")}
    )
    old = events.filter("event_id % 2 = 0").drop("service", "request_id", "client_ip", "event_id")
    for part in (old, events.filter("event_id % 2 = 1").drop("event_id")):
        part.write.mode("append").partitionBy("created_date", "batch").parquet(path)
    kept = filter_events(
        read_events(spark, path), EventFilter(exclude_services=["web-svc"], status_min=200)
    )
    return plain_times(list_columns(kept))


def events_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads are computed before the checks, which mention each several times."""
    events = audit_events(spark, sf_dir).withColumnsRenamed({c: f"given_{c}" for c in PAYLOADS})
    events = compute_once(events, **{c: F.col(f"given_{c}") for c in PAYLOADS})
    return list_columns(events).select("id", event_json().alias("json"))


def groups_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_events(audit_events(spark, sf_dir)).select(group_json().alias("json"))


# --- derived columns ---------------------------------------------------------------------


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select("id", category_column().alias("category"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_events(spark, sf_dir).select("id", http_status().alias("status"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(intake(spark, sf_dir), F.lit(ARRIVAL).cast("timestamp_ntz")).select(*STORED_COLUMNS)


def assigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", event_id(F.lit("events"), "event_id").alias("id"))


# --- filters and admission ---------------------------------------------------------------


def filtered(flt: EventFilter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return list_columns(filter_events(audit_events(spark, sf_dir), flt))

    return run


def table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status filter on the event table, which stores the status beside the payload."""
    return plain_times(list_columns(filter_events(event_table(spark, sf_dir), FILTERS["f_status"])))


def table_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(group_events(event_table(spark, sf_dir)))


def cleaned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw filter values made of two columns of each event, cleaned."""
    raw = F.array(
        F.concat(F.lit("\t"), "service", F.lit(" , ,"), "actor"),
        F.concat("actor", F.lit(", "), "service", F.lit(", "), "target_id"),
    )
    cleaned = clean_values_column(raw)
    return audit_events(spark, sf_dir).select("id", F.array_join(cleaned, "|").alias("cleaned"))


def valid_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake(spark, sf_dir).filter(reject_reason().isNull()).select("id", "actor", "action")


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events are refused, by reason; the encoding is tried on valid ones only."""
    refused = with_reason(intake(spark, sf_dir)).filter("reason IS NOT NULL")
    return refused.groupBy("reason").agg(F.count("*").alias("n"))


def admitted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_decisions(intake(spark, sf_dir), "batch_id", "event_id", MAX_RPC_EVENTS)


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted_events(intake(spark, sf_dir), "batch_id", "event_id").select("batch_id", "id")


def poison_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).select(
        "event_id", death_count().cast("bigint").alias("deaths"), is_poison(3).alias("poison")
    )


def kafka_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from records of a broker, which hold the earlier attempts in their headers."""
    header = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("binary").alias("value"))
    records = deliveries(spark, sf_dir).select(
        F.col("body").cast("binary").alias("value"),
        F.lit("audit").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.filter(
            F.array(
                header("trace", F.lit("x")),
                F.when(F.col("x_death").isNotNull(), header("x-death", F.to_json("x_death"))),
                F.when(F.col("redelivered"), header("redelivered", F.lit("true"))),
            ),
            lambda h: h.isNotNull(),
        ).alias("headers"),
    )
    return from_kafka(records).select(
        F.col("position").alias("event_id"), death_count().cast("bigint").alias("deaths"), is_poison(3).alias("poison")
    )


# --- list, pages, groups -----------------------------------------------------------------


def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_events(audit_events(spark, sf_dir, minutes=True), PAGED)


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = fetch_page(event_table(spark, sf_dir), PAGED, newest=NEWEST)
    return plain_times(page.to_df(spark)).withColumn("next_cursor", F.lit(page.next_cursor))


def page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_table(spark, sf_dir)
    first = fetch_page(events, PAGED, newest=NEWEST)
    after = EventFilter(category=PAGED.category, limit=100, cursor=first.next_cursor or "")
    return plain_times(fetch_page(events, after).to_df(spark))


def page_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a rare lookup, whose events lie far apart."""
    return plain_times(fetch_page(event_table(spark, sf_dir), FILTERS["f_request"]).to_df(spark))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for limits in and out of range, each with the row that says more follow."""
    events = audit_events(spark, sf_dir, minutes=True)
    pages = [
        list_events(events, EventFilter(limit=limit)).select(F.lit(limit).alias("asked"), "id", "created_at")
        for limit in PAGE_LIMITS
    ]
    return reduce(DataFrame.unionAll, pages)


def cursor_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = audit_events(spark, sf_dir).select("id", cursor_column().alias("cursor"))
    return plain_times(
        coded.select(
            "id", "cursor", cursor_time("cursor").alias("decoded_time"), cursor_id("cursor").alias("decoded_id")
        )
    )


def exported_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    export_trail(event_table(spark, sf_dir), path, EventFilter(exclude_categories=["system"]))
    return plain_times(spark.read.parquet(path))


def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    flt = EventFilter(limit=100, cursor=encode_cursor(*CURSOR))
    return top_groups(audit_events(spark, sf_dir), flt)


def group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    flt = EventFilter(limit=100, until=UNTIL, exclude_categories=["system"])
    rows = fetch_groups(event_table(spark, sf_dir), flt)
    return plain_times(spark.createDataFrame(rows, GROUP_SCHEMA))


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_events(audit_events(spark, sf_dir))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = audit_events(spark, sf_dir).select(http_status().alias("status"))
    return bucket_histogram(statuses, "status", STATUS_BOUNDS)


# --- streams -----------------------------------------------------------------------------


class _Lost(RuntimeError):
    pass


def _replayed(run: Callable[[Callable[[int], None] | None], None], fail_after: int) -> None:
    """Run a stream that stops between the writes of a batch and its commit, and once more."""

    def lose(batch_id: int) -> None:
        if batch_id == fail_after:
            raise _Lost(f"batch {batch_id}")

    try:
        run(lose)
    except Exception as error:
        if _Lost.__name__ not in str(error):
            raise
    run(None)


def run_ingest(
    spark: SparkSession, sf_dir: str, fail_after: int | None = None,
    *, source: str | None = None, files: int | None = None, names: tuple[str, ...] = ("ingest",),
) -> IngestTables:
    """Stream all deliveries, in two micro-batches unless the files of one are given.

    With `fail_after` the stream stops once between the writes of that batch and its commit
    and is started again.
    """
    root = scratch(spark, "ingest")
    tables = IngestTables(
        f"{root}/events", f"{root}/dead", f"{root}/ledger", f"{root}/rollup",
        f"{root}/ranges" if len(names) > 1 else None,
    )
    source = source or delivery_files(spark, sf_dir)
    files = files or max(1, len(spark.read.parquet(source).inputFiles()) // 2)

    def run(after_batch: Callable[[int], None] | None) -> None:
        for name in names:
            stream = stream_files(spark, source, max_files_per_trigger=files)
            start_ingest(
                stream, tables, f"{root}/checkpoint-{name}", query=name, available_now=True, after_batch=after_batch
            ).awaitTermination()

    if fail_after is None:
        run(None)
    else:
        _replayed(run, fail_after)
    return tables


def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch documents published as messages by a stream, and the messages decoded."""
    root = scratch(spark, "publish")
    envelopes = stream_envelopes(spark, envelope_files(spark, sf_dir))
    start_publish(envelopes, f"{root}/messages", f"{root}/checkpoint", available_now=True).awaitTermination()
    decoded = decode_messages(from_text(spark, f"{root}/messages", numbered=False)).select("event.*", "dead_reason")
    return plain_times(normalize(decoded, F.lit(ARRIVAL).cast("timestamp")))


def refused_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = refused(read_envelopes(spark, envelope_files(spark, sf_dir), numbered=False)).groupBy("reason", "n_events")
    return counted.agg(F.count("*").alias("n"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = run_ingest(spark, sf_dir)
    return plain_times(read_events(spark, tables.events).select(*EVENT_COLUMNS))


def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = run_ingest(spark, sf_dir, fail_after=1)
    return plain_times(read_events(spark, tables.events).select(*EVENT_COLUMNS))


def reread_under_another_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same deliveries read by two streams with checkpoints of their own."""
    tables = run_ingest(spark, sf_dir, names=("ingest", "again"))
    return plain_times(read_events(spark, tables.events).select(*EVENT_COLUMNS))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = run_ingest(spark, sf_dir, fail_after=0)
    return plain_times(merge_groups(read_rollup(spark, tables.rollup)))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_totals(read_ledger(spark, run_ingest(spark, sf_dir, fail_after=1).ledger))


def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of micro-batches of one file each, the deliveries cut into files by their number."""
    number = F.col("event_id")
    cut = F.lit(len(BATCH_CUTS)) + number % 3
    for place, end in reversed(list(enumerate(BATCH_CUTS))):
        cut = F.when(number < end, place).otherwise(cut)
    source = scratch(spark, "cut")
    cuts = deliveries(spark, sf_dir).withColumn("cut", cut).repartition("cut")
    cuts.write.partitionBy("cut").parquet(source)
    tables = run_ingest(spark, sf_dir, source=source, files=1)
    return batch_size_histogram(read_ledger(spark, tables.ledger))


def run_outbox(spark: SparkSession, sf_dir: str) -> Outbox:
    """Publish all batch documents in two micro-batches, each of which fails once.

    The first stops between its writes and its commit, the second after its commit.
    """

    def write(root: str) -> None:
        outbox = Outbox(f"{root}/records", f"{root}/commits")
        source = envelope_files(spark, sf_dir)
        files = max(1, len(spark.read.text(source).inputFiles()) // 2)

        def run(point: str, fail: Callable[[int], None] | None) -> None:
            start_outbox(
                stream_envelopes(spark, source, max_files_per_trigger=files), outbox, f"{root}/checkpoint",
                available_now=True, **{point: fail},
            ).awaitTermination()

        _replayed(lambda fail: run("before_commit", fail) if fail else None, 0)
        _replayed(lambda fail: run("after_batch", fail), 1)

    root = _once(spark, sf_dir, "outbox", write)
    return Outbox(f"{root}/records", f"{root}/commits")


def publish_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refused documents set aside, by reason; bodies are those of the documents."""
    aside = outbox_refusals(spark, run_outbox(spark, sf_dir))
    given = read_envelopes(spark, envelope_files(spark, sf_dir), numbered=False).select("body").distinct()
    known = aside.join(given, "body", "left_semi")
    return known.groupBy("reason", "n_events").agg(F.count("*").alias("n"))


def publish_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish_totals(read_commits(spark, run_outbox(spark, sf_dir)))


def stream_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed messages sent on by a stream, commit by commit, and decoded."""
    root = scratch(spark, "relay")
    start_relay(
        spark, run_outbox(spark, sf_dir), f"{root}/checkpoint", to_text(f"{root}/messages"),
        available_now=True, batches_per_trigger=1,
    ).awaitTermination()
    decoded = decode_messages(from_text(spark, f"{root}/messages", numbered=False)).select("event.*", "dead_reason")
    return plain_times(normalize(decoded, F.lit(ARRIVAL).cast("timestamp")))


QUERIES: dict[str, Query] = {
    "src_envelope": src_envelope,
    "map_wire": map_wire_records,
    "src_messages": src_messages,
    "line_numbers": line_numbers,
    "encode_messages": encoded_messages,
    "append_events": appended_events,
    "compact_days": compacted_days,
    "trail_after_compaction": trail_after_compaction,
    "trail_lookup": trail_lookup,
    "trail_page": trail_page,
    "dead_letter": dead_letters,
    "schema_evolution": schema_evolution,
    "event_json": events_as_json,
    "group_json": groups_as_json,
    "category": category,
    "category_counts": category_counts,
    "http_status": status,
    "normalize": normalized,
    "assign_id": assigned_ids,
    **{name: filtered(flt) for name, flt in FILTERS.items()},
    "table_status": table_status,
    "clean_values": cleaned_values,
    "validate": valid_events,
    "reject_reasons": reject_reasons,
    "admit_batches": admitted_batches,
    "admitted_events": admitted,
    "poison_split": poison_split,
    "kafka_poison": kafka_poison,
    "event_list": event_list,
    "event_page": event_page,
    "page_after_cursor": page_after_cursor,
    "page_by_request": page_by_request,
    "page_sizes": page_sizes,
    "cursor_codec": cursor_codec,
    "export_trail": exported_trail,
    "event_groups": event_groups,
    "group_page": group_page,
    "hourly_rollup": hourly_rollup,
    "table_rollup": table_rollup,
    "bucket_histogram": status_histogram,
    "stream_publish": stream_publish,
    "refused_envelopes": refused_envelopes,
    "stream_ingest": stream_ingest,
    "replay_idempotent": replay_idempotent,
    "reread_under_another_name": reread_under_another_name,
    "stream_rollup": stream_rollup,
    "ledger": ledger,
    "batch_sizes": batch_sizes,
    "publish_refused": publish_refused,
    "publish_ledger": publish_ledger,
    "stream_relay": stream_relay,
}


def query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](ensure_session(spark), sf_dir)

    return run
