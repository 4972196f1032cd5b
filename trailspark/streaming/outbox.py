"""Publishing with one commit: messages, refusals and counts of a batch become visible together.

`start_outbox` reads batch documents and writes each micro-batch in one job: every document is
decoded once and becomes either its messages or itself with the reason it was refused, in one
table. The counts are taken from the rows as they are written. Then one small file, the commit,
makes all of it visible; readers go by the commits and never see a batch half written. A batch
that is there is not written again, so a replay leaves the files as they are.

What is committed is sent on by a stream that follows the commits, to any sink: `start_relay`
gives it the messages of the batches committed since, each batch once if the sink keeps what it
was given, at least once if not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.operators.delivery import DECODE_ERROR
from trailspark.operators.render import message_json
from trailspark.schema import EVENT_COLUMNS
from trailspark.session import ensure_session
from trailspark.sources.messages import FILES_PER_TRIGGER
from trailspark.sources.tables import read_or_empty
from trailspark.streaming.ingest import batch_key
from trailspark.streaming.publish import judge

OUTBOX_SCHEMA = (
    "value string, source_file string, position int, n_events bigint, reason string, kind string, batch string"
)
MESSAGE, REFUSED = "message", "refused"
COUNTS = (
    "documents", "published_documents", "refused_documents", "undecodable_documents", "published_events",
    "refused_events",
)
COMMIT_SCHEMA = f"query string, batch_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, batch string"


@dataclass(frozen=True)
class Outbox:
    """`records` holds messages and refusals, `commits` a row of counts per batch."""

    records: str
    commits: str


def outbox_records(envelopes: DataFrame, max_events: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row per message of an admitted document, one per document that is not admitted."""
    judged = judge(envelopes, max_events, max_bytes).select("body", "source_file", "n_events", "reason", "events")
    given = F.col("reason").isNull()
    # a document that is not admitted goes through the same generator as one element without event
    listed = F.when(given, F.col("events")).otherwise(F.array(F.lit(None).cast(judged.schema["events"].dataType.elementType)))
    rows = judged.select("body", "source_file", "n_events", "reason", F.posexplode(listed).alias("position", "event"))
    event = rows.select("body", "source_file", "n_events", "reason", "position", *(F.col(f"event.{c}") for c in EVENT_COLUMNS))
    refused = F.col("reason").isNotNull()
    return event.select(
        F.when(refused, F.col("body")).otherwise(message_json(known_json=True)).alias("value"),
        "source_file", "position", "n_events", "reason",
        F.when(refused, REFUSED).otherwise(MESSAGE).alias("kind"),
    )


def _counts() -> list[Column]:
    """A document is published, refused for a reason, or undecodable.

    Events in a document that cannot be read are not counted, for nobody knows how many.
    """
    reason, first = F.col("reason"), F.col("position") == 0
    other = reason.isNotNull() & (reason != DECODE_ERROR)
    return [
        F.count_if(first).alias("documents"),
        F.count_if(first & reason.isNull()).alias("published_documents"),
        F.count_if(other).alias("refused_documents"),
        F.count_if(reason == DECODE_ERROR).alias("undecodable_documents"),
        F.count_if(reason.isNull()).alias("published_events"),
        F.coalesce(F.sum(F.when(other, F.col("n_events"))), F.lit(0)).alias("refused_events"),
    ]


def write_outbox(
    envelopes: DataFrame, batch_id: int, outbox: Outbox, *, query: str = "publish", max_events: int | None = None,
    max_bytes: int | None = None, before_commit: Callable[[int], None] | None = None,
) -> None:
    """Write one micro-batch and commit it; a batch that is committed already is left alone."""
    spark, batch = envelopes.sparkSession, batch_key(query, batch_id)
    if not read_commits(spark, outbox).filter(F.col("batch") == batch).isEmpty():
        return
    counted = Observation()
    records = outbox_records(envelopes, max_events, max_bytes).observe(counted, *_counts())
    _replace(records.withColumn("batch", F.lit(batch)), outbox.records, "kind", "batch")
    if before_commit:
        before_commit(batch_id)
    counts = counted.get
    row = (query, batch_id, *(counts[c] for c in COUNTS), batch)
    _replace(spark.createDataFrame([row], COMMIT_SCHEMA).coalesce(1), outbox.commits, "batch")


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def start_outbox(
    envelopes: DataFrame,
    outbox: Outbox,
    checkpoint: str,
    *,
    query: str = "publish",
    max_events: int | None = None,
    max_bytes: int | None = None,
    flush_interval: str = "2 seconds",
    available_now: bool = False,
    before_commit: Callable[[int], None] | None = None,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Start the stream from batch documents to the outbox.

    `before_commit` and `after_batch` run around the commit of a batch; what they raise makes
    it replay.
    """
    ensure_session(envelopes.sparkSession)

    def write(df: DataFrame, batch_id: int) -> None:
        write_outbox(
            df, batch_id, outbox, query=query, max_events=max_events, max_bytes=max_bytes, before_commit=before_commit
        )
        if after_batch:
            after_batch(batch_id)

    return _started(envelopes, write, checkpoint, flush_interval, available_now)


def _started(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, flush_interval: str, available_now: bool
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": flush_interval}
    return writer.trigger(**trigger).start()


# --- reading -----------------------------------------------------------------------------


def publish_totals(commits: DataFrame) -> DataFrame:
    """Counters over all batches: one row per outcome."""
    totals = commits.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS))
    return totals.unpivot([], list(COUNTS), "outcome", "n")


def read_commits(spark: SparkSession, outbox: Outbox) -> DataFrame:
    """The publishing ledger: a row per committed batch."""
    return read_or_empty(spark, COMMIT_SCHEMA, outbox.commits)


def read_outbox(spark: SparkSession, outbox: Outbox, kind: str) -> DataFrame:
    """Messages or refusals of the committed batches.

    The commits are the small side, a row per batch; batches without one prune away when that
    side is at hand before the scan.
    """
    records = read_or_empty(spark, OUTBOX_SCHEMA, outbox.records).filter(F.col("kind") == kind)
    return records.join(read_commits(spark, outbox).select("batch"), "batch", "left_semi")


def outbox_messages(spark: SparkSession, outbox: Outbox) -> DataFrame:
    return read_outbox(spark, outbox, MESSAGE).select("value")


def outbox_refusals(spark: SparkSession, outbox: Outbox) -> DataFrame:
    """Documents nothing was taken from, whole: `body, source_file, n_events, reason`."""
    return read_outbox(spark, outbox, REFUSED).select(
        F.col("value").alias("body"), "source_file", "n_events", "reason"
    )


def start_relay(
    spark: SparkSession,
    outbox: Outbox,
    checkpoint: str,
    send: Callable[[DataFrame, str], None],
    *,
    flush_interval: str = "2 seconds",
    available_now: bool = False,
    batches_per_trigger: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """Send the messages of newly committed batches on, in batches of the relay.

    `send` gets messages (`value, batch, source_file, position`) and the name of the relay's
    batch. A relay that fails sends its batch again, with the same messages under the same
    name, so a sink that replaces a name has each message once.
    """
    ensure_session(spark)
    commits = (
        spark.readStream.schema(COMMIT_SCHEMA)
        .option("maxFilesPerTrigger", batches_per_trigger)
        .parquet(outbox.commits)
    )

    def write(df: DataFrame, batch_id: int) -> None:
        names = [r["batch"] for r in df.select("batch").collect()]
        records = read_or_empty(spark, OUTBOX_SCHEMA, outbox.records)
        chosen = records.filter((F.col("kind") == MESSAGE) & F.col("batch").isin(names))
        send(chosen.select("value", "batch", "source_file", "position"), batch_key("relay", batch_id))

    return _started(commits, write, checkpoint, flush_interval, available_now)


def to_text(path: str) -> Callable[[DataFrame, str], None]:
    """Messages as text files, a folder per batch of the relay."""

    def send(messages: DataFrame, batch: str) -> None:
        rows = messages.select("value", F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(path)

    return send


def to_kafka(servers: str, topic: str) -> Callable[[DataFrame, str], None]:
    """Messages to a Kafka topic (needs the connector on the class path).

    Each carries its place in the outbox as a header, by which a consumer can tell a message
    that was sent again.
    """

    def send(messages: DataFrame, batch: str) -> None:
        with_place(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
            "topic", topic
        ).option("includeHeaders", "true").save()

    return send


def with_place(messages: DataFrame) -> DataFrame:
    """`value` and `headers` as the Kafka sink takes them."""
    place = F.concat_ws("/", "batch", F.coalesce("source_file", F.lit("")), F.col("position").cast("string"))
    header = F.struct(F.lit("outbox-place").alias("key"), place.cast("binary").alias("value"))
    return messages.select("value", F.array(header).alias("headers"))
