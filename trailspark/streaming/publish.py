"""From batch documents to queue messages.

`published` and `refused` are plain transformations, for tables and streams alike. A stream
that writes text files keeps a log of them, and a stream that reads the folder follows that
log, so every message reaches the ingest stream once. That log has no room for refusals and
counts; `outbox.py` publishes with those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.operators.admission import admit_envelopes
from trailspark.operators.delivery import DECODE_ERROR
from trailspark.operators.render import encode_messages
from trailspark.session import ensure_session
from trailspark.sources.envelopes import decode_envelopes, explode_events


#: Why a document is refused before it is decoded.
BODY_TOO_LARGE = "body too large"


def judge(envelopes: DataFrame, max_events: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Decoded envelopes with the `reason` they are refused for, NULL for an admitted one.

    A document of more than `max_bytes` has a reason of its own and is not decoded.
    """
    too_large = F.lit(False) if max_bytes is None else F.coalesce(F.octet_length("body") > max_bytes, F.lit(False))
    given = envelopes.withColumn("_whole", F.col("body")).withColumn("body", F.when(~too_large, F.col("body")))
    admitted = admit_envelopes(decode_envelopes(given), max_events)
    reason = F.when(too_large, F.lit(BODY_TOO_LARGE)).when(F.col("decode_error"), F.lit(DECODE_ERROR)).otherwise(F.col("reason"))
    return admitted.withColumn("body", F.col("_whole")).withColumn("reason", reason).drop("_whole")


def published(envelopes: DataFrame, max_events: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """`value`: one message per event of the admitted envelopes.

    Their payloads have just been rendered from parsed JSON and are not checked again.
    """
    admitted = judge(envelopes, max_events, max_bytes).filter("reason IS NULL")
    return encode_messages(explode_events(admitted.drop("reason")), known_json=True)


def refused(envelopes: DataFrame, max_events: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The envelopes nothing was taken from: `body, n_events, reason`."""
    return judge(envelopes, max_events, max_bytes).filter("reason IS NOT NULL").select("body", "n_events", "reason")


def start_publish(
    envelopes: DataFrame,
    path: str,
    checkpoint: str,
    *,
    max_events: int | None = None,
    max_bytes: int | None = None,
    flush_interval: str = "2 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Start the stream from envelopes to message files, one JSON message per line."""
    ensure_session(envelopes.sparkSession)
    writer = (
        published(envelopes, max_events, max_bytes)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": flush_interval}
    return writer.trigger(**trigger).start()
