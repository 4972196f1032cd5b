"""Publishing events as queue messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.operators.admission import encode_reason
from trailspark.operators.render import encode_messages


def split_encodable(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events whose payloads encode, the others with their `reason`)."""
    marked = compute_once(events, reason=encode_reason())
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def write_messages(events: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON message per line."""
    encode_messages(events).write.mode(mode).text(path)


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """To a Kafka topic (needs the connector on the class path)."""
    (
        encode_messages(events)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
