"""Which events and batches are let in."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.once import compute_once
from trailspark.functions.payload import is_strict_json
from trailspark.schema import PAYLOADS, REQUIRED_TEXT

# What a refused event or batch is told, and the largest remote-call batch.
NIL_EVENT = "nil event"
EVENTS_REQUIRED = "events required"
ENCODE_ERROR = "encode_error"
MAX_RPC_EVENTS = 1000

_REQUIRED = tuple(f"{c} is required" for c in REQUIRED_TEXT)

#: A batch with more than one in this many of all events is heavy: at most as many are.
HEAVY_SHARE = 1000


def reject_reason(event: Column | None = None) -> Column:
    """The first missing required field, NULL for a valid event.

    Works on a struct column, which may be NULL, or without one on the columns of a table.
    Text is not trimmed: a blank is a value.
    """
    value = F.col if event is None else event.getField
    reason = _first_missing(value, _REQUIRED)
    return reason if event is None else F.when(event.isNull(), F.lit(NIL_EVENT)).otherwise(reason)


def _first_missing(value: Callable[[str], Column], labels: Sequence) -> Column:
    """The label of the first required field that is missing or empty, NULL if none is."""
    return F.coalesce(
        *(F.when(F.coalesce(value(c), F.lit("")) == "", F.lit(label)) for c, label in zip(REQUIRED_TEXT, labels))
    )


def encode_reason() -> Column:
    """`encode_error` when a payload that is given is not JSON, else NULL."""
    broken = [(F.coalesce(F.col(c), F.lit("")) != "") & ~is_strict_json(c) for c in PAYLOADS]
    return F.when(reduce(lambda a, b: a | b, broken), F.lit(ENCODE_ERROR))


def with_reason(events: DataFrame) -> DataFrame:
    """Adds `reason`: why an event is refused when let in or when encoded, NULL for a good one."""
    return compute_once(events, reason=F.coalesce(reject_reason(), encode_reason()))


def batch_reason(n_events: Column, first_reason: Column, max_events: int | None) -> Column:
    """Why a batch is refused as a whole: empty, too large, or its first invalid event."""
    reason = F.when(n_events == 0, F.lit(EVENTS_REQUIRED))
    if max_events is not None:
        too_large = F.concat(
            F.lit("batch size "), n_events.cast("string"), F.lit(f" exceeds maximum {max_events}")
        )
        reason = reason.when(n_events > max_events, too_large)
    return reason.otherwise(first_reason)


def admit_envelopes(envelopes: DataFrame, max_events: int | None = None) -> DataFrame:
    """Adds `n_events` and `reason` (NULL = admitted) to rows holding an `events` array.

    The whole batch is in its row, so nothing moves between tasks.
    """
    n_events = F.coalesce(F.array_size("events"), F.lit(0)).cast("bigint")
    first = F.get(F.filter(F.transform("events", reject_reason), lambda r: r.isNotNull()), F.lit(0))
    return envelopes.withColumn("n_events", n_events).withColumn(
        "reason", batch_reason(F.col("n_events"), first, max_events)
    )


def batch_decisions(
    events: DataFrame, batch: str, position: str, max_events: int | None = None
) -> DataFrame:
    """`batch, n_events, reason` per batch of a flat table of events.

    Count and first reason combine before the shuffle, so a batch that holds a large part of
    the table costs one row per task. Reasons travel as numbers: with text in its state the
    aggregation would sort all events instead of hashing them.
    """
    number = _first_missing(F.col, range(len(_REQUIRED)))
    decided = events.groupBy(batch).agg(
        F.count("*").alias("n_events"),
        F.min_by(number, F.when(number.isNotNull(), F.col(position))).alias("first"),
    )
    first = F.get(F.array(*(F.lit(r) for r in _REQUIRED)), F.col("first"))
    return decided.select(batch, "n_events", batch_reason(F.col("n_events"), first, max_events).alias("reason"))


def heavy_batches(decisions: DataFrame, batch: str) -> DataFrame:
    """`batch, pieces` of the batches that hold more than one in `HEAVY_SHARE` of all events.

    There are fewer than `HEAVY_SHARE` of them, whatever the data. A piece has about one in
    `HEAVY_SHARE` of all events.
    """
    total = decisions.agg(F.sum("n_events").alias("total")).scalar()
    heavy = decisions.filter(F.col("n_events") * HEAVY_SHARE > total)
    pieces = F.ceil(F.col("n_events") * HEAVY_SHARE / total).cast("int")
    return heavy.select(F.col(batch).alias("_heavy"), pieces.alias("_pieces"))


def admitted_events(events: DataFrame, batch: str, position: str, max_events: int | None = None) -> DataFrame:
    """Events of the admitted batches of a flat table.

    Refused batches are the small side, yet one of them may hold a third of the events. Heavy
    batches are known from their exact counts before the match, and each is matched in as many
    pieces as its size asks for; all others are matched whole and copied nowhere. The list of
    heavy batches has a fixed bound, so it is broadcast; whether the refused batches are is left
    to Spark, which knows their size at run time.
    """
    decisions = batch_decisions(events, batch, position, max_events)
    heavy = heavy_batches(decisions, batch)
    refused = decisions.filter("reason IS NOT NULL").select(F.col(batch).alias("_batch"))
    # events without a batch are a batch too, so null matches null
    refused = refused.join(F.broadcast(heavy), F.col("_batch").eqNullSafe(F.col("_heavy")), "left").select(
        "_batch", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)).alias("_piece")
    )
    salted = events.join(F.broadcast(heavy), F.col(batch).eqNullSafe(F.col("_heavy")), "left").select(
        *events.columns,
        F.pmod(F.xxhash64(position), F.coalesce("_pieces", F.lit(1))).cast("int").alias("_salt"),
    )
    same = F.col(batch).eqNullSafe(F.col("_batch")) & (F.col("_salt") == F.col("_piece"))
    return salted.join(refused, same, "left_anti").drop("_salt")
