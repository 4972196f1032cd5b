"""Queue deliveries: redelivery counts, poison messages, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailspark.functions.numbers import number_tag
from trailspark.functions.once import compute_once
from trailspark.operators.decode import event_struct, event_time, has_wrong_type, parse_event

# Why a delivery is set aside, and the default limit of redeliveries.
MAX_REDELIVERIES = "max_redeliveries"
DECODE_ERROR = "decode_error"
DEFAULT_MAX_REDELIVERIES = 3


def death_count(x_death: Column | str = "x_death", redelivered: Column | str = "redelivered") -> Column:
    """Count of the first `x-death` entry; without the header, 1 for a redelivered message.

    A header that is there but holds no count reads 0.
    """
    x_death = F.col(x_death) if isinstance(x_death, str) else x_death
    redelivered = F.col(redelivered) if isinstance(redelivered, str) else redelivered
    first = F.coalesce(F.get(x_death, F.lit(0))["count"], F.lit(0))
    return F.when(x_death.isNotNull(), first).when(redelivered, F.lit(1)).otherwise(F.lit(0))


def is_poison(max_redeliveries: int) -> Column:
    """True when a delivery came back too often; a limit of 0 or less is no limit."""
    return death_count() >= max_redeliveries if max_redeliveries > 0 else F.lit(False)


def decode_messages(deliveries: DataFrame, max_redeliveries: int = DEFAULT_MAX_REDELIVERIES) -> DataFrame:
    """Adds `event` (typed struct) and `dead_reason` (NULL = good) to deliveries.

    Redeliveries are judged before the body is looked at. A good event is not validated
    again: it was when it was let in.
    """
    body, tag, parsed, time = F.col("body"), F.col("_tag"), F.col("_parsed"), F.col("_time")
    tags = deliveries.withColumn("_tag", number_tag(body))
    read = tags.withColumn("_parsed", parse_event(body, tag)).withColumn("_time", event_time(parsed))
    undecodable = parsed.isNull() | has_wrong_type(parsed, time, tag)
    reason = F.when(is_poison(max_redeliveries), F.lit(MAX_REDELIVERIES)).when(
        undecodable, F.lit(DECODE_ERROR)
    )
    decoded = compute_once(read, dead_reason=reason, event=event_struct(parsed, time, tag))
    return decoded.drop("_tag", "_parsed", "_time")
