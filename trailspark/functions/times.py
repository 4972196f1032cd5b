"""RFC 3339 time stamps on the driver and in columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, TimestampNTZType

_RFC3339 = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    r"(\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
)
#: The unset time of the clients; it stands for "not given".
ZERO_TIME = datetime(1, 1, 1, tzinfo=timezone.utc)


def parse_rfc3339(value: str) -> datetime | None:
    """UTC time of an RFC 3339 string, digits beyond microseconds cut; None if it is not one."""
    if not re.fullmatch(_RFC3339, value, flags=re.ASCII):
        return None
    value = re.sub(r"(\.[0-9]{6})[0-9]+", r"\1", value)
    try:
        return datetime.fromisoformat(value).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None


def rfc3339_to_timestamp(value: Column) -> Column:
    """Column form; NULL where the text is not RFC 3339."""
    return F.when(value.rlike(r"\A" + _RFC3339 + r"\z"), value.try_cast("timestamp"))


def utc_clock(value: Column) -> Column:
    """The UTC time without a zone, whatever the time zone of the session.

    Times without a zone are UTC already. The type is known when the query is planned, so one
    branch stays.
    """
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    shifted = F.timestamp_add("MICROSECOND", F.unix_micros(value.cast("timestamp")), epoch)
    return F.when(F.typeof(value) == "timestamp_ntz", value.cast("timestamp_ntz")).otherwise(shifted)


def utc_date(value: Column) -> Column:
    return utc_clock(value).cast("date")


def utc_hour_start(value: Column, kind: DataType) -> Column:
    """The start of the hour, a time of the same type `kind`."""
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_add("HOUR", F.hour(value), value.cast("date").cast("timestamp_ntz"))
    micros = F.unix_micros(value)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(3_600_000_000)))


def timestamp_to_rfc3339(value: Column) -> Column:
    """UTC text with the trailing zeros of the fraction cut, as in `2026-05-17T12:00:00.25Z`."""
    return F.concat(F.translate(utc_clock(value).cast("string"), " ", "T"), F.lit("Z"))


def as_utc(value: datetime) -> datetime:
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def time_literal(value: datetime, like: DataType) -> Column:
    """Literal of the column's own type, so that a comparison reaches the Parquet scan."""
    naive = as_utc(value).replace(tzinfo=None)
    if isinstance(like, TimestampNTZType):
        return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(naive.isoformat(sep=" ") + "Z").cast("timestamp")


def floor_hour(value: datetime) -> datetime:
    return value.replace(minute=0, second=0, microsecond=0)


def minus(value: datetime, delta: timedelta) -> datetime | None:
    """`value - delta`, or None before the first representable time."""
    try:
        return value - delta
    except OverflowError:
        return None
