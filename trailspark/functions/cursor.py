"""The opaque list cursor: URL-safe base64 of `<epoch micros>|<id>`."""

from __future__ import annotations

import base64
import binascii
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from trailspark.functions.times import as_utc

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def from_micros(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


def encode_cursor(created_at: datetime, event_id: str) -> str:
    micros = (as_utc(created_at) - _EPOCH) // timedelta(microseconds=1)
    return base64.urlsafe_b64encode(f"{micros}|{event_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    """(created_at, id), or ValueError."""
    try:
        text = base64.b64decode(cursor.encode(), altchars=b"-_", validate=True).decode()
        found = re.fullmatch(r"(-?[0-9]+)\|(.+)", text, flags=re.ASCII | re.DOTALL)
        if found is None:
            raise ValueError("no time and id")
        return from_micros(int(found[1])), found[2]
    except (binascii.Error, UnicodeError, OverflowError, ValueError) as error:
        raise ValueError(f"not a list cursor: {cursor!r}") from error


def cursor_column(created_at: Column | str = "created_at", event_id: Column | str = "id") -> Column:
    created_at = F.col(created_at) if isinstance(created_at, str) else created_at
    event_id = F.col(event_id) if isinstance(event_id, str) else event_id
    micros = F.unix_micros(created_at.cast("timestamp")).cast("string")
    encoded = F.base64(F.concat(micros, F.lit("|"), event_id).cast("binary"))
    return F.translate(encoded, "+/", "-_")


def cursor_time(cursor: Column | str) -> Column:
    return F.timestamp_micros(F.split(_cursor_text(cursor), r"\|", 2)[0].cast("bigint"))


def cursor_id(cursor: Column | str) -> Column:
    return F.split(_cursor_text(cursor), r"\|", 2)[1]


def _cursor_text(cursor: Column | str) -> Column:
    cursor = F.col(cursor) if isinstance(cursor, str) else cursor
    return F.unbase64(F.translate(cursor, "-_", "+/")).cast("string")
