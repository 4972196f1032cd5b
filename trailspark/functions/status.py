"""HTTP status kept inside the metadata payload."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

from trailspark.schema import STATUS_COLUMN


_KEY = "http_status"


def status_column(schema: StructType) -> Column:
    """The stored status where there is one, else the status read from the metadata."""
    return F.col(STATUS_COLUMN) if STATUS_COLUMN in schema.names else http_status()


def http_status(metadata: Column | str = "metadata") -> Column:
    """`metadata.http_status` as an int when its text is all digits, else NULL.

    Text that is not all digits extracts as '' and digits beyond an int overflow; both cast to
    NULL instead of failing the query. Guard and cast are one expression because the order of
    two filters is the optimizer's choice.
    """
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    return F.regexp_extract(_status_text(metadata), r"\A[0-9]+\z", 0).try_cast("int")


def _status_text(metadata: Column) -> Column:
    """The last of duplicate keys counts, which only `from_json` gives.

    It is the slower reader, so it gets the documents that may have duplicates: the key occurs
    twice, or could be written with escapes. Without the key there is nothing to parse.
    """
    first = F.instr(metadata, _KEY)
    again = F.call_function("locate", F.lit(_KEY), metadata, first + 1)
    return F.when(
        (again > 0) | metadata.contains("\\u"), F.from_json(metadata, f"{_KEY} string")[_KEY]
    ).when(first > 0, F.get_json_object(metadata, f"$.{_KEY}"))


def in_range(status: Column, low: int, high: int) -> Column | None:
    """Rows whose status lies in the range; a bound of 0 or less is no bound, two are none."""
    if low > 0 and high > 0:
        return F.call_function("between", status, F.lit(low), F.lit(high))
    if low > 0:
        return status >= low
    if high > 0:
        return status <= high
    return None


def is_success(status: Column) -> Column:
    return status.between(200, 399)


def is_failure(status: Column) -> Column:
    return status >= 400
