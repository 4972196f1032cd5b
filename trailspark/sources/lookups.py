"""Which files of the compacted trail can hold a value: bitmaps kept beside the table.

A value is hashed to one of 2^`BITS` numbers. The index has, for each file and lookup column,
the numbers that occur in it as bitmaps of 32,768 bits, and for each day the union of those of
its files. A look-up reads the bitmaps with its own number alone: first those of the days, then
those of the files of the days found. The answer never lacks a file that holds the value; a file
without it is named with about the share of the numbers that the file's values take up.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.sources.tables import read_or_empty

LOOKUP_SCHEMA = (
    "file string, column string, bitmap_number bigint, bitmap binary, "
    "level string, created_date date, batch string"
)
#: Columns whose values are spread over all times.
LOOKUP_COLUMNS = ("request_id", "actor", "target_id")
BITS = 20
#: Beyond this many files the list is no help: the scan finds them by its own statistics.
MOST_FILES = 10_000


def value_number(value: Column) -> Column:
    """1 to 2^BITS, the range the bitmap functions count from."""
    return F.pmod(F.xxhash64(value), F.lit(1 << BITS)) + 1


def _holds(value: Column) -> Column:
    """True for the bitmaps that hold the number of `value`."""
    number = value_number(value)
    position = F.bitmap_bit_position(number)
    byte = F.substring(F.col("bitmap"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    bits = F.conv(F.hex(byte), 16, 10).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))
    return (F.col("bitmap_number") == F.bitmap_bucket_number(number)) & (bits.bitwiseAND(bit) != 0)


def read_lookups(spark: SparkSession, path: str, level: str) -> DataFrame:
    return read_or_empty(spark, LOOKUP_SCHEMA, path).filter(F.col("level") == level)


def files_with(
    spark: SparkSession, path: str, versions: dict[date, str], column: str, value: str
) -> list[str] | None:
    """Files of these versions that may hold the value; None if they are too many to name."""
    if column not in LOOKUP_COLUMNS:
        raise ValueError(f"no look-up index of {column}")
    listed = F.concat_ws("/", F.col("created_date").cast("string"), "batch")
    current = [f"{day}/{version}" for day, version in versions.items()]
    given = F.lit(value)

    def hits(level: str) -> DataFrame:
        rows = read_lookups(spark, path, level).filter((F.col("column") == column) & listed.isin(current))
        return rows.filter(_holds(given))

    days = [r["created_date"] for r in hits("day").select("created_date").distinct().collect()]
    if not days:
        return []
    rows = hits("file").filter(F.col("created_date").isin(days)).select("file").distinct()
    files = [r["file"] for r in rows.limit(MOST_FILES + 1).collect()]
    return files if len(files) <= MOST_FILES else None
