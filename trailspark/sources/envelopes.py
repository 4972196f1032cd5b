"""Batch documents: one JSON object with an `events` array per line or per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.functions.numbers import number_tag
from trailspark.functions.once import compute_once
from trailspark.operators.decode import (
    as_event,
    elements,
    event_struct,
    event_time,
    has_wrong_type,
    is_null,
    parse_envelope,
)
from trailspark.schema import EVENT_COLUMNS
from trailspark.sources.messages import BLOCK, FILES_PER_TRIGGER, number_lines


def read_envelopes(spark: SparkSession, path: str, *, whole_files: bool = False, numbered: bool = True) -> DataFrame:
    """`body` with its coordinates `source_file, source_row`: the file and the line in it.

    Numbering lines reads the files once more; without it the row is NULL.
    """
    if whole_files:
        return _bodies(spark.read.text(path, wholetext=True), F.lit(0).cast("bigint")).drop(BLOCK)
    bodies = _bodies(spark.read.text(path), F.lit(None).cast("bigint"))
    return number_lines(bodies, "source_file", "source_row") if numbered else bodies.drop(BLOCK)


def stream_envelopes(
    spark: SparkSession, path: str, *, whole_files: bool = False, max_files_per_trigger: int | None = FILES_PER_TRIGGER
) -> DataFrame:
    """The same as files arrive; a stream numbers no rows."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _bodies(reader.text(path, wholetext=whole_files), F.lit(None).cast("bigint")).drop(BLOCK)


def _bodies(df: DataFrame, row: Column) -> DataFrame:
    return df.select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("source_file"),
        row.alias("source_row"),
        F.col("_metadata.file_block_start").alias(BLOCK),
    )


def decode_envelopes(envelopes: DataFrame) -> DataFrame:
    """Adds `events` (typed structs, NULL elements kept) and `decode_error` to bodies.

    One value of the wrong kind makes the whole document undecodable.
    """
    body, tag = F.col("body"), F.col("_tag")
    parsed = envelopes.withColumn("_tag", number_tag(body)).withColumn("_parsed", parse_envelope(body, tag))
    listed = parsed.withColumn("_given", elements(F.col("_parsed.events")))
    read = listed.withColumn("_events", F.transform("_given", as_event))
    no_array = F.col("_given").isNull() & ~is_null(F.col("_parsed.events"))
    no_object = F.exists(
        F.zip_with("_given", "_events", lambda given, event: event.isNull() & ~is_null(given)), lambda wrong: wrong
    )
    wrong_type = F.exists("_events", lambda e: e.isNotNull() & has_wrong_type(e, event_time(e), tag))
    broken = F.coalesce(F.col("_parsed").isNull() | no_array | no_object | wrong_type, F.lit(False))
    events = F.transform("_events", lambda e: F.when(e.isNotNull(), event_struct(e, event_time(e), tag)))
    decoded = compute_once(read, decode_error=broken, events=F.when(~broken, events))
    return decoded.drop("_tag", "_parsed", "_given", "_events")


def explode_events(envelopes: DataFrame) -> DataFrame:
    """One row per event with its position `pos`.

    An empty or absent array gives one row with NULL `pos`; a null element a row with `pos`.
    Columns other than the body and the array pass through.
    """
    others = [c for c in envelopes.columns if c not in ("body", "events")]
    rows = envelopes.select(*others, F.posexplode_outer("events").alias("pos", "event"))
    return rows.select(
        *others, "pos", F.col("event").isNull().alias("is_null"), *(F.col(f"event.{c}") for c in EVENT_COLUMNS)
    )
