"""Writing the look-up index of a version of the compacted trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailspark.sources.lookups import LOOKUP_COLUMNS, read_lookups, value_number


def write_lookups(events: DataFrame, path: str, version: str) -> None:
    """Index the files of a version, which `events` is read from, by day.

    Values become numbers and equal numbers of a file meet before the shuffle, so what is
    shuffled grows with the distinct numbers of a file, not with its rows. The day's bitmaps are
    the union of those of its files.
    """
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in LOOKUP_COLUMNS)))
    named = events.select("created_date", "batch", F.col("_metadata.file_path").alias("file"), value.alias("v"))
    keys = ("created_date", "batch", "file", "column")
    numbers = named.select(*keys[:3], "v.column", value_number(F.col("v.value")).alias("number")).distinct()
    files = numbers.groupBy(*keys, F.bitmap_bucket_number("number").alias("bitmap_number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )
    _write(files.withColumn("level", F.lit("file")), path)
    written = read_lookups(events.sparkSession, path, "file").filter(F.col("batch") == version)
    days = written.groupBy("created_date", "batch", "column", "bitmap_number").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    _write(days.withColumns({"level": F.lit("day"), "file": F.lit(None).cast("string")}), path)


def _write(rows: DataFrame, path: str) -> None:
    columns = ("file", "column", "bitmap_number", "bitmap", "level", "created_date", "batch")
    (
        rows.select(*columns)
        .hint("rebalance", "created_date")
        .sortWithinPartitions("level", "created_date", "batch", "column", "bitmap_number")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", 4 << 20)
        .partitionBy("level", "created_date", "batch")
        .parquet(path)
    )
