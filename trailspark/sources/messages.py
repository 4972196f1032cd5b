"""Queue deliveries, batch or streaming: `body, x_death, redelivered` and coordinates.

Every source gives the coordinates of a message under `COORDINATES`, from which its event id
is derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trailspark.schema import DELIVERY_SCHEMA

COORDINATES = ("source", "position")
#: Of text lines: where the part of the file begins that they were read from.
BLOCK = "file_block"

#: What a micro-batch takes at most unless told otherwise; a backlog becomes many batches.
FILES_PER_TRIGGER = 1_000
MESSAGES_PER_TRIGGER = 1_000_000


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Delivery files (Parquet); a message's place is its file and row."""
    return _delivered(spark.read.schema(DELIVERY_SCHEMA).parquet(path))


def stream_files(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    reader = spark.readStream.schema(DELIVERY_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _delivered(reader.parquet(path))


def _delivered(df: DataFrame) -> DataFrame:
    return df.select(
        *DELIVERY_SCHEMA.names,
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.row_index").alias("position"),
    )


def from_text(spark: SparkSession, path: str, *, numbered: bool = True) -> DataFrame:
    """Text files, one body per line, no delivery metadata; a message's place is its file and line.

    Numbering reads the files once more, to count the lines of their blocks. Say
    `numbered=False` where places do not matter.
    """
    bodies = _bodies(spark.read.text(path), F.lit(None).cast("bigint"))
    return number_lines(bodies) if numbered else bodies.drop(BLOCK)


def stream_text(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """Text files as they arrive.

    Lines get their position when their batch is written, by `number_lines`; until then they
    have the block of their file.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _bodies(reader.text(path), F.lit(None).cast("bigint"))


def _bodies(df: DataFrame, position: Column) -> DataFrame:
    return df.select(
        F.col("value").alias("body"),
        *_undelivered(),
        F.col("_metadata.file_path").alias("source"),
        position.alias("position"),
        F.col("_metadata.file_block_start").alias(BLOCK),
    )


def number_lines(lines: DataFrame, source: str = "source", position: str = "position") -> DataFrame:
    """Sets `position` to the number of the line in its file, from 0, however files are split.

    `lines` is a scan with the block of each line, with nothing done to it that moves rows. The
    lines of a block lie together, in order, in one task; the first of a block comes after all
    lines of the blocks before it. Counts and numbers are one query, so both see the same
    splits. There is one sum per block; whether the sums are broadcast is left to Spark.
    """
    ordered = lines.withColumn("_order", F.monotonically_increasing_id())
    counted = ordered.groupBy(source, BLOCK).agg(F.min("_order").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy(source).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")
    numbered = ordered.join(counted.select(source, BLOCK, shift.alias("_shift")), [source, BLOCK])
    others = [c for c in lines.columns if c not in (position, BLOCK)]
    return numbered.select(*others, (F.col("_order") + F.col("_shift")).alias(position))


def stream_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    *,
    batch_size: int = 200,
    flush_interval: str = "2s",
    max_per_trigger: int | None = MESSAGES_PER_TRIGGER,
) -> DataFrame:
    """A Kafka topic (needs the connector on the class path).

    A micro-batch starts at `batch_size` messages or `flush_interval` after the last one.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("minOffsetsPerTrigger", batch_size)
        .option("maxTriggerDelay", flush_interval)
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return from_kafka(reader.option("includeHeaders", "true").load())


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records to deliveries; partition and offset are the coordinates.

    Headers, where the records have them, say what the broker before knew of earlier attempts:
    `x-death` is a JSON array of objects with a `count`, `redelivered` is `true`. A header whose
    array cannot be read is there and holds no count; of a header given twice the first counts.
    """
    return records.select(
        F.col("value").cast("string").alias("body"),
        *(_redelivery() if "headers" in records.columns else _undelivered()),
        F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("source"),
        F.col("offset").alias("position"),
    )


def _redelivery() -> list:
    x_death, kind = _header("x-death"), DELIVERY_SCHEMA["x_death"].dataType
    deaths = F.coalesce(F.from_json(x_death, kind), F.array().cast(kind))
    return [
        F.when(x_death.isNotNull(), deaths).alias("x_death"),
        (F.lower(_header("redelivered")) == "true").alias("redelivered"),
    ]


def _header(key: str) -> Column:
    first = F.get(F.filter("headers", lambda h: h["key"] == key), F.lit(0))
    return F.when(first.isNotNull(), F.coalesce(first["value"].cast("string"), F.lit("")))


def _undelivered() -> list:
    return [
        F.lit(None).cast(DELIVERY_SCHEMA["x_death"].dataType).alias("x_death"),
        F.lit(None).cast("boolean").alias("redelivered"),
    ]
