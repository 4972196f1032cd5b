"""Messages set aside, whole and with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trailspark.schema import DELIVERY_SCHEMA
from trailspark.sources.messages import COORDINATES
from trailspark.sources.tables import read_or_empty


def write_dead_letters(decoded: DataFrame, path: str, batch: str) -> None:
    """Write the deliveries that have a `dead_reason`, replacing the batch if it is there."""
    (
        decoded.filter("dead_reason IS NOT NULL")
        .select(
            *DELIVERY_SCHEMA.names, *COORDINATES,
            F.col("dead_reason").alias("reason"), F.lit(batch).alias("batch"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("reason", "batch")
        .parquet(path)
    )


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    places = [StructField("source", StringType()), StructField("position", LongType())]
    partitions = [StructField("reason", StringType()), StructField("batch", StringType())]
    schema = StructType(DELIVERY_SCHEMA.fields + places + partitions)
    return read_or_empty(spark, schema, path)
