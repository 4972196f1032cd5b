"""What has been read of each source, so that nothing is stored twice under two names.

A stream reads each source (a file, a partition of a topic) in runs of positions; one row per
batch and source says which. A stream with another name, or with a lost checkpoint and a new
name, leaves out the positions another stream has read. Its own repeats are the checkpoint's
concern, so in ordinary operation there is nothing to compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trailspark.sources.tables import read_or_empty

RANGE_SCHEMA = "source string, first bigint, last bigint, query string, batch string"


def write_ranges(deliveries: DataFrame, path: str, batch: str, *, query: str) -> None:
    """The run of positions of each source in a batch, replacing the batch if it is there."""
    runs = deliveries.groupBy("source").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    (
        runs.select("*", F.lit(query).alias("query"), F.lit(batch).alias("batch"))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Positions read, runs that touch or overlap made one."""
    runs = read_or_empty(spark, RANGE_SCHEMA, path)
    order = Window.partitionBy("source", "query").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") > reached + 1, 1).otherwise(0)
    groups = runs.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    return groups.groupBy("source", "query", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def not_read_by_others(deliveries: DataFrame, path: str, *, query: str) -> DataFrame:
    """Deliveries whose position no other stream has read."""
    others = read_ranges(deliveries.sparkSession, path).filter(F.col("query") != query)
    read = others.select(F.col("source").alias("_source"), "first", "last")
    same = (F.col("source") == F.col("_source")) & F.col("position").between(F.col("first"), F.col("last"))
    return deliveries.join(read, same, "left_anti")
