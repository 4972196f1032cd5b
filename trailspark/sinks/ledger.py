"""One row per micro-batch: what was read, written and set aside, and how long it took."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from trailspark.operators.groups import bucket_histogram
from trailspark.sources.tables import read_or_empty

LEDGER_SCHEMA = (
    "query string, batch_id bigint, arrived_at timestamp, read bigint, written bigint, "
    "max_redeliveries bigint, decode_error bigint, write_seconds double"
)

# Bucket bounds of the two histograms.
BATCH_SIZE_BOUNDS = (1, 5, 10, 25, 50, 100, 200, 500)
WRITE_SECONDS_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 5)


def write_ledger(
    spark: SparkSession, path: str, batch: str, *, query: str, batch_id: int, totals: Row, write_seconds: float
) -> None:
    """Written last: a batch with a ledger row is complete."""
    row = (
        query, batch_id, totals["arrived_at"], totals["read"], totals["written"],
        totals["max_redeliveries"], totals["decode_error"], write_seconds,
    )
    (
        spark.createDataFrame([row], LEDGER_SCHEMA)
        .coalesce(1)
        .withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{LEDGER_SCHEMA}, batch string", path).drop("batch")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Counters over all batches: one row per outcome."""
    outcomes = ("read", "written", "max_redeliveries", "decode_error")
    totals = ledger.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in outcomes))
    return totals.unpivot([], list(outcomes), "outcome", "events")


def batch_size_histogram(ledger: DataFrame) -> DataFrame:
    """Sizes of the batches that wrote anything."""
    return bucket_histogram(ledger.filter("written > 0"), "written", BATCH_SIZE_BOUNDS)


def write_seconds_histogram(ledger: DataFrame) -> DataFrame:
    return bucket_histogram(ledger.filter("written > 0"), "write_seconds", WRITE_SECONDS_BOUNDS)
