"""Session settings the operators rely on."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}


def ensure_session(spark: SparkSession) -> SparkSession:
    """Pin the settings that change results: UTC hours, last duplicate JSON key wins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session may go without; it gets one temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="trailspark-")
    return _local_dirs[context.applicationId]


def cluster_conf(shuffled_bytes: int, cores: int, partition_bytes: int = 200 << 20) -> dict[str, str]:
    """Settings for a job that shuffles about `shuffled_bytes` on `cores` cores.

    The starting number of shuffle partitions keeps each near `partition_bytes`; adaptive
    execution merges the small ones and splits the skewed ones from there.
    """
    partitions = max(2 * cores, math.ceil(shuffled_bytes / partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
