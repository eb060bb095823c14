"""Session settings this workload wants on top of Spark's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions by bytes. Polygon work costs far more time per byte than plain rows, so
# partitions may be smaller than usual before they are merged.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
}


_BYTES_PER_PARTITION = 128 * 1024 * 1024


def tune(spark: SparkSession, largest_shuffle_bytes: int = 0) -> SparkSession:
    """Apply the settings. With the size of the largest shuffle, also raise the number of shuffle partitions so
    that one holds about 128 MB; adaptive execution merges what turns out to be too many."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    wanted = -(-largest_shuffle_bytes // _BYTES_PER_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark
