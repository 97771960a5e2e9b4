"""Session builder with the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution stays on: skewed join partitions are split, small shuffle
# partitions are merged, and small join sides become broadcasts at run time. With merging on,
# the number of shuffle partitions can be set for the largest shuffle.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app_name: str = "marketlens", master: str | None = None, **settings) -> SparkSession:
    """Build (or get) a session. Extra settings use `__` in place of dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()
