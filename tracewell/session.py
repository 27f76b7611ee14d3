"""Sessions with the settings that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; 128 MB scan splits and 64 MB shuffle targets unless set otherwise."""
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m", "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.parquet.filterPushdown": "true", "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.config(map=conf)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
