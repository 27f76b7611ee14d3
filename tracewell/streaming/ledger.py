"""Structured Streaming over ledgers: append-only occurrence files as they come, and their step summaries. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def occurrence_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def append_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appended by the file sink, whose log makes it exactly once; ends when what is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def step_counts(stream: DataFrame, time: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by time window and source; rows later than the watermark are dropped, as state must be bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), "source").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "source", "n", "mean_value")
