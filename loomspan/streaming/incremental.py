"""Incremental runs over a change log, as batches up to a watermark or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_since(log: DataFrame, watermark: object, upto: object, version: str = "ts") -> DataFrame:
    """Changes after the watermark, up to and including ``upto``."""
    return log.where((F.col(version) > F.lit(watermark)) & (F.col(version) <= F.lit(upto)))


def stream_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet change files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Events per key and tumbling window; rows later than ``late`` behind the watermark are dropped, as the stream states."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), key, "n")
    )


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``apply(batch, id)`` over all that is there now, exactly once per checkpoint, and waits for it."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
