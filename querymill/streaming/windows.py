"""Windows over event streams: an extension beyond batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sum per key and tumbling window; works on streams (rows later than `late` are dropped) and batches alike."""
    w = F.window(time, size)
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")
