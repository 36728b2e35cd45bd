"""Structured Streaming forms of the metric aggregates, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def metric_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, admitting so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gauges(events: DataFrame, time: str, width: str, delay: str, *keys: str, value: str = "value") -> DataFrame:
    """Average and throughput of each tumbling window; rows later than the watermark are dropped."""
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    made = events.withWatermark(time, delay).groupBy(*keys, F.window(time, width)).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("average"), F.count(F.lit(1)).alias("n"))
    return made.select(*keys, F.col("window.start").alias("start"), "average", (F.col("n") / seconds).alias("per_sec"))


def each_message(results: DataFrame, send, checkpoint: str) -> StreamingQuery:
    """Hand every result's JSON text to `send(rows)` in order of seq, a micro-batch at a time; errors become {"error": ...}."""

    def deliver(batch: DataFrame, _: int) -> None:
        fields = [c for c in batch.columns if c not in ("seq", "error")]
        text = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
        send(batch.select("seq", text.alias("message")).orderBy("seq").toLocalIterator())

    return results.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
