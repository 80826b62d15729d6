"""Service metrics as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import documents_added, latency_quantile_by_window, request_rate


def event_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a UTC timestamp, as watermarks need one."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_request_rate(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    return request_rate(events.withWatermark("ts", delay), window, slide)


def stream_latency_quantile(events: DataFrame, q: float = 0.95, delay: str = "10 minutes", window: str = "5 minutes", **options) -> DataFrame:
    return latency_quantile_by_window(events.withWatermark("ts", delay), q, window, **options)


def stream_documents_added(events: DataFrame, keys=("event_type",)) -> DataFrame:
    """A running total; use output mode ``complete`` or ``update``."""
    return documents_added(events, keys)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all available input, appending closed windows to ``path``; returns what was written."""
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run over all available input in complete mode; the last state of the result is kept in ``path``."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
