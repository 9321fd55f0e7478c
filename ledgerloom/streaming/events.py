"""The batch operators over streams, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def document_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Documents as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of any kind as they arrive: path and content."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(kinds).load(folder).select("path", "content")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True):
    """Run a batch operator on every micro-batch; each batch's rows land in a folder of their own, so that a batch that runs twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """begin, event_type, n, total over windows of event time; for batches and, with a watermark, for streams."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("begin"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, begin, n, total: a user's events without a longer gap between them."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("begin"), "n", "total")
