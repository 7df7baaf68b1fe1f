"""Structured Streaming counterparts: event windows, sessions, deduplication.

Each function takes a streaming (or batch) DataFrame of events with ``ts`` (with or
without time zone; results have none) and returns one; ``run_once`` drives a stream
over files to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _plain(column: str):
    return F.col(column).cast("timestamp_ntz")


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of value by event type in windows without overlap; state leaves behind the watermark."""
    return _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(_plain("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(_plain("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of every user: events less than ``gap`` apart."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(_plain("session_window.start").alias("session_start"), "user_id", "n")


def deduplicate(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First event of every key within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


def run_once(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Write all that is there now (availableNow) with exactly-once files, and return the table. A new checkpoint's state has ``partitions``, or the session's."""
    key = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    spark.conf.set(key, partitions or usual)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, usual)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_complete(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive an aggregate to its end in complete mode. Every batch writes the groups as files of their own folder, by the
    executors; the last folder is the result."""
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{max(done)}") if done else spark.createDataFrame([], stream.schema)
