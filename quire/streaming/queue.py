"""The job queue as a stream: events are read as they arrive, folded into the
state per key, and handed to a handler batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.session import shared_folder


def event_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{pattern}*")


def status_counts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Counts and the last id per status, by a stream that takes what is there
    and ends; the result has one row per status."""
    name = "status_" + uuid.uuid4().hex
    counted = event_stream(spark, folder, pattern).groupBy(F.col("event_type").alias("status"))
    counted = counted.agg(F.count("*").alias("events"), F.max("event_id").alias("last_id"))
    counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and status, late ones included up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"))


def windowed_table(spark: SparkSession, folder: str, pattern: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begins, event_type, events) of what is there, by a stream that takes it
    and ends; one row per window and type."""
    name = "windows_" + uuid.uuid4().hex
    events = event_stream(spark, folder, pattern)
    kind = events.schema["ts"].dataType.simpleString()
    counted = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), width, late)
    flat = counted.select(F.col("window.start").cast(kind).alias("begins"), "event_type", "events")
    flat.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def consume(jobs: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` on every batch.  The checkpoint keeps
    track of what was read; a handler that writes under the batch's id makes
    the whole exactly-once.  ``every``: poll at this interval, else take what
    is there and end."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return jobs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
