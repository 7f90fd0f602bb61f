"""The event log: one JSON line per event, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, pid int, stage string, message string, extra map<string,string>, _corrupt string"


def append(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events; a line that is no JSON has only ``_corrupt``."""
    return spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def tail(events: DataFrame, n: int = 60, order: tuple[str, ...] = ()) -> DataFrame:
    """(line) of the newest events; malformed lines pass through.  ``order``:
    columns that rank events of one time."""
    stamp = F.date_format("ts", "HH:mm:ss")
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    line = F.coalesce("_corrupt", F.concat_ws(" ", stamp, F.col("stage"), F.col("message"), F.nullif(extra, F.lit(""))))
    return events.orderBy(F.desc_nulls_last("ts"), *map(F.desc, order)).limit(n).select(line.alias("line"))
