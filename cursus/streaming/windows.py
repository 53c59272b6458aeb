"""Streams over files that arrive one after another: windows that close, and rows that come once or too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .snapshots import windowed_counts


def files(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The folder's Parquet files as they come, an event time `ts` in each row."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def closed_windows(rows: DataFrame, late: str, width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of windows once they are closed: when the watermark, `late` behind the latest row, has passed
    their end. Rows of windows that are closed already are dropped."""
    return windowed_counts(rows, late, width).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def once(rows: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key, as it came. A row behind the watermark is dropped, and a key is forgotten `late` after its row's time."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_end(make: Callable[[DataFrame], DataFrame], rows: DataFrame, out: str, state: str) -> None:
    """Takes in what has arrived since the last run and adds what it makes of it to the table at out. The progress is at state,
    so a later run, or one after a failure, goes on where this one stopped and writes nothing twice."""
    stream = make(rows).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    stream.awaitTermination()
