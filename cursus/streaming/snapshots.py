"""Snapshots as a stream: event counts by window with late data bounded, and the newest state by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import latest_per_key


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_latest(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str = "video_id", at: str = "snapshot_date") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key."""

    def batch(rows: DataFrame, _: int) -> None:
        held = read()
        both = rows if held is None else held.unionByName(rows, allowMissingColumns=True)
        write(latest_per_key(both, key, F.desc_nulls_last(at), F.xxhash64(*both.columns)))

    return batch
