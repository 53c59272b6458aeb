"""Streams whose files arrive one after another, with SQL that says which rows are late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.tables import table
from ..streaming import windows as W
from .catalogue import query

# The first file has nine tenths of the events. Rows of the second are late where the watermark, six hours behind the latest row of
# the first, has passed: the end of their window, or for single rows their own time.
ARRIVED_SQL = """WITH first AS (SELECT * FROM events WHERE event_id % 10 <> 0), second AS (SELECT * FROM events WHERE event_id % 10 = 0),
w AS (SELECT max(ts) - INTERVAL 6 HOUR AS w1, (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AS w2 FROM first)"""


def _arriving(spark, sf_dir, make, second):
    """The result of a stream that is run after each of two files."""
    place, events = sinks.scratch(spark, "arriving"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for rows in (events.where("event_id % 10 <> 0"), second(events)):
        rows.coalesce(1).write.mode("append").parquet(f"{place}/in")
        W.run_to_end(make, W.files(spark, f"{place}/in", events.schema), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out")


@query(ARRIVED_SQL + """, kept AS (SELECT * FROM first UNION ALL SELECT second.* FROM second, w WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > w1)
SELECT epoch(date_trunc('hour', ts)) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM kept, w WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w2 GROUP BY 1, 2""")
def closed_windows(spark, sf_dir):
    """Hourly counts, each written once, when its hour is closed; what comes after that is dropped."""
    out = _arriving(spark, sf_dir, lambda rows: W.closed_windows(rows, "6 hours", "1 hour"), lambda e: e.where("event_id % 10 = 0"))
    return out.select(F.unix_seconds("start").cast("double").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query(ARRIVED_SQL + """ SELECT event_id, user_id, event_type, value FROM first UNION ALL SELECT event_id, user_id, event_type, value FROM second, w WHERE ts >= w1""")
def events_once(spark, sf_dir):
    """Each event once, with the values it came with first: the second file repeats the whole first one with other values."""
    again = lambda e: e.withColumn("value", F.when(F.col("event_id") % 10 == 0, F.col("value")).otherwise(-1.0))
    return _arriving(spark, sf_dir, lambda rows: W.once(rows, "event_id", "6 hours"), again).select("event_id", "user_id", "event_type", "value")
