"""Typed readers, and the driver tables as the entities of lesson analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

SNAPSHOT = T.StructType([T.StructField(n, t) for n, t in [("video_id", T.StringType()), ("title", T.StringType()), ("description", T.StringType()), ("publish_date", T.StringType()), ("channel_id", T.StringType()), ("channel_title", T.StringType()), ("duration_sec", T.LongType()), ("view_count", T.LongType()), ("like_count", T.LongType()), ("comment_count", T.LongType()), ("tags", T.StringType()), ("snapshot_date", T.StringType())]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: T.StructType = SNAPSHOT) -> DataFrame:
    """CSV with a fixed schema; descriptions hold line ends, so records may span lines."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON object or a list of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the optional columns that it lacks as typed nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos, their lines as statistics, customers as channels with a subject."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"))
    stats = lines.agg(F.count("*").alias("likes"), F.count_if(F.col("l_returnflag") == "R").alias("comments"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderdate").cast("timestamp").alias("published"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("views"), (F.floor("o_totalprice") % 3600).cast("long").alias("duration_sec"), F.col("o_orderpriority").alias("title"),
    )
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_mktsegment").alias("subject"))
    return orders.join(stats, "video_id", "left").na.fill(0, ["likes", "comments"]).join(channels, "channel_id", "left")


#: The same in SQL, as the first part of a statement.
VIDEOS_SQL = """WITH stats AS (
  SELECT l_orderkey AS video_id, count(*) AS likes, count(*) FILTER (WHERE l_returnflag = 'R') AS comments FROM lineitem GROUP BY 1
), videos AS (
  SELECT o_orderkey AS video_id, o_custkey AS channel_id, CAST(o_orderdate AS TIMESTAMP) AS published, CAST(floor(o_totalprice / 100) AS BIGINT) AS views,
         CAST(floor(o_totalprice) % 3600 AS BIGINT) AS duration_sec, o_orderpriority AS title, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments, c_mktsegment AS subject
  FROM orders LEFT JOIN stats ON stats.video_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
)"""
