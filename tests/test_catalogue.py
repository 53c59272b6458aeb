"""Each query of the catalogue against its SQL in DuckDB, and the column functions on the fixtures."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cursus.functions import columns as C
from cursus.operators import relational as R
from cursus.plans import artifacts, catalogue, lessons, preparation, studies  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


def test_durations(spark):
    cases = {"PT5M32S": 332, "PT1H15M30S": 4530, "PT0S": 0, "PT10M": 600, "PT2H": 7200, "invalid": 0, "": 0}
    df = spark.createDataFrame([(k,) for k in cases], "iso string")
    assert {r["iso"]: r["s"] for r in df.select("iso", C.duration_seconds(F.col("iso")).alias("s")).collect()} == cases


def test_score_and_levels(spark):
    df = spark.createDataFrame([(100, 10, 2), (0, 5, 0)], "v long, l long, c long")
    got = [r[0] for r in df.select(C.engagement_score(F.col("v"), F.col("l"), F.col("c"))).collect()]
    assert got == pytest.approx([math.log1p(1.6), math.log1p(5)])
    levels = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "s double").select(C.level(F.col("s"), F.lit(0.3), F.lit(0.7)))
    assert [r[0] for r in levels.collect()] == ["Low", "Medium", "High"]


def test_latest_snapshot(spark):
    df = spark.createDataFrame([("a", "2026-01-01", 1), ("a", "2026-01-05", 5), ("b", "2026-01-02", 2)], "video_id string, snapshot_date string, view_count long")
    assert {r["video_id"]: r["view_count"] for r in R.latest_per_key(df, "video_id", F.desc("snapshot_date")).collect()} == {"a": 5, "b": 2}
