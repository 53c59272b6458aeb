"""The study of all subjects at once against one subject after another."""

import random

import pytest
from pyspark.sql import functions as F

from cursus.operators import analysis as A
from cursus.operators import relational as R
from cursus.operators import statistics as S


@pytest.fixture(scope="module")
def videos(spark):
    r = random.Random(12)
    rows = [(i, r.choices(["Maths", "Physics", "Rare"], [6, 4, 0.1])[0], r.choice(["High", "Low", "Medium"]), float(r.choice([0, 0, 0, 1, 2, 3, 50])), r.gauss(0, 1) if i % 7 else None, f"t{'?' * (i % 3)}") for i in range(900)]
    return spark.createDataFrame([*rows, (900, None, "High", 1.0, 2.0, None)], "id int, subject string, level string, views double, score double, title string").repartition(3).cache()


def test_subjects_that_are_studied(videos):
    counts = {r["scope"]: r["count"] for r in A.studied(videos, "subject", "level").groupBy("scope").count().collect()}
    assert set(counts) == {"Maths", "Physics", "global"} and counts["global"] == 901
    assert {r["scope"] for r in A.studied(videos.limit(5), "subject", "level").collect()} == {"global"}


def test_comparisons_are_those_of_each_subject_alone(spark, videos):
    features = {"views": F.col("views"), "score": F.col("score"), "same": F.lit(2.0), "never": F.lit(None).cast("double")}
    got = {(r["scope"], r["feature"]): r for r in A.comparisons(A.studied(videos, "subject", "level"), features, "level").collect()}
    assert set(got) == {(s, f) for s in ("Maths", "Physics", "global") for f in ("views", "score", "same")}
    for (scope, feature), r in got.items():
        own = videos if scope == "global" else videos.where(F.col("subject") == scope)
        want = S.compare_groups(own.withColumn("x", features[feature]), "level", "High", "Low", "x").first()
        for c in want.asDict():
            assert r[c] == pytest.approx(want[c]), (scope, feature, c)
        assert r["significant"] == (want["p_value"] < 0.05) and r["effect"] in ("negligible", "small", "medium", "large")


def test_many_keys_give_what_few_do(videos):
    two = videos.where("level <> 'Medium'").select("subject", F.col("level").alias("g"), F.col("views").alias("v"))
    a, b = (S.two_group_ranks(two.where("subject IS NOT NULL"), "High", "Low", bins=bins, keys=("subject",), many=many).drop("mid") for bins, many in ((8, True), (64, False)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 7, 63, 64, 65])
def test_bins_found_by_halves(spark, n):
    cuts = sorted(random.Random(n).choices(range(40), k=n - 1))
    rows = spark.range(-1, 42).select(F.col("id").cast("double").alias("v")).withColumn("cuts", F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"))
    for r in rows.select("v", R.bin_of(F.col("cuts"), F.col("v"), n).alias("bin")).collect():
        assert r["bin"] == sum(c < r["v"] for c in cuts)


def test_timing_channels_and_overview(spark):
    rows = [(f"2024-01-0{1 + i % 3} {i % 5:02}:00:00", i * 100, "abc"[i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "at string, seconds int, channel string, score double").withColumn("at", F.col("at").cast("timestamp")).withColumns({"scope": F.lit("global"), "level": F.lit("High"), "views": F.lit(1)})
    found = A.timing(df, "at", F.col("seconds") / 60, "score", "views").collect()
    assert {r["value"] for r in found if r["part"] == "day"} == {"Monday", "Tuesday", "Wednesday"}
    assert sum(r["n"] for r in found if r["part"] == "minutes") == 59  # 0 seconds are in no bin
    assert [r["value"] for r in found if r["part"] == "minutes" and r["place"] == 1] == ["60+"]
    assert [(r["channel"], r["place"]) for r in A.channels(df, "channel", "score", 2).orderBy("place").collect()] == [("c", 1), ("b", 2)]
    assert A.overview(df, "level", "score").first().asDict() == {"scope": "global", "videos": 60, "high": 60, "mean_score": 29.5}


def test_rows_of_a_common_value_meet_their_rank_in_parts(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(9999, None)], "id long, v double"))
    a, b = (R.mid_ranks(df, "v", few=few).select("id", "v", "mid_rank", "ties") for few in (100, 10**6))
    assert a.count() == 3000 and a.exceptAll(b).isEmpty()
    values = sorted(r["v"] for r in df.where("v IS NOT NULL").collect())
    for r in a.select("v", "mid_rank", "ties").distinct().collect():
        assert r["ties"] == values.count(r["v"]) and r["mid_rank"] == values.index(r["v"]) + (r["ties"] + 1) / 2
