"""Operators of preparation, thumbnails and sinks on small tables with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.functions import columns as C
from cursus.operators import lessons as O
from cursus.operators import preparation as Q
from cursus.operators import relational as R
from cursus.operators import retrieval as V
from cursus.operators import statistics as S
from cursus.operators import thumbnails as I
from cursus.sources import remote, sinks
from cursus.sources.tables import SNAPSHOT, table_or_empty, with_columns


def videos(spark, n=60):
    rows = [(i, f"lesson {i % 7}", f"c{i % 4}", 10 * i, i, 1, 300 + i, f"2024-01-{i % 28 + 1:02d}T10:00:00Z") for i in range(n)]
    raw = spark.createDataFrame(rows, "video_id long, title string, channel_id string, view_count long, like_count long, comment_count long, duration_sec long, publish_date string")
    return Q.clean_videos(raw)


def test_cleaning_coerces(spark):
    df = spark.createDataFrame([(1, None, "12.0", "bad"), (2, "x", None, "2024-01-05T10:00:00+02:00")], "video_id long, tags string, view_count string, publish_date string")
    got = {r["video_id"]: r for r in Q.clean_videos(df).collect()}
    assert (got[1]["tags"], got[1]["view_count"], got[1]["publish_date"], got[1]["has_transcript"]) == ("", 12, None, False)
    assert got[2]["view_count"] == 0 and got[2]["publish_date"].hour in (8, 10)


def test_given_subject_goes_first(spark):
    df = spark.createDataFrame([(1, "t", "c", 500, "Physics"), (2, "t", "c", 500, None)], "video_id long, title string, channel_id string, duration_sec long, subject string")
    channels = spark.createDataFrame([("c", "Math")], "channel_id string, subject string")
    assert [r["subject"] for r in O.filter_videos(df, O.FilterConfig(), channels).orderBy("video_id").collect()] == ["Physics", "Math"]


def test_predictor_keeps_rows_and_saves(spark, tmp_path):
    features = ["duration_sec", "title_length", "channel_avg_views", "days_since_publish"]
    predictor = Q.EngagementPredictor.fit(videos(spark), features, "2024-06-01 00:00:00", "ridge")
    planned = videos(spark, 5).withColumn("channel_id", F.lit("new"))
    got = predictor.predict_batch(planned).collect()
    predictor.save(str(tmp_path / "bundle"))
    again = Q.EngagementPredictor.load(spark, str(tmp_path / "bundle")).predict_batch(planned).collect()
    assert len(got) == 5 and all(np.isfinite(r["predicted"]) for r in got)
    assert sorted(r["predicted"] for r in got) == pytest.approx(sorted(r["predicted"] for r in again))


def test_train_takes_given_ids(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(30)], "id long, x double, y double")
    _, metrics, predictions = S.train(df, "id", ["x"], "y", "ridge", test_ids=[1, 5])
    assert {r["id"] for r in predictions.collect()} == {1, 5} and metrics.first()["mae"] < 5
    with pytest.raises(ValueError, match="split"):
        S.train(df, "id", ["x"], "y", "ridge", test_ids=[])


def test_group_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.integers(0, 50, 500)] + [("b", float(x)) for x in r.normal(size=301)] + [("c", None), ("d", 1.0)]
    got = {x["g"]: x for x in R.group_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.1, 0.5, 1.0], bins=8).collect()}
    for g in "abd":
        want = np.quantile([v for k, v in rows if k == g], [0.1, 0.5, 1.0])
        assert got[g]["q"] == pytest.approx(list(want)) and got[g]["n"] == sum(k == g for k, _ in rows)
    assert "c" not in got


def test_every_question_gets_its_nearest(spark):
    r = np.random.default_rng(1)
    base = [(i, [float(x) for x in r.normal(size=4)]) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(base, "k long, embedding array<double>").repartition(3)
    asked = df.where("k < 3").select(F.col("k").alias("question_id"), F.col("embedding").alias("asked"))
    got = V.best_per_question(asked, df, "k", 4).collect()
    unit = np.array([v for _, v in base[:40]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(3):
        assert [x["k"] for x in sorted((x for x in got if x["question_id"] == q), key=lambda x: x["rank"])] == list(np.argsort(-(unit @ unit[q]))[:4])
    everything = df.select(F.col("k").alias("question_id"), F.col("embedding").alias("asked"))
    twice = df.unionByName(df.withColumn("k", F.col("k") + 100))  # ties: the smaller key goes first
    small = V.best_per_question(everything, twice, "k", 3, asked_rows=3, held_rows=2).collect()
    assert len(small) == 120 and {x["k"] for x in small if x["question_id"] == 7 and x["rank"] <= 2} == {7, 107}
    assert next(x["k"] for x in small if x["question_id"] == 7 and x["rank"] == 1) == 7
    assert V.best_per_question(everything.limit(0), df, "k", 3).count() == 0 and len(V.best_per_question(asked, df, "k", 99).collect()) == 120


def test_chunks_of_nested_sections(spark):
    files = spark.createDataFrame([("math", '{"titles": {"a": {"lift": 2}, "b": {"lift": 1}}, "note": "x", "n": 3}'), ("bad", "no json")], "subject string, value string")
    got = {r["chunk_id"]: r["content"] for r in Q.knowledge_chunks(files).collect()}
    assert got == {"math:titles:a": '{"lift":2}', "math:titles:b": '{"lift":1}', "math:note": "x", "math:n": "3"}


def test_prompt_groups_practices():
    text = Q.prompt("ask", [("title", "a" * 9), ("timing", "b"), ("title", "c")], most_chars=4)
    assert text == "ask\n\n[title]\n- aaaa\n- c\n\n[timing]\n- b" and Q.advise("q", [], str.upper) == "Q"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, predicted double")
    sinks.write_predictions(df, str(tmp_path / "p"), "json")
    assert spark.read.json(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_predictions(df, str(tmp_path / "q"), "xml")
    assert len(sinks.run_id()) == 8 and int(sinks.run_id(), 16) >= 0
    empty = table_or_empty(spark, str(tmp_path / "none"), SNAPSHOT)
    assert empty.count() == 0 and with_columns(df, SNAPSHOT).columns[:2] == ["id", "predicted"] and len(with_columns(df, SNAPSHOT).columns) == 2 + len(SNAPSHOT)


def test_limits_and_subsets(spark):
    df = spark.range(5)
    assert [R.limited(df, n, "id").count() for n in (0, None, 2)] == [5, 5, 2]
    assert R.is_subset(spark.range(3), df) and not R.is_subset(df, spark.range(3))


def test_thumbnails(spark, tmp_path):
    left = np.zeros((20, 30, 3), np.uint8)
    left[:, :15] = (229, 0, 0)
    left[:5, 15:] = (255, 255, 255)
    (tmp_path / "a.ppm").write_bytes(b"P6\n30 20\n255\n" + left.tobytes())
    (tmp_path / "b.ppm").write_bytes(b"P6\n4 4\n255\n" + bytes(48))
    (tmp_path / "c.ppm").write_bytes(b"no image")
    got = {r["path"][-5]: r for r in I.image_figures(Q.images(spark, str(tmp_path))).collect()}
    assert got["a"]["colours"] == ["red", "black", "white"] and got["b"]["colours"] == ["black"] and got["c"]["brightness"] is None
    assert got["a"]["brightness"] == pytest.approx(0.5 * 229 * 0.299 + 0.125 * 255, rel=1e-6) and got["a"]["edges"] > 0 == got["b"]["edges"]
    assert got["a"]["value"] == pytest.approx(0.5 * 229 + 0.125 * 255) and got["b"]["hue_entropy"] == pytest.approx(0, abs=1e-5)
    words = spark.createDataFrame([("p", "Bac", 90.0, 0.1), ("p", "bac", 50.0, 0.9), ("p", "x", 10.0, 0.5), ("p", "2024", 80.0, 0.5)], "path string, word string, confidence double, y double")
    r = I.merged_words(words).first()
    assert (r["word_count"], r["words"], r["top"], r["middle"], r["bottom"]) == (2, ["2024", "bac"], 1, 1, 1)


def test_gram_and_small_functions(spark):
    df = spark.createDataFrame([("Ab  c",)], "t string")
    assert df.select(C.char_grams(F.col("t")).alias("g")).first()["g"] == [" ", "a", "b", " ", " a", "ab", "b ", " ", "c", " ", " c", "c "]
    assert df.select(C.severity(F.lit(60.0)).alias("a"), C.available(F.lit(" ")).alias("b"), C.mean_pooled(F.array().cast("array<array<double>>")).alias("c")).first()[:2] == ("high", 0)


def test_search_where_a_list_gives_nothing(spark, tmp_path):
    place = tmp_path / "cursus_search_client.py"
    place.write_text("def page(list_id, token):\n    return ([] if list_id == 'gone' else ['x']), None\ndef search(list_id, token):\n    return ['s1', 's2'], None\n")
    spark.sparkContext.addPyFile(str(place))
    got = remote.paged_or_searched(spark, "cursus_search_client:page", "cursus_search_client:search", ["a", "gone"]).collect()
    assert sorted((r["list_id"], r["mode"], r["record"]) for r in got) == [("a", "list", "x"), ("gone", "search", "s1"), ("gone", "search", "s2")]


def test_budget_without_a_group(spark):
    r = np.random.default_rng(2)
    kinds = [str(k) for k in r.choice(["list", "search", "odd"], 300)]
    df = spark.createDataFrame(list(enumerate(kinds)), "n int, kind string").repartition(5)
    spent, want = 0, []
    for i, k in enumerate(kinds):
        spent += remote.UNITS.get(k, 0)
        want += [i] * (spent <= 2500)
    assert sorted(x["n"] for x in remote.within_budget(df, 2500, "n", bins=8).collect()) == want


def test_newest_state_by_stream(spark, tmp_path):
    from cursus.streaming.snapshots import upsert_latest

    held = []
    batch = upsert_latest(lambda: held[-1] if held else None, lambda df: held.append(spark.createDataFrame(df.collect(), df.schema)))
    for rows in ([("a", "2024-01-02", 1), ("b", "2024-01-01", 2)], [("a", "2024-01-01", 3), ("b", "2024-01-05", 4)]):
        batch(spark.createDataFrame(rows, "video_id string, snapshot_date string, n long"), 0)
    assert {r["video_id"]: r["n"] for r in held[-1].collect()} == {"a": 1, "b": 4}
