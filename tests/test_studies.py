"""Models, practices, sinks, the paginated source and the retry queue on small cases with known answers."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import models as M
from cursus.operators import practices as P
from cursus.operators import statistics as S
from cursus.sources import remote, sinks
from cursus.streaming import retries


def test_tfidf(spark):
    df = spark.createDataFrame([("Red red apple",), ("green apple",), (None,), ("x",)], "t string")
    idf = M.fit_tfidf(df, "t")
    assert list(idf) == sorted(["red", "apple", "green", "red red", "red apple", "green apple"])
    assert idf["apple"] == pytest.approx(math.log(5 / 3) + 1)
    got = [r["tfidf"] for r in M.tfidf(df, "t", idf).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1) and got[2] == got[3] == [0.0] * 6
    w = dict(zip(idf, got[0], strict=True))
    assert w["red"] / w["red apple"] == pytest.approx(1 + math.log(2))
    assert M.fit_tfidf(df.where("false"), "t") == {} and M.tfidf(df, "t", {}).first()["tfidf"] == []


def test_components(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5)) * [5, 2, 1, 1, 1] + 3
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(-1, None)], "id int, e array<double>")
    got = {y["id"]: y["components"] for y in M.components(M.fit_components(df, "e", 2), df, "e").collect()}
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert got[-1] is None and np.abs([got[i] for i in range(60)]) == pytest.approx(np.abs((x - x.mean(0)) @ v[:2].T))
    with pytest.raises(ValueError):
        M.fit_components(df.where("e IS NULL"), "e")


@pytest.fixture(scope="module")
def line(spark):
    rows = [(i, float(i % 11), float(i % 7), 3.0 * (i % 11) + (i % 7)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, a double, b double, y double").coalesce(2).cache()


def test_search_and_weights(spark, line):
    tried = M.trials({"maxDepth": [1, 6], "numTrees": (3, 3)}, 4)
    assert tried == M.trials({"maxDepth": [1, 6], "numTrees": (3, 3)}, 4) and {t["numTrees"] for t in tried} == {3}
    found = M.search(line, "id", ["a", "b"], "y", "forest", [{"maxDepth": 1, "numTrees": 3}, {"maxDepth": 6, "numTrees": 3}])
    assert found[0]["params"]["maxDepth"] == 6 and found[0]["score"] >= found[1]["score"]
    df = line.select("y", (F.col("y") + F.col("a")).alias("p"), (F.col("y") - F.col("a")).alias("q"), (F.col("y") * 0 + 99).alias("r"))
    w = M.best_weights(df, ["p", "q", "r"], "y")
    assert w["p"] == pytest.approx(0.5, abs=1e-3) and w["r"] == pytest.approx(0, abs=1e-6)
    rows = {r["blend"]: r for r in M.blends(df, "y", {"half": {"p": 0.5, "q": 0.5}, "one": {"p": 1.0}}).collect()}
    assert rows["half"]["mse"] == pytest.approx(0) and rows["one"]["mse"] > 1
    assert M.residuals(df, "y", "y").first()["std"] == 0


def test_stack(line):
    fitted, second, folds = M.stack(line, "id", ["a", "b"], "y", {"l": ("ridge", {}), "t": ("forest", {"numTrees": 3, "maxDepth": 3})}, folds=3)
    assert folds.count() == 400 and set(fitted) == {"l", "t"}
    assert S.regression_metrics(second.transform(folds), "y", "predicted").first()["r2"] > 0.99


def test_suggestions(spark, line):
    fitted = M.ideal_features(line, ["a"], ["b", "y"], "ridge")
    got = M.suggestions(fitted, line.where("id < 3")).collect()
    assert len(got) == 6 and {r["suggestion"].split()[0] for r in got} <= {"Increase", "Decrease", "No"}
    assert M.importance_by_category({"tfidf_a": 0.5, "hour": 0.2, "tfidf_b": 0.1}, {"text": ("tfidf",)}) == {"text": 0.6, "other": 0.2}
    codes = M.label_codes(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "v", "c")[1]
    assert {r["v"]: r["c"] for r in codes.collect()} == {"a": 0, "b": 1, None: 2}


def test_practices(spark):
    rows = [("High", "bac 2024?", 1, 3.0)] * 6 + [("Low", "intro", 0, 1.0), ("Low", None, 0, 2.0)] * 3
    df = spark.createDataFrame(rows, "level string, title string, focused int, score double")
    got = {r["form"]: r for r in P.usage(df, P.title_forms(F.col("title"), ["bac", "intro", "zzz"])).collect()}
    assert (got["bac"]["high_pct"], got["bac"]["lift_pct"], got["zzz"]["lift_pct"], got["intro"]["lift_pct"]) == (100, 100, 0, -100)
    assert P.focus_impact(df, "focused", "score").first()["lift_pct"] == pytest.approx(100)
    assert P.focus_impact(df.limit(3), "focused", "score").first()["focused_mean"] is None
    rates = df.withColumn("speech_rate_wpm", F.col("score")).withColumn("question_density", F.lit(0.0))
    assert {r["feature"]: r["n_low"] for r in P.delivery(rates).collect()} == {"speech_rate_wpm": 6, "question_density": 6}
    several = P.delivery(rates.withColumn("lexical_diversity", F.lit(None).cast("double")))
    alone = S.compare_groups(rates, "level", "High", "Low", "speech_rate_wpm", 6).first()
    by = {r["feature"]: r.asDict() for r in several.collect()}
    assert {k: by["speech_rate_wpm"][k] for k in alone.asDict()} == alone.asDict()
    assert (by["lexical_diversity"]["n_high"], by["lexical_diversity"]["high_mean"], by["lexical_diversity"]["p_value"]) == (0, None, None)
    text = P.report("Study", {"Videos": 12}, P.recommendations([r.asDict() for r in got.values()], [], [], None))
    assert "- **Videos**: 12" in text and "'bac' stands in 100 %" in text and "Durations" not in text
    look = spark.createDataFrame([(0, 0.0, 10.0, 79.0), (9, 20.0, 99.0, None)], "word_count int, font_size double, edge_contrast double, brightness double")
    assert [tuple(r)[4:] for r in P.thumbnail_advice(look).collect()] == [("increase", "add text", None, "increase"), (None, "reduce", "increase", "good")]


def test_sinks(spark, tmp_path, line):
    at = lambda n: f"file://{tmp_path}/{n}"
    for run in ("1", "2"):
        sinks.write_run(spark.range(int(run)), at("runs"), run)
    assert sinks.latest_run(spark, at("runs")).count() == 2
    assert [sinks.write_new_only(spark.range(1), at("labels"), "x") for _ in range(2)] == [at("labels"), at("labels_x")]
    sinks.write_split(spark.range(10).withColumn("ok", F.col("id") < 3), at("split"), "ok")
    assert sinks.read_split(spark, at("split"), "ok").where("ok").count() == 3
    assert {r["split"]: r["n"] for r in sinks.write_splits(spark.range(10), at("splits"), F.when(F.col("id") < 8, "train").otherwise("test")).collect()} == {"train": 8, "test": 2}
    sinks.save_bundle(spark, S.pipeline(["a"], "y", "ridge").fit(line), {"r2": np.float64(0.5)}, at("bundle"))
    model, about = sinks.load_bundle(spark, at("bundle"))
    assert about == {"r2": 0.5} and model.transform(line).count() == 400
    sinks.write_records(spark.createDataFrame([("m", 1.5)], "subject string, v double"), at("json"), "subject")
    assert spark.read.json(at("json")).first()["v"] == 1.5
    asked = []

    def embed(df):
        asked.append(df.count())
        return df.withColumn("embedding", F.array(F.length("t").cast("float")))

    for texts in (["a", "bb", "a", None], ["bb", "ccc"]):
        assert sinks.cached_embeddings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", at("cache"), embed).count() == len(set(texts))
    assert asked == [3, 1]
    for rows in ([(1,), (2,)], [(2,), (3,)]):
        sinks.append_checkpoint(spark.createDataFrame(rows, "id int"), at("batches"), 0)
    assert sinks.read_checkpoint(spark, at("batches"), "id").count() == 3


@pytest.fixture()
def client(spark, tmp_path):
    place = tmp_path / "cursus_test_client.py"
    place.write_text(
        "import json\n"
        "def page(list_id, token):\n"
        "    k = int(token or 0)\n"
        "    items = [json.dumps({'id': f'{list_id}{k}{i}', 'snippet': {'title': 't'}, 'statistics': {'viewCount': '7', 'likeCount': 'x'}}) for i in range(2)]\n"
        "    return items, (str(k + 1) if k < 2 else None)\n"
        "def details(ids):\n"
        "    if 13 in ids:\n"
        "        raise ValueError('no')\n"
        "    return [{'id': i, 'twice': 2 * i} for i in ids]\n"
    )
    spark.sparkContext.addPyFile(str(place))
    return "cursus_test_client"


def test_paged_source(spark, client):
    df = remote.paged(spark, f"{client}:page", ["u", "v"])
    assert df.count() == 12 and df.agg(F.max("page")).first()[0] == 2
    assert remote.paged(spark, f"{client}:page", ["u", "v"], 3).groupBy("list_id").count().where("count = 3").count() == 2
    assert remote.paged(spark, f"{client}:page", []).count() == 0
    row = remote.flat_videos(df.where("list_id = 'u'").orderBy("record").limit(1)).first()
    assert (row["video_id"], row["title"], row["view_count"], row["like_count"], row["tags"], row["duration"]) == ("u00", "t", 7, 0, "", "PT0S")


def test_enriched(spark, client):
    got = remote.enriched(spark.range(23), "id", f"{client}:details", "id long, twice long", size=5, batches=2).collect()
    failed = [r for r in got if r["error"]]
    lost = set(map(int, failed[0]["failed_ids"].split(",")))
    assert len(failed) == 1 and 13 in lost and {r["id"]: r["twice"] for r in got if not r["error"]} == {i: 2 * i for i in set(range(23)) - lost}


def test_remote_tables(spark):
    answer = json.dumps({"items": [{"snippet": {"topLevelComment": {"snippet": {"textDisplay": "hi"}}}}]})
    assert [tuple(r) for r in remote.top_comments(spark.createDataFrame([("a", answer), ("b", "{}")], "id string, record string"), "id").collect()] == [("a", "hi", 0)]
    tracks = [("a", "en", False, "vtt", "1"), ("a", "ar", True, "vtt", "2"), ("a", "fr", False, "json3", "3"), ("a", "fr", False, "vtt", "4"), ("a", "de", False, "vtt", "5"), ("b", "de", True, "x", "6")]
    df = spark.createDataFrame(tracks, "id string, language string, automatic boolean, format string, url string")
    assert {r["id"]: r["url"] for r in remote.caption_choice(df, "id").collect()} == {"a": "4", "b": "6"}
    asked = spark.createDataFrame([(1, "list"), (2, "search"), (3, "list"), (4, "odd")], "n int, kind string")
    assert {r["kind"]: r["units"] for r in remote.units(asked).collect()} == {"list": 2, "search": 100, "odd": 0}
    assert [r["n"] for r in remote.within_budget(asked, 100, "n").collect()] == [1]


def test_retry_queue(spark, tmp_path):
    spark.createDataFrame([("a", False, "timeout"), ("b", False, "No transcript"), ("c", False, "x"), ("c", True, None), ("d", False, "x"), ("d", False, "x"), ("d", False, "x")], "video_id string, ok boolean, error string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("video_id string, ok boolean, error string").parquet(f"{tmp_path}/in")
    query = retries.retry_queue(stream, wait_ms=3_600_000).writeStream.format("memory").queryName("retried").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for _ in range(120):  # timeouts by the clock keep such a query busy, so it never says that it is done
            if spark.table("retried").count() >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert {(r["video_id"], r["attempts"], r["action"]) for r in spark.table("retried").collect()} == {("b", 0, "skipped"), ("d", 2, "skipped")}
    assert retries.not_done(spark.range(3), spark.range(2), "id").count() == 1


def test_retry_table(spark):
    rows = [("a", "2024-01-01 00:00:00", False, None), ("b", "2024-01-01 00:00:08", False, None), ("c", "2024-01-01 00:00:00", False, None), ("c", "2024-01-01 00:00:01", True, None), ("d", "2024-01-01 00:00:00", False, "HTML page")]
    df = spark.createDataFrame(rows, "video_id string, at string, ok boolean, error string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r["video_id"]: r["action"] for r in retries.retry_table(df, "2024-01-01 00:00:10").collect()} == {"a": "retry", "b": "wait", "d": "skipped"}
