"""The lesson, statistics and retrieval operators on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import lessons as O
from cursus.operators import relational as R
from cursus.operators import retrieval as V
from cursus.operators import statistics as S

VIDEO = "video_id string, title string, description string, tags string, channel_id string, duration_sec long"


def test_filter_rules(spark):
    rows = [
        ("short", "bac 2025", None, None, "a", 60), ("none", "bac 2025", None, None, "a", None), ("exam", "BAC 2025", "", "", "a", 600),
        ("other", "درس 1 متوسط", None, None, "b", 600), ("both", "bac and bem", None, None, "b", 600), ("strong", "bac blanc et bem", None, None, "b", 600),
        ("quiet", "intégrales", None, None, "b", 600), ("soft", "intégrales", None, None, "a", 600), ("lost", "x", None, None, None, 600),
    ]
    channels = spark.createDataFrame([("a", "Maths")], "channel_id string, subject string")
    got = {r["video_id"]: r for r in O.filter_videos(spark.createDataFrame(rows, VIDEO), O.FilterConfig(), channels).collect()}
    want = {"short": ("non_bac", 0.8), "none": ("non_bac", 0.8), "exam": ("bac_3as", 0.95), "other": ("non_bac", 0.9), "both": ("non_bac", 0.5), "strong": ("bac_3as", 0.75), "quiet": ("unknown", 0.4), "soft": ("bac_3as_ambiguous", 0.65), "lost": ("unknown", 0.4)}
    assert {k: (r["filter_category"], r["filter_confidence"]) for k, r in got.items()} == want
    assert got["soft"]["filter_reason"].endswith("(duration >= 120s, channel subject: Maths)") and got["quiet"]["subject"] == "Unknown"
    only = O.FilterConfig(exam=("never",), other=("bem",), strong=("blanc",))
    again = {r["video_id"]: r["filter_confidence"] for r in O.filter_videos(spark.createDataFrame(rows, VIDEO), only).collect()}
    assert again["strong"] == 0.7 and again["both"] == 0.9


def test_config_file(tmp_path):
    path = tmp_path / "filter.yaml"
    path.write_text("channel_prior: {bac_threshold: 0.6}\nmarkers: {bac: [x, 3], non_bac: [y], strong_bac_intent: [z]}\n")
    config = O.FilterConfig.from_yaml(str(path))
    assert config.exam == ("x", "3") and config.heavy_min == 0.6
    path.write_text("markers: {bac: [], non_bac: [y], strong_bac_intent: [z]}\n")
    with pytest.raises(ValueError):
        O.FilterConfig.from_yaml(str(path))
    with pytest.raises(FileNotFoundError):
        O.FilterConfig.from_yaml(str(tmp_path / "absent.yaml"))


def test_transcripts(spark):
    rows = [(1, "So we solve it. Like this? Par exemple la fonction.", 3.0, "Maths"), (2, "window.ytcfg = 1", 9.0, None), (3, " ", 9.0, None), (4, None, 9.0, None), (5, "var is one marker", 0.0, "Physics")]
    df = spark.createDataFrame(rows, "id int, text string, duration_sec double, subject string")
    got = {r["id"]: r for r in O.transcript_features(df, subject="subject").collect()}
    assert [got[i]["transcript_word_count"] for i in range(1, 6)] == [10, None, None, None, 4]
    one = got[1]
    assert (one["transcript_sentence_count"], one["question_count"], one["example_count"], one["domain_keyword_count"], one["speech_rate_wpm"]) == (3, 1, 2, 1, 200.0)
    assert one["speech_rate_above_optimal"] == 1 and got[5]["speech_rate_wpm"] is None
    assert one["example_density"] == pytest.approx(2 / 3) and one["technical_term_density"] == pytest.approx(0.1)


def test_captions(spark):
    text = "WEBVTT\n\n1:00\n00:01.0 --> 00:02.0\n<c>hello</c>\nhello\n world \nvar x\nNOTE no\nhello"
    rows = O.clean_captions(spark.createDataFrame([("v", text), ("n", None)], "id string, t string"), "id", "t").collect()
    assert {r["id"]: r["text"] for r in rows} == {"v": "hello world hello", "n": ""}


def test_subjects_and_tips(spark):
    df = spark.createDataFrame([(" MATH ",), ("physics",)], "s string")
    assert [r[0] for r in df.select(O.canonical_subject(F.col("s"))).collect()] == ["Maths", "Physics"]
    with pytest.raises(Exception, match="unknown subject"):
        spark.createDataFrame([("alchemy",)], "s string").select(O.canonical_subject(F.col("s"))).collect()
    tips = spark.createDataFrame([("bac", 3, None, True)], "t string, m int, d string, f boolean")
    assert tips.select(O.quick_tips(F.col("t"), F.col("m"), F.col("d"), F.col("f"))).first()[0] == "title_short,keywords_ok,duration_short,description_add,exam_focus"


def test_merge_and_registry(spark):
    schema = "id string, day string, n int"
    a, b = spark.createDataFrame([("x", "1", 1), ("y", None, 2)], schema), spark.createDataFrame([("x", "2", 3)], schema)
    assert O.merge_snapshots(a, b, "append", "id", "day", "n").count() == 3
    assert {(r["id"], r["n"]) for r in O.merge_snapshots(a, b, "dedupe", "id", "day", "n").collect()} == {("x", 3), ("y", 2)}
    with pytest.raises(ValueError):
        O.merge_snapshots(a, b, "other", "id", "day", "n")
    known = spark.createDataFrame([("x", 1, 1)], "key string, first_seen int, last_seen int")
    seen = spark.createDataFrame([("x", 5), ("z", 4), ("z", 6)], "key string, at int")
    assert {tuple(r) for r in O.registry_upsert(known, seen).collect()} == {("x", 1, 5, False), ("z", 4, 6, True)}


def test_mid_ranks_any_bins(spark):
    r = np.random.default_rng(1)
    values = [int(x) for x in r.integers(0, 40, 300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "id int, v int")
    want = {i: sum(x < v for x in values) + (values.count(v) + 1) / 2 for i, v in enumerate(values)}
    for bins in (2, 64):
        assert {x["id"]: x["mid_rank"] for x in R.mid_ranks(df, "v", bins).collect()} == want


def test_groups_too_small(spark):
    df = spark.createDataFrame([("High", 1.0)] * 3 + [("Low", 2.0)] * 9, "g string, v double")
    assert S.compare_groups(df, "g", "High", "Low", "v").first()["p_value"] is None
    same = spark.createDataFrame([("High", 1.0)] * 9 + [("Low", 1.0)] * 9, "g string, v double")
    row = S.compare_groups(same, "g", "High", "Low", "v").first()
    assert (row["p_value"], row["cohens_d"]) == (1.0, 0.0)


def test_selection(spark):
    r = np.random.default_rng(0)
    x, y, z = r.normal(size=(3, 400))
    rows = [(float(a), float(b), float(2 * a), 1.0, float(a + b + 0.1 * c)) for a, b, c in zip(x, y, z)]
    df = spark.createDataFrame(rows, "a double, b double, twice double, one double, mix double")
    assert S.select_by_vif(df, df.columns) in (["a", "b"], ["b", "mix"], ["a", "mix"])
    assert S.select_by_vif(df.where("false"), df.columns) == []


def test_train(spark):
    rows = [(i, float(i % 7), float(i % 5), 2.0 * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    model, metrics, _ = S.train(df, "id", ["a", "b"], "y", numTrees=5, maxDepth=5)
    assert metrics.first()["r2"] > 0.9 and next(iter(S.importances(model, ["a", "b"]))) == "a"


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "Maths_best_practices.json").write_text(json.dumps({"titles": "short titles with bac", "pace": "speak slowly"}))
    (tmp_path / "combined_best_practices.json").write_text("{}")
    base = V.embedded(V.knowledge_base(spark, str(tmp_path)), "content")
    asked = base.where("category = 'pace'").first()["embedding"]
    assert V.retrieve(base, asked, 1).first()["category"] == "pace" and V.retrieve(base, asked, 5, category=F.col("category") == "titles").count() == 1


def test_priority(spark):
    schema = "id string, subject string, score double"
    hits = spark.createDataFrame([("a", "m", 0.2), ("a", "m", 0.3), ("b", "global", 0.9), ("c", "p", 0.8)], schema)
    assert [r["id"] for r in V.prioritised(hits, "id", "subject", "m", 5).collect()] == ["b", "a"]
    full = spark.createDataFrame([(str(i), "m", 0.1 * i) for i in range(4)] + [("b", "global", 0.9)], schema)
    assert {r["subject"] for r in V.prioritised(full, "id", "subject", "m", 5).collect()} == {"m"}
    assert V.prioritised(spark.createDataFrame([("c", "p", 0.8)], schema), "id", "subject", "m", 5).count() == 1


def test_exact_quantiles(spark):
    r = np.random.default_rng(3)
    values = [float(x) for x in np.round(r.normal(size=501), 2)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for bins in (2, 64):
        got = R.exact_quantiles(df, "v", [0.0, 0.33, 0.5, 0.9, 1.0], bins).first()["q"]
        assert got == pytest.approx(np.quantile(values, [0.0, 0.33, 0.5, 0.9, 1.0]))
    assert R.exact_quantiles(df.where("v IS NULL"), "v", [0.5]).first()["q"] == [None]
    assert R.exact_quantiles(df.limit(1), "v", [0.5]).first()["q"] == [values[0]]
