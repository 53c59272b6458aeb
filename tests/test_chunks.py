"""Chunks of the three kinds of files of practices."""

import json

from cursus.operators import chunks

PART = {
    "recommendations": ["first", "second"], "title_length": {"feature": "title_length", "high_median": 41.0, "low_median": 38, "difference_pct": 7.5},
    "keyword_impact": {"bac": {"lift_pct": 12.34}, "sum": {"lift_pct": -3}, "شرح": {"lift_pct": 1}},
}
SUBJECT = {"total_videos": 90, "high_performers": 31, "title_optimization": PART, "video_duration": {"overall_comparison": {"insufficient_data": True}}, "other": 1}
TIMING = {"recommendations": [], "by_day": {"Monday": {"avg_engagement": 2.5}, "Friday": {}}, "top_hours": [18, 9], "by_duration_bin": {"5-10": {"mean": 1.5, "count": 7}}}
DELIVERY = {"category": "content_delivery", "recommendations": ["slowly"], "feature_analysis": {"pace": {"high_mean": 1, "low_mean": 2.0, "difference_pct": -50, "significant": True, "effect_interpretation": "large"}}}
INSIGHTS = {"category": "subject_specific", "subjects": {"Maths": {"total_videos": 5, "top_channels": {"a": 2, "b": 1.256}}}}


def test_chunks_of_each_kind_of_file(spark):
    files = [("Maths", SUBJECT), ("global", {"upload_timing": TIMING, "title_optimization": PART}), ("content_delivery", DELIVERY), ("subject_specific", INSIGHTS), ("old", {"recommendations": ["x"]})]
    rows = [(n, json.dumps(v, ensure_ascii=False)) for n, v in files] + [("Physics", "no json"), ("French", None)]
    found = chunks.practice_chunks(spark.createDataFrame(rows, "name string, value string")).collect()
    got = {(r["subject"], r["chunk_id"]): r for r in found}
    assert len(got) == len(found)
    text = {k: r["content"] for k, r in got.items()}
    assert {k for k in text if k[0] == "Maths"} == {("Maths", f"Maths_{x}") for x in ("summary", "title_optimization_recommendations", "title_optimization_title_length", "title_optimization_keywords")} | {("Maths", "subject_Maths")}
    assert text["Maths", "Maths_summary"] == "Subject: Maths\nTotal videos: 90\nHigh performers: 31\nAverage engagement: N/A\n"
    assert text["Maths", "Maths_title_optimization_recommendations"] == "Subject: Maths\nCategory: title_optimization\nRecommendations:\nfirst\nsecond"
    assert text["Maths", "Maths_title_optimization_title_length"].endswith("Metric: title_length\nHigh performers median: 41.0\nLow performers median: 38\nDifference: 7.5%\n")
    assert text["Maths", "Maths_title_optimization_keywords"].endswith("Keyword Impact:\n  - 'bac': +12.3% lift\n  - 'شرح': +1.0% lift\n")
    assert {k[1] for k in text if k[0] == "global"} == {"upload_timing_days", "upload_timing_hours", "upload_timing_duration_bins", "title_optimization_recommendations", "title_optimization_keywords"}
    assert text["global", "upload_timing_days"] == "Category: upload_timing\nBest Upload Days:\n  - Monday: avg engagement 2.5\n  - Friday: avg engagement N/A\n"
    assert text["global", "upload_timing_hours"].endswith("Best Upload Hours: [18, 9]\n") and text["global", "upload_timing_duration_bins"].endswith("  - 5-10: avg engagement 1.5, count: 7\n")
    assert text[None, "content_delivery_pace"] == "Feature: pace\nCategory: content_delivery\nHigh performers mean: 1\nLow performers mean: 2.0\nDifference: -50%\nStatistically significant: True\nEffect size: large\n"
    assert text["Maths", "subject_Maths"].endswith("Exam-focused ratio: N/A%\nTop performing channels:\n  - a: 2.00\n  - b: 1.26\n")
    assert text[None, "old_best_practices_recommendations"] == "Category: old_best_practices\nRecommendations:\nx" and len(text) == 13
    assert {r["type"] for r in found} == {"subject_summary", "recommendations", "statistical_analysis", "keyword_analysis", "timing_analysis", "duration_analysis", "feature_analysis", "subject_insights"}
