"""Chunks of the knowledge base from files of practices: one file a subject, a global one, and older ones of a category each.

Each kind of file has its own chunks. All are projections of the files' rows: a file is read as nested maps, and a row comes out for each
chunk. What a file lacks gives no chunk, and a figure that is missing reads N/A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The parts of a subject's file, the comparisons that a part may hold, and names of subjects' files.
CATEGORIES = ("title_optimization", "video_duration", "upload_timing", "content_delivery", "description_optimization", "content_strategy")
COMPARISONS = ("overall_comparison", "title_length", "length_analysis")
SUBJECTS = ("Maths", "Physics", "Science", "Arabic", "French", "English", "Philosophy", "History")
#: Labels of the figures in a chunk, with the names that they have in a file.
SUMMARY = (("Total videos", "total_videos"), ("High performers", "high_performers"), ("Average engagement", "avg_engagement_score"))
COMPARED = (("High performers median", "high_median"), ("Low performers median", "low_median"), ("Difference", "difference_pct"))
OF_SUBJECT = (("Total videos analyzed", "total_videos", ""), ("Optimal duration", "optimal_duration_minutes", " minutes"), ("Optimal title length", "optimal_title_length", " characters"), ("Exam-focused ratio", "exam_focused_ratio", "%"))
OF_FEATURE = (("High performers mean", "high_mean", ""), ("Low performers mean", "low_mean", ""), ("Difference", "difference_pct", "%"), ("Statistically significant", "significant", ""), ("Effect size", "effect_interpretation", ""))
CHUNK = "array<struct<chunk_id:string,category:string,type:string,subject:string,content:string>>"


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def _at(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _figure(m: Column, key: str) -> Column:
    """A figure as the file has it; true and false with a capital."""
    v = _at(m, key)
    return F.coalesce(F.when(v.isin("true", "false"), F.initcap(v)).otherwise(v), F.lit("N/A"))


def _lines(*parts) -> Column:
    """Lines of text, each ended."""
    return F.concat(*[F.concat(*(x if isinstance(x, tuple) else (x,)), F.lit("\n")) for x in (tuple(F.lit(y) if isinstance(y, str) else y for y in (p if isinstance(p, tuple) else (p,))) for p in parts)])


def _chunk(there: Column, chunk_id: Column, category: Column, kind: str, subject: Column, content: Column) -> Column:
    """One chunk or none, as an array."""
    row = F.struct(chunk_id.alias("chunk_id"), category.alias("category"), F.lit(kind).alias("type"), subject.cast("string").alias("subject"), content.alias("content"))
    return F.when(F.coalesce(there, F.lit(False)), F.array(row)).otherwise(F.array().cast(CHUNK))


def _each(m: Column, line) -> Column:
    """The lines of a map's entries, in the file's order."""
    return F.array_join(F.transform(F.map_entries(m), line), "")


def _keywords(json: Column, after: str) -> Column:
    impact = F.from_json(json, "map<string,struct<lift_pct:double>>")
    rising = F.map_filter(impact, lambda k, v: v["lift_pct"] > 0)
    return _each(rising, lambda e: F.concat(F.lit("  - '"), e["key"], F.lit("': +"), F.format_string("%.1f", e["value"]["lift_pct"]), F.lit(f"% {after}\n")))


def subject_chunks(subject: Column, data: Column) -> Column:
    """A summary, and of each part its recommendations, comparisons and keywords."""
    out = [_chunk(F.lit(True), F.concat(subject, F.lit("_summary")), F.lit("subject_summary"), "subject_summary", subject, _lines(("Subject: ", subject), *[(f"{label}: ", _figure(data, key)) for label, key in SUMMARY]))]
    for name in CATEGORIES:
        part = _map(_at(data, name))
        head = (("Subject: ", subject), f"Category: {name}")
        said = F.from_json(_at(part, "recommendations"), "array<string>")
        out.append(_chunk(said.isNotNull(), F.concat(subject, F.lit(f"_{name}_recommendations")), F.lit(name), "recommendations", subject, F.concat(_lines(*head, "Recommendations:"), F.array_join(said, "\n"))))
        for key in COMPARISONS:
            c = _map(_at(part, key))
            enough = (F.size(c) > 0) & (F.coalesce(_at(c, "insufficient_data"), F.lit("false")) != "true")
            figures = [(f"{label}: ", _figure(c, of), "%" if of == "difference_pct" else "") for label, of in COMPARED]
            out.append(_chunk(enough, F.concat(subject, F.lit(f"_{name}_{key}")), F.lit(name), "statistical_analysis", subject, _lines(*head, ("Metric: ", F.coalesce(_at(c, "feature"), F.lit(key))), *figures)))
        impact = _at(part, "keyword_impact")
        out.append(_chunk(impact.isNotNull(), F.concat(subject, F.lit(f"_{name}_keywords")), F.lit(name), "keyword_analysis", subject, F.concat(_lines(*head, "Keyword Impact:"), _keywords(impact, "lift"))))
    return F.concat(*out)


def category_chunks(category: Column, data: Column, subject: Column) -> Column:
    """The chunks of a file of one category, or of one part of the global file."""
    of = lambda name: F.concat(category, F.lit(f"_{name}"))
    head = ("Category: ", category)
    said = F.from_json(_at(data, "recommendations"), "array<string>")
    out = [_chunk(F.size(said) > 0, of("recommendations"), category, "recommendations", subject, F.concat(_lines(head, "Recommendations:"), F.array_join(said, "\n")))]

    def rows(json: Column, row) -> Column:
        return F.coalesce(F.transform(F.map_entries(_map(json)), row), F.array().cast(CHUNK))

    def of_subject(e: Column) -> Column:
        m = _map(e["value"])
        top = F.from_json(_at(m, "top_channels"), "map<string,double>")
        named = F.when(top.isNotNull(), F.concat(_lines("Top performing channels:"), _each(top, lambda c: F.concat(F.lit("  - "), c["key"], F.lit(": "), F.format_string("%.2f", c["value"]), F.lit("\n"))))).otherwise("")
        content = F.concat(_lines(("Subject: ", e["key"]), *[(f"{label}: ", _figure(m, key), after) for label, key, after in OF_SUBJECT]), named)
        return F.struct(F.concat(F.lit("subject_"), e["key"]).alias("chunk_id"), F.lit("subject_specific").alias("category"), F.lit("subject_insights").alias("type"), F.coalesce(subject, e["key"]).alias("subject"), content.alias("content"))

    def of_feature(e: Column) -> Column:
        m = _map(e["value"])
        content = _lines(("Feature: ", e["key"]), head, *[(f"{label}: ", _figure(m, key), after) for label, key, after in OF_FEATURE])
        return F.struct(F.concat(category, F.lit("_"), e["key"]).alias("chunk_id"), category.alias("category"), F.lit("feature_analysis").alias("type"), subject.cast("string").alias("subject"), content.alias("content"))

    out.append(F.when(category == "subject_specific", rows(_at(data, "subjects"), of_subject)).otherwise(F.array().cast(CHUNK)))
    out.append(rows(_at(data, "feature_analysis"), of_feature))
    impact, days, hours, bins = (_at(data, k) for k in ("keyword_impact", "by_day", "top_hours", "by_duration_bin"))
    out.append(_chunk(impact.isNotNull(), of("keywords"), category, "keyword_analysis", subject, F.concat(_lines(head, "Keyword Impact Analysis:"), _keywords(impact, "engagement lift"))))
    day = lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": avg engagement "), _figure(_map(e["value"]), "avg_engagement"), F.lit("\n"))
    out.append(_chunk(days.isNotNull(), of("days"), category, "timing_analysis", subject, F.concat(_lines(head, "Best Upload Days:"), _each(_map(days), day))))
    out.append(_chunk(hours.isNotNull(), of("hours"), category, "timing_analysis", subject, _lines(head, ("Best Upload Hours: ", F.regexp_replace(hours, r",\s*", ", ")))))
    length = lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": avg engagement "), _figure(_map(e["value"]), "mean"), F.lit(", count: "), _figure(_map(e["value"]), "count"), F.lit("\n"))
    out.append(_chunk(bins.isNotNull(), of("duration_bins"), category, "duration_analysis", subject, F.concat(_lines(head, "Engagement by Video Duration:"), _each(_map(bins), length))))
    return F.concat(*out)


def practice_chunks(files: DataFrame, subjects: tuple = SUBJECTS) -> DataFrame:
    """(chunk_id, category, type, subject, content) of files (name, value): name is that of a subject, 'global', or any other, which
    makes it a file of one category. Texts that are no JSON object give none."""
    none = F.lit(None).cast("string")
    whole = F.concat(*[F.when(_at(F.col("data"), c).isNotNull(), category_chunks(F.lit(c), _map(_at(F.col("data"), c)), F.lit("global"))).otherwise(F.array().cast(CHUNK)) for c in CATEGORIES])
    older = category_chunks(F.coalesce(_at(F.col("data"), "category"), F.concat("name", F.lit("_best_practices"))), F.col("data"), none)
    data = files.select("name", _map(F.col("value")).alias("data")).where("data IS NOT NULL")
    own = data.where(F.col("name").isin(*subjects)).select(F.inline(subject_chunks(F.col("name"), F.col("data"))))
    rest = data.where(~F.col("name").isin(*subjects)).select(F.inline(F.when(F.col("name") == "global", whole).otherwise(older)))
    return own.unionByName(rest)
