"""What successful videos do: usage of words and forms, durations, delivery, exam focus, and the report of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.sinks import markdown_report
from .relational import group_quantiles
from .statistics import compare_columns, compare_groups

#: Features of delivery, and those of them that count only above 0.
DELIVERY = ("speech_rate_wpm", "question_density", "example_density", "explanation_density", "lexical_diversity", "flesch_reading_ease", "avg_words_per_sentence")
POSITIVE = ("speech_rate_wpm", "lexical_diversity")
#: What a thumbnail's figures should be between.
THUMBNAIL = {"brightness": (80, 180), "contrast": (0.15, 0.35), "saturation": (80, 160), "word_count": (1, 5), "font_size": (25, 60), "saliency": (0.08, 0.25), "edge_contrast": (15, 50)}


def usage(df: DataFrame, tests: dict[str, Column], level: str = "level") -> DataFrame:
    """(form, high_pct, low_pct, lift_pct) of boolean columns by name, in one pass. Where no low video has the form the
    lift is 100, or 0 where no high one has it either; a null test is false."""
    share = lambda t, g: F.coalesce(F.avg(F.when(F.col(level) == g, F.coalesce(t, F.lit(False)).cast("double"))), F.lit(0.0))
    one = df.agg(*[F.struct(share(t, "High").alias("h"), share(t, "Low").alias("l")).alias(f"s{i}") for i, t in enumerate(tests.values())])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("form"), F.col(f"s{i}.h").alias("h"), F.col(f"s{i}.l").alias("l")) for i, n in enumerate(tests)])))
    lift = F.when(F.col("l") > 0, (F.col("h") - F.col("l")) / F.col("l") * 100).when(F.col("h") > 0, 100.0).otherwise(0.0)
    return rows.select("form", (F.col("h") * 100).alias("high_pct"), (F.col("l") * 100).alias("low_pct"), lift.alias("lift_pct"))


def title_forms(title: Column, keywords) -> dict[str, Column]:
    return {"question": F.contains(title, F.lit("?")), "number": title.rlike(r"\d")} | {k: F.contains(F.lower(title), F.lit(k)) for k in keywords}


def subject_durations(df: DataFrame, subject: str, minutes: str, level: str = "level", least: int = 10) -> DataFrame:
    """Quartiles of the high videos' minutes by subject, where there are `least` of them."""
    high = df.where(F.col(level) == "High").select(subject, F.col(minutes).cast("double").alias("__m"))
    out = group_quantiles(high, subject, "__m", [0.25, 0.5, 0.75]).where(F.col("n") >= least)
    return out.select(subject, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "n")


#: Right ends of the seven duration bins, in minutes; 0 is in none.
DURATION_BINS = (5, 10, 15, 20, 30, 60)


def duration_bin(minutes: Column) -> Column:
    out = F.when(~(minutes > 0) | minutes.isNull(), F.lit(None).cast("string"))
    for low, high in zip((0, *DURATION_BINS), DURATION_BINS, strict=False):
        out = out.when(minutes <= high, f"{low}-{high}")
    return out.otherwise(f"{DURATION_BINS[-1]}+")


def timing(df: DataFrame, at: str, score: str) -> DataFrame:
    """(part, value, n, mean_score) by day of the week and by hour, in one pass."""
    parts = F.array(F.struct(F.lit("day").alias("part"), F.date_format(at, "EEEE").alias("value")), F.struct(F.lit("hour").alias("part"), F.hour(at).cast("string").alias("value")))
    rows = df.where(F.col(at).isNotNull()).select(score, F.explode(parts).alias("p"))
    return rows.groupBy(F.col("p.part").alias("part"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def usage_by(df: DataFrame, group: str, tests: dict[str, Column], level: str = "level") -> DataFrame:
    """usage within each group, in one pass."""
    share = lambda t, g: F.coalesce(F.avg(F.when(F.col(level) == g, F.coalesce(t, F.lit(False)).cast("double"))), F.lit(0.0))
    one = df.groupBy(group).agg(*[F.struct(share(t, "High").alias("h"), share(t, "Low").alias("l")).alias(f"s{i}") for i, t in enumerate(tests.values())])
    rows = one.select(group, F.inline(F.array(*[F.struct(F.lit(n).alias("form"), F.col(f"s{i}.h").alias("h"), F.col(f"s{i}.l").alias("l")) for i, n in enumerate(tests)])))
    lift = F.when(F.col("l") > 0, (F.col("h") - F.col("l")) / F.col("l") * 100).when(F.col("h") > 0, 100.0).otherwise(0.0)
    return rows.select(group, "form", (F.col("h") * 100).alias("high_pct"), (F.col("l") * 100).alias("low_pct"), lift.alias("lift_pct"))


def delivery(df: DataFrame, features=DELIVERY, level: str = "level", least: int = 6) -> DataFrame:
    """A row of comparison for each feature that df has, all from one reading; rates count only above 0."""
    values = {f: F.when(F.col(f) > 0, F.col(f)) if f in POSITIVE else F.col(f) for f in features if f in df.columns}
    if not values:
        return df.sparkSession.createDataFrame([], "feature string")
    return compare_columns(df, level, "High", "Low", values, least).withColumn("effect", C.effect_label(F.col("cohens_d")))


def focus_impact(df: DataFrame, focused: str, score: str) -> DataFrame:
    """Mean scores of focused and other videos, the lift in %, and the p-value; null where either side has under 5."""
    marked = df.withColumn("__f", F.when(F.col(focused) == 1, "yes").when(F.col(focused) == 0, "no"))
    c = compare_groups(marked, "__f", "yes", "no", score)
    enough = F.col("p_value").isNotNull()
    return c.select(*[F.when(enough, F.col(a)).alias(b) for a, b in (("high_mean", "focused_mean"), ("low_mean", "other_mean"), ("diff_pct", "lift_pct"))], "p_value", (F.col("p_value") < 0.05).alias("significant"))


def summary(df: DataFrame, at: str, subject: str, channel: str, score: str, transcript: str | None = None) -> DataFrame:
    """One row on the whole table."""
    missing = [F.count_if(F.col(transcript) == 0).alias("missing_transcripts")] if transcript else []
    return df.agg(F.count("*").alias("total_videos"), F.min(at).alias("first"), F.max(at).alias("last"), F.countDistinct(channel).alias("channels"), F.countDistinct(subject).alias("subjects"), F.avg(score).alias("mean_score"), *missing)


def enough_videos(df: DataFrame, subject: str, level: str = "level", least: int = 30, high: int = 10) -> DataFrame:
    """The rows of subjects that have enough videos to be studied alone; one row a subject is joined."""
    some = df.groupBy(subject).agg(F.count("*").alias("n"), F.count_if(F.col(level) == "High").alias("h")).where((F.col("n") >= least) & (F.col("h") >= high))
    return df.join(some.select(subject), subject, "left_semi")


def band(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "increase").when(value > high, "reduce").when(value.isNotNull(), "good")


def thumbnail_advice(df: DataFrame) -> DataFrame:
    """df with advice on each thumbnail figure that it has; no words at all ask for some, no type has no size."""
    special = {"word_count": lambda v: F.when(v == 0, "add text"), "font_size": lambda v: F.when(v <= 0, F.lit(None).cast("string")), "edge_contrast": lambda v: F.when(v >= 15, "good")}
    out = {}
    for name, (low, high) in THUMBNAIL.items():
        if name in df.columns:
            v = F.col(name)
            plain = band(v, low, high)
            out[f"{name}_advice"] = special[name](v).otherwise(plain) if name in special else plain
    return df.withColumns(out)


def recommendations(forms: list[dict], durations: list[dict], features: list[dict], focus: dict | None) -> dict[str, list[str]]:
    """Sections of advice from the small results above, each a list of mappings; the caller collects them."""
    titles = [f"'{f['form']}' stands in {f['high_pct']:.0f} % of strong titles, {f['low_pct']:.0f} % of weak ones" for f in sorted(forms, key=lambda f: (-f["lift_pct"], f["form"])) if f["lift_pct"] > 20 and f["high_pct"] >= 5]
    lengths = [f"{d['subject']}: {d['q1']:.1f} to {d['q3']:.1f} minutes, {d['median']:.1f} in the middle" for d in sorted(durations, key=lambda d: str(d["subject"]))]
    speech = [f"{f['feature']}: {f['high_median']:.3g} against {f['low_median']:.3g} ({f['effect']})" for f in features if f["p_value"] is not None and f["p_value"] < 0.05]
    exams = [f"Exam focus changes the score by {focus['lift_pct']:.0f} %"] if focus and focus["significant"] else []
    return {"Titles": titles, "Durations": lengths, "Delivery": speech, "Strategy": exams}


def lost_profile(df: DataFrame, kept: str, wanted: str, category: str, markers: tuple, words: int = 15) -> DataFrame:
    """(part, value, n, pct) of the rows (title, description, ...) that a filter rejected and a reviewer wanted: their
    categories, in how many each marker stands, and the commonest Arabic words of their titles. pct is of these rows."""
    lost = df.where(~F.coalesce(F.col(kept), F.lit(False)) & F.coalesce(F.col(wanted), F.lit(False)))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    by_category = lost.groupBy(F.col(category).alias("value")).agg(F.count("*").alias("n")).select(F.lit("category").alias("part"), "value", "n")
    one = lost.agg(F.count("*").alias("total"), *[F.count_if(F.contains(text, F.lit(m))).alias(f"m{i}") for i, m in enumerate(markers)])
    by_marker = one.select(F.lit("marker").alias("part"), F.inline(F.array(*[F.struct(F.lit(m).alias("value"), F.col(f"m{i}").alias("n")) for i, m in enumerate(markers)])))
    named = lost.select(F.explode(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("[\u0600-\u06ff]+"), 0)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    by_word = named.orderBy(F.desc("n"), "value").limit(words).select(F.lit("word").alias("part"), "value", "n")
    rows = by_category.unionByName(by_marker).unionByName(by_word)
    return rows.crossJoin(F.broadcast(one.select("total"))).select("part", "value", "n", (F.col("n") * 100 / F.col("total")).alias("pct"))


def report(title: str, facts: dict, sections: dict[str, list[str]]) -> str:
    return markdown_report(title, {k: str(v) for k, v in facts.items()}, sections)
