"""Retrieval for planned videos: all their questions at once, and each plan's practices from what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as V

#: The questions on a planned video in their order, each with the words before the video's own and its number of rows.
QUESTIONS = (
    ("title", "Title optimization for: ", 3),
    ("subject", "Best practices for ", 3),
    ("description", "Video content optimization: ", 2),
    ("delivery", "Speaking pace speech rate lexical diversity content delivery", 2),
    ("timing", "Best upload days hours timing", 2),
    ("duration", "Video duration optimal length minutes", 1),
)
#: What follows the subject in its question, characters of a description that are asked with, and rows of the subject's own that make the general ones unneeded.
AFTER_SUBJECT, DESCRIPTION_CHARS, ENOUGH = " educational videos", 500, 3


def planned_questions(videos: DataFrame, key: str, metrics: Column | None = None) -> DataFrame:
    """(plan_id, subject, nr, part, question, k) of videos (key, title, subject, description), in long form. A question whose part
    the video lacks isn't asked: subject and description where they are empty, delivery unless `metrics` is true."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = {"title": said("title"), "subject": F.concat(said("subject"), F.lit(AFTER_SUBJECT)), "description": F.left(said("description"), F.lit(DESCRIPTION_CHARS))}
    asked = {"subject": said("subject") != "", "description": said("description") != "", "delivery": F.coalesce(metrics, F.lit(False)) if metrics is not None else F.lit(False)}
    rows = [
        F.when(asked.get(part, F.lit(True)), F.struct(F.lit(nr).alias("nr"), F.lit(part).alias("part"), F.concat(F.lit(words), own.get(part, F.lit(""))).alias("question"), F.lit(k).alias("k")))
        for nr, (part, words, k) in enumerate(QUESTIONS)
    ]
    return videos.select(F.col(key).alias("plan_id"), said("subject").alias("subject"), F.inline(F.array_compact(F.array(*rows))))


def planned_practices(questions: DataFrame, base: DataFrame, key: str, k: int = 5, least: int = ENOUGH) -> DataFrame:
    """For each plan the practices that its questions find, best first: (plan_id, place, key, bucket, nr, score, own,
    general_used, candidates).

    questions: (plan_id, subject, nr, k, asked), one row a question with its vector and the rows that it asks for. base: (key, embedding,
    subject). A practice that several questions find is the first one's, by nr, with that one's score. The plan's own subject
    comes first, then the general one ('global', only if fewer than `least` are the plan's own), then practices without a subject;
    those of other subjects are left out. Then the score decides, to four digits, and of equals that order. A plan gathers no more rows
    than its questions ask for.
    """
    named = ["plan_id", "nr", "subject"]
    kinds = ", ".join(f"{c} {dict(questions.dtypes)[c]}" for c in named)
    asked = questions.select(F.to_json(F.struct(*named)).alias("question_id"), "asked", "k")
    found = V.best_per_question(asked, base, key, "k").withColumn("question_id", F.from_json("question_id", kinds))
    hits = found.join(base.select(key, F.col("subject").alias("of")), key)
    of, own = F.lower(F.coalesce("of", F.lit(""))), F.lower(F.coalesce("question_id.subject", F.lit("")))
    bucket = F.when(of == "", 2).when(of == "global", 1).when(of == own, 0)
    seen = F.struct(F.col("question_id.nr").alias("nr"), "rank", F.col(key).alias("key"), F.round("score", 4).alias("score"), bucket.alias("bucket"))
    plans = hits.groupBy(F.col("question_id.plan_id").alias("plan_id")).agg(F.sort_array(F.collect_list(seen)).alias("seen"))

    def first_seen(hits: Column) -> Column:
        keys = F.transform(hits, lambda h: h["key"])
        return F.filter(hits, lambda h, i: (F.array_position(keys, h["key"]) == i + 1) & h["bucket"].isNotNull())

    count = lambda b: F.size(F.filter("once", lambda h: h["bucket"] == b))
    plans = plans.withColumn("once", first_seen(F.col("seen"))).withColumn("own", count(0)).withColumn("general_used", (F.col("own") < least) & (count(1) > 0))
    usable = F.filter("once", lambda h: (h["bucket"] != 1) | F.col("general_used"))
    by_score = F.transform(usable, lambda h: F.struct((-h["score"]).alias("less"), h["bucket"].alias("bucket"), h["nr"].alias("nr"), h["rank"].alias("rank"), h["key"].alias("key")))
    best = plans.withColumn("best", F.sort_array(by_score)).withColumn("candidates", F.size("best")).withColumn("best", F.slice("best", 1, k))
    rows = best.select("plan_id", "own", "general_used", "candidates", F.posexplode("best").alias("at", "b"))
    name = F.element_at(F.array(F.lit("own"), F.lit("general"), F.lit("any")), F.col("b.bucket") + 1)
    return rows.select("plan_id", (F.col("at") + 1).alias("place"), F.col("b.key").alias(key), name.alias("bucket"), "b.nr", (-F.col("b.less")).alias("score"), "own", "general_used", "candidates")


def practices_for(videos: DataFrame, base: DataFrame, key: str, embed=None, metrics: Column | None = None, k: int = 5) -> DataFrame:
    """planned_practices of videos (key, title, subject, description) by their texts; each distinct question is embedded once."""
    questions = V.embedded(planned_questions(videos, key, metrics), "question", embed).withColumnRenamed("embedding", "asked")
    return planned_practices(questions, base, "chunk_id", k)
