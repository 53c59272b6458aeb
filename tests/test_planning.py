"""Planned videos: their questions, and practices against a plain version that goes question by question."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import planning as P
from cursus.operators import retrieval as V


def plain_practices(questions, base, k, least=3):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = set()
    for plan in sorted({q[0] for q in questions}):
        seen, found = set(), [[], [], []]
        for _, subject, _, n, asked in sorted((q for q in questions if q[0] == plan), key=lambda q: q[2]):
            scored = sorted((-round(float(unit(asked) @ unit(v)), 6), i, of) for i, v, of in base)
            nr = next(q[2] for q in questions if q[0] == plan and q[4] == asked and q[3] == n)
            for less, i, of in scored[:n]:
                if i in seen:
                    continue
                seen.add(i)
                of = (of or "").lower()
                tier = 2 if of == "" else 1 if of == "global" else 0 if of == (subject or "").lower() else None
                if tier is not None:
                    found[tier].append((i, nr, round(-less, 4), ("own", "general", "any")[tier]))
        own, general = len(found[0]), len(found[1])
        usable = found[0] + (found[1] if own < least else []) + found[2]
        for place, (i, nr, score, bucket) in enumerate(sorted(usable, key=lambda r: -r[2])[:k], 1):
            out.add((plan, place, i, bucket, nr, score, own, own < least and general > 0, len(usable)))
    return out


@pytest.mark.parametrize("k", [1, 5, 50])
def test_practices_are_the_plain_ones(spark, k):
    r = random.Random(k)
    vector = lambda: [r.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(4)]
    base = [(f"c{i:03}", vector(), r.choice(["Maths", "maths", "global", "GLOBAL", "Physics", "", None])) for i in range(120)]
    base += [("d1", base[0][1], "Maths"), ("d2", base[0][1], None)]  # equal scores
    questions = [(p, s, nr, n, vector()) for p, s in ((1, "Maths"), (2, "physics"), (3, ""), (4, None), (5, "History")) for nr, n in enumerate((3, 3, 2, 2, 2, 1)) if r.random() < 0.9]
    got = P.planned_practices(spark.createDataFrame(questions, "plan_id long, subject string, nr int, k int, asked array<double>").repartition(3), spark.createDataFrame(base, "chunk_id string, embedding array<double>, subject string").repartition(2), "chunk_id", k)
    assert {tuple(x) for x in got.collect()} == plain_practices(questions, base, k)


def test_questions_that_are_asked(spark):
    videos = spark.createDataFrame([(1, "Limits", "Maths", "x" * 900, 120.0), (2, None, "", None, None)], "video_id long, title string, subject string, description string, wpm double")
    rows = P.planned_questions(videos, "video_id", F.col("wpm").isNotNull()).collect()
    assert [(r["nr"], r["k"]) for r in rows if r["plan_id"] == 1] == [(0, 3), (1, 3), (2, 2), (3, 2), (4, 2), (5, 1)]
    assert [r["part"] for r in rows if r["plan_id"] == 2] == ["title", "timing", "duration"]
    own = {r["part"]: r["question"] for r in rows if r["plan_id"] == 1}
    assert own["title"].endswith("Limits") and "Maths" in own["subject"] and own["description"].count("x") == 500
    assert {r["part"] for r in P.planned_questions(videos, "video_id").collect() if r["plan_id"] == 1} == {"title", "subject", "description", "timing", "duration"}


def test_practices_for_videos_by_their_texts(spark):
    chunks = [("t", "title", "Maths", "Title optimization for exams"), ("u", "timing", None, "Best upload days hours timing"), ("g", "title", "global", "Title optimization in general"), ("p", "title", "Physics", "Title optimization for optics")]
    base = V.embedded(spark.createDataFrame(chunks, V.CHUNK), "content")
    videos = spark.createDataFrame([(7, "exams", "maths", ""), (8, "nothing", "History", "")], "video_id long, title string, subject string, description string")
    got = {}
    for r in P.practices_for(videos, base, "video_id").collect():
        got.setdefault(r["plan_id"], []).append((r["chunk_id"], r["bucket"]))
    assert set(got[7]) == {("t", "own"), ("g", "general"), ("u", "any")} and set(got[8]) == {("g", "general"), ("u", "any")}
