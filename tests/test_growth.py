"""Plans that must not depend on how small a table looks on disk."""

import random
import re
import shutil

from pyspark.sql import functions as F

from cursus.operators import lessons as O
from cursus.operators import models as M
from cursus.operators import retrieval as V
from cursus.operators import vector_index as I


def joins(df) -> list[str]:
    """The joins of the planned query."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"\w*Join[^\n]*", plan)


def test_terms_move_once(spark, tmp_path):
    """Only the terms' frequencies meet the texts' terms in a join: neither terms of texts nor norms are a side of one."""
    rows = spark.range(200).select(F.col("id"), F.when(F.col("id") % 2 == 0, "red plate").otherwise("old spoon").alias("text"), (F.col("id") % 2 == 0).alias("positive"))
    rows.write.parquet(str(tmp_path / "texts"))
    found = O.discover_terms(spark.read.parquet(str(tmp_path / "texts")), min_df=1)
    assert len(joins(found)) == 1
    assert {r["term"] for r in found.collect()} >= {"r", "re", "pl"} and not {r["term"] for r in found.collect()} & {"s", "o", "sp"}


def test_terms_of_repeated_ids(spark):
    """Rows of one id count as one text for each mark; too few texts have no terms."""
    rows = [(i % 60, "red" if i % 2 else "old", bool(i % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, text string, positive boolean")
    assert [r["term"] for r in O.discover_terms(df, top_n=2, max_df=1.0).collect()] and O.discover_terms(df.limit(30)).count() == 0


def test_index_blocks_meet_by_merge(spark, tmp_path):
    """Blocks of questions and of lists, and what both searches found, are never sent through the driver, however small they look."""
    rows = [(i, [float((i * p) % 17 - 8) for p in (1, 3, 5, 7)]) for i in range(1, 161)]
    base, path = spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path / "index")
    I.build(base, "id", path)
    found = I.search(spark, path, base.where("id % 50 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("asked")), 5, probes=2, exact=True)
    assert joins(found)[0].startswith("SortMergeJoin")  # the outermost: what was found meets what was asked
    near = I.search(spark, path, base.where("id = 50").select(F.col("id").alias("question_id"), F.col("embedding").alias("asked")), 5)
    assert joins(near)[0].startswith("SortMergeJoin")  # the outermost: blocks of a list
    assert {r["question_id"] for r in found.where("rank = 1").collect()} == {50, 100, 150}


def test_fits_read_what_was_joined_once(spark, tmp_path):
    """Search and stacking don't make their rows anew for each fit: the source may be gone once they have begun."""
    rows = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") % 7) * 2.0 + 1).alias("y"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    trial = M.trial_of(df, "id", ["a"], "y", "ridge")
    _, second, folds = M.stack(df, "id", ["a"], "y", {"line": ("ridge", {"regParam": 0.0})}, folds=2)
    shutil.rmtree(tmp_path / "rows")
    assert trial({"regParam": 0.0})["r2"] > 0.99
    assert second.transform(folds).count() == 120 and sorted(folds.columns) == ["a", "id", "line", "y"]


def test_each_word_and_term_is_counted_once(spark):
    """Syllables are one pass over a text's words, and a term's count is one pass over a text's terms."""
    df = spark.createDataFrame([(1, "A banana. But so, however: like a cat?", 6), (2, None, 1)], "id long, text string, duration_sec long")
    plan = O.transcript_features(df).select("example_count", "example_density", "flesch_reading_ease", "gunning_fog_index")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[aeiou") == 1
    got = M.tfidf(df, "text", {"banana": 2.0, "cat": 1.0, "like": 1.0}, "v")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("filter(__g") <= 1
    assert [[round(x, 4) for x in r["v"]] for r in got.orderBy("id").collect()] == [[0.8165, 0.4082, 0.4082], [0.0, 0.0, 0.0]]
    assert [r["v"] for r in M.tfidf(df, "text", {}, "v").collect()] == [[], []]


def test_a_search_writes_each_question_once(spark, tmp_path, monkeypatch):
    """What a search by bounds writes grows with its questions, not with questions times the lists that they want."""
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(600)]  # without clusters nearly all lists are wanted
    base, path = spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path / "index")
    I.build(base, "id", path, 20)
    places = []

    def noted(scratch):
        return lambda *a: places.append(scratch(*a)) or places[-1]

    monkeypatch.setattr(I, "scratch", noted(I.scratch))
    monkeypatch.setattr(V, "scratch", noted(V.scratch))
    asked = base.where("id % 5 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("asked"))
    found = I.search(spark, path, asked, 4, probes=1, exact=True)
    vectors = 0
    for place in places:
        table = spark.read.parquet(place)
        vectors += sum(len(x["ids"]) for x in table.collect()) if "ids" in table.columns else table.count() if "asked" in table.columns else 0
    assert 120 <= vectors <= 5 * 120
    whole = V.best_per_question(asked, base, "id", 4)
    assert {tuple(x) for x in found.collect()} == {tuple(x) for x in whole.select("question_id", "id", "score", "rank").collect()}


def test_frames_of_a_search_are_bounded(spark, tmp_path, monkeypatch):
    """Slices, frames and shelves of the least size give the same rows, also where many rows are copies."""
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(150 + i, rows[i % 3][1]) for i in range(150)]
    base, path = spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path / "index")
    asked = base.where("id % 7 = 0").select(F.col("id").alias("question_id"), F.col("embedding").alias("asked"))
    whole = {tuple(x) for x in V.best_per_question(asked, base, "id", 5).collect()}
    for name, value in {"CELLS": 1, "FRAME_BYTES": 1, "SHELVES": 2, "BLOCK_QUESTIONS": 4, "BLOCK_ROWS": 16}.items():
        monkeypatch.setattr(I, name, value)
    I.build(base, "id", path, 12)
    assert {tuple(x) for x in I.search(spark, path, asked, 5, probes=1, exact=True).select("question_id", "k", "score", "rank").collect()} == {(q, i, s, n) for q, i, s, n in whole}
