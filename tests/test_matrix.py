"""The feature matrix: fitted, saved, loaded, and held to plain numpy."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cursus.operators import matrix as X
from cursus.operators.retrieval import hashing_embedder


@pytest.fixture(scope="module")
def videos(spark):
    r = random.Random(8)
    words = "exam algebra limits physics optics cells tissue revision lesson part".split()
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 6))), r.choice([None, float("nan"), 1.5, 2.0, 7.25]), float(r.randint(0, 900)), 4.0, [r.gauss(0, s) for s in (3, 2, 1, 0.5)] if i % 9 else None) for i in range(60)]
    rows += [(60, None, 1.0, 0.0, 4.0, rows[1][5]), (61, rows[1][1], None, None, None, rows[1][5])]
    return spark.createDataFrame(rows, "video_id int, title string, a double, b double, same double, vector array<double>").repartition(3).cache()


def features(fitted, df):
    rows = fitted.transform(df).select("video_id", F.when(F.col("features").isNotNull(), vector_to_array("features")).alias("x")).collect()
    return {r["video_id"]: None if r["x"] is None else np.array(r["x"]) for r in rows}


def test_scaled_numbers(videos):
    got = {r["video_id"]: r["scaled"] for r in X.Scaled(inputCols=["a", "b", "same"]).fit(videos).transform(videos).collect()}
    plain = videos.select("video_id", "a", "b", "same").toPandas().set_index("video_id").astype(float).fillna(0.0)
    z = (plain - plain.mean()) / plain.std(ddof=0)
    for i, x in got.items():
        assert np.allclose(x, z.loc[i])
    kept = X.Scaled(inputCols=["a", "b", "twice", "three"], selected=True).fit(videos.withColumn("twice", F.col("b") * 2).withColumn("three", F.lit(3)))
    assert kept.names() == ["a", "b"]
    constant = X.Scaled(inputCols=["three"]).fit(videos.withColumn("three", F.lit(0.1)))
    assert {tuple(r["scaled"]) for r in constant.transform(videos.withColumn("three", F.lit(0.1))).collect()} == {(0.0,)}


def test_components_against_numpy(videos):
    fitted = X.Components(inputCol="vector", most=3).fit(videos)
    rows = [(r["vector"], r["components"]) for r in fitted.transform(videos).collect()]
    assert {c is None for v, c in rows if v is None} == {True}
    v, c = (np.array([x for x in col if x is not None]) for col in zip(*rows, strict=True))
    centred = v - v.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :3]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.allclose(c, centred @ axes, atol=1e-8) and fitted.names() == ["embedding_pc0", "embedding_pc1", "embedding_pc2"]


def test_saved_and_loaded(spark, videos, tmp_path):
    fitted = X.feature_matrix(["a", "b", "same"], "title", embedding="vector").fit(videos)
    fitted.write().overwrite().save(f"file://{tmp_path}/m")
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    names, got, again = X.feature_names(fitted), features(fitted, videos), features(loaded, videos)
    assert X.feature_names(loaded) == names and names[:2] == ["a", "b"] and names[-1] == "embedding_pc3"
    for i, x in got.items():
        assert (x is None and again[i] is None) or (np.array_equal(x, again[i]) and len(x) == len(names) and np.isfinite(x).all())
    assert sum(x is None for x in got.values()) == videos.where("vector IS NULL").count()


def test_rows_outside_the_fit_and_statistics_play_no_part(spark, videos):
    fitted = X.feature_matrix(["a", "b"], "title").fit(videos)
    got = features(fitted, videos)
    more = features(fitted, videos.where("video_id < 5").withColumn("view_count", F.lit(None).cast("long")))
    assert len(more) == 5 and all(np.array_equal(got[i], x) for i, x in more.items())
    planned = spark.createDataFrame([(1, "unseen words", None, None)], "video_id int, title string, a double, b double")
    assert np.isfinite(features(fitted, planned)[1]).all()


def test_each_text_is_embedded_once_and_the_embedder_is_not_saved(spark, videos, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.fillna("").map(lambda t: [float(len(t)), float(t.count("a")), float(t.count("e")), 1.0])

    X.Embedded(inputCol="title").using(embed).transform(videos).count()
    stage = X.Embedded(inputCol="title", outputCol="e").using(embed).transform(videos).select("e").collect()
    assert len(stage) == 62 and calls.value <= 2 * videos.select("title").distinct().count()
    model = X.matrix_model(["a", "b"], "title", "score", "ridge", embed=hashing_embedder(8)).fit(videos.withColumn("score", F.length(F.coalesce("title", F.lit(""))).cast("double")))
    model.write().overwrite().save(f"file://{tmp_path}/m")
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    with pytest.raises(RuntimeError, match="embedder"):
        loaded.transform(videos)
    want = {r["video_id"]: r["predicted"] for r in model.transform(videos).collect()}
    got = {r["video_id"]: r["predicted"] for r in X.give_embedder(loaded, hashing_embedder(8)).transform(videos).collect()}
    assert got == pytest.approx(want) and len(got) == 62


def test_importances_by_type(videos):
    df = videos.where("vector IS NOT NULL").withColumn("score", F.coalesce("b", F.lit(0)) * 2 + F.when(F.contains(F.coalesce("title", F.lit("")), F.lit("exam")), 50.0).otherwise(0.0))
    fitted = X.matrix_model(["a", "b"], "title", "score", "forest", embedding="vector", numTrees=5, maxDepth=4).fit(df)
    got = X.importances_by_type(fitted)
    assert set(got) == {"numeric", "text", "embedding"} and sum(p["share"] for p in got.values()) == pytest.approx(1)
    assert next(iter(got["numeric"]["features"])) == "b" and got["numeric"]["share"] > 0.5
