"""The vector index: exact search against numpy, recall and bytes read of the approximate one, awkward rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import vector_index as I


def plain(base, questions, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    return {(q, r, i, s) for q, asked in questions for r, (s, i) in enumerate(sorted(((round(float(unit(asked) @ unit(v)), 6), i) for i, v in base if v), key=lambda x: (-x[0], x[1]))[:k], 1)}


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    middles = r.normal(size=(25, 16)) * 4
    rows = [(f"v{i:04}", (middles[i % 25] + r.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(f"w{i:04}", rows[7][1]) for i in range(400)]  # one list holds far more than the others
    rows += [("none", None)]
    return rows, spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)


def test_index(spark, clustered, tmp_path):
    rows, base = clustered
    path = f"file://{tmp_path}/index"
    I.build(base, "id", path, 25)
    assert {i for r in I.lists_of(spark, path).select("ids").collect() for i in r["ids"]} == {i for i, v in rows if v}
    asked = [(i, rows[i][1]) for i in range(0, 3000, 50)] + [(5000, [0.1] * 16)]
    questions = spark.createDataFrame([*asked, (5001, None)], "question_id int, asked array<double>")
    want = plain(rows, asked, 10)
    exact = {(r["question_id"], r["rank"], r["k"], r["score"]) for r in I.search(spark, path, questions, 10, probes=1, exact=True).collect()}
    assert {x[:3] for x in exact} == {x[:3] for x in want}
    near = {(r["question_id"], r["rank"], r["k"], r["score"]) for r in I.search(spark, path, questions, 10, probes=3).collect()}
    assert len({(q, i) for q, _, i, _ in near} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    size = lambda lists: sum(os.path.getsize(r["f"].removeprefix("file://")) for r in lists.select(F.input_file_name().alias("f")).distinct().collect())
    few = I.lists_of(spark, path, [0, 1, 2])
    assert size(few) < 0.5 * size(I.lists_of(spark, path))
    assert "list#" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def test_a_k_for_each_question_and_few_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(20)]
    path = f"file://{tmp_path}/index"
    I.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", path)
    questions = spark.createDataFrame([(f"q{i}", rows[i][1], i * 9) for i in range(4)], "question_id string, asked array<double>, n int")
    for probes in (1, 2, 50):
        got = {(x["question_id"], x["rank"], x["k"]) for x in I.search(spark, path, questions, "n", probes=probes, exact=True).collect()}
        assert got == {x[:3] for i in range(4) for x in plain(rows, [(f"q{i}", rows[i][1])], i * 9)}


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Vectors without clusters leave little to prune: it takes most lists to find nine in ten of the nearest."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    path = f"file://{tmp_path}/index"
    I.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", path, 20)
    asked = [x for x in rows if x[0] % 50 == 0]
    want = {x[:3:2] for x in plain(rows, asked, 10)}
    found = {n: {(x["question_id"], x["k"]) for x in I.search(spark, path, spark.createDataFrame(asked, "question_id long, asked array<float>"), 10, probes=n).collect()} for n in (4, 14, 20)}
    assert found[20] == want and len(found[14] & want) >= 0.9 * len(want) and len(found[4] & want) >= 0.5 * len(want)
