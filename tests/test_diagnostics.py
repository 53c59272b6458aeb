"""Power transforms, normality and the profile of what was lost, against plain versions."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import diagnostics as D
from cursus.operators import practices as P


def test_probit(spark):
    shares = [1e-9, 0.001, 0.024, 0.0243, 0.3, 0.5, 0.77, 0.9758, 0.99999]
    got = [r["z"] for r in spark.createDataFrame([(i, p) for i, p in enumerate(shares)], "i int, p double").select("i", D.probit(F.col("p")).alias("z")).orderBy("i").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in shares], abs=1e-8)


def test_likelihoods_and_best_power(spark):
    r = random.Random(5)
    x = [math.exp(r.gauss(1, 0.6)) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*x, None, -3.0, 0.0]], "v double").repartition(3)
    for row in D.power_likelihoods(df, "v").collect():
        lam, a = row["power"], np.array(x)
        y = np.log(a) if lam == 0 else (a**lam - 1) / lam
        assert row["n"] == 400 and row["likelihood"] == pytest.approx((lam - 1) * np.log(a).sum() - 200 * np.log(y.var()))
    best = D.best_power(df, "v")
    assert abs(best["power"]) < 0.2 and abs(best["skewness_after"]) < 0.2 < best["skewness"]
    assert D.power_likelihoods(df.limit(0), "v").where("likelihood IS NOT NULL").count() == 0


def test_normality(spark):
    r = random.Random(6)
    for values in ([r.gauss(3, 2) for _ in range(300)], [float(r.randint(0, 5)) for _ in range(300)], [r.expovariate(1) for _ in range(200)]):
        v = np.sort(values)
        rank = np.array([np.flatnonzero(v == x).mean() + 1 for x in v])
        m = np.array([NormalDist().inv_cdf((k - 0.375) / (len(v) + 0.25)) for k in rank])
        got = D.normality(spark.createDataFrame([(x,) for x in values] + [(None,)], "v double"), "v").first()
        assert got["n"] == len(v) and got["statistic"] == pytest.approx(np.corrcoef(m, v)[0, 1] ** 2, abs=1e-9)
    assert D.normality(spark.createDataFrame([(2.0,)] * 9, "v double"), "v").first()["statistic"] is None


def test_lost_profile(spark):
    rows = [("a", "درس bac درس", None, False, True), ("a", "درس شرح", "x", None, True), ("b", "none", "BAC", False, True), ("b", "bac", "", True, True), ("b", "bac", "", False, False), (None, None, None, False, True)]
    got = {(r["part"], r["value"]): (r["n"], r["pct"]) for r in P.lost_profile(spark.createDataFrame(rows, "c string, title string, description string, kept boolean, wanted boolean"), "kept", "wanted", "c", ("bac", "zz")).collect()}
    assert got == {("category", "a"): (2, 50.0), ("category", "b"): (1, 25.0), ("category", None): (1, 25.0), ("marker", "bac"): (2, 50.0), ("marker", "zz"): (0, 0.0), ("word", "درس"): (3, 75.0), ("word", "شرح"): (1, 25.0)}
