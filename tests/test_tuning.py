"""Search that learns from its trials: densities against plain ones, and better results than random draws at equal fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import models as M
from cursus.operators import tuning as T

SPACE = {"rate": (0.001, 1.0), "depth": (1, 20), "kind": ["a", "b", "c"]}


def truth(p):
    return -((math.log(p["rate"]) - math.log(0.05)) ** 2) - 0.1 * (p["depth"] - 13) ** 2 - (0 if p["kind"] == "b" else 3)


def plain_density(values, low, high, x):
    """A mixture of normal densities cut to the space, by numpy."""
    v = np.sort(values)
    around = np.concatenate([[low], v, [high]])
    widths = np.clip(np.maximum(np.diff(around)[1:], np.diff(around)[:-1]), (high - low) / min(100, len(v) + 2), high - low)
    m, w = np.append(v, (low + high) / 2), np.append(widths, high - low)
    grid = np.linspace(low, high, 20_001)
    kernels = np.exp(-((grid[:, None] - m) ** 2) / (2 * w**2))
    kernels /= np.trapezoid(kernels, grid, axis=0)
    return np.interp(x, grid, kernels.mean(axis=1))


def test_densities():
    r = random.Random(1)
    for space, values in (((0.001, 1.0), [math.exp(r.uniform(math.log(0.001), 0)) for _ in range(9)]), ((1, 20), r.choices(range(1, 21), k=7)), ((1, 20), [])):
        p = T.Parzen(values, space)
        at = (lambda x: x) if space == (1, 20) else math.log
        for _ in range(20):
            x = p.draw(r)
            assert space[0] <= x <= space[1] and isinstance(x, type(space[0]))
            assert math.exp(p.log_density(x)) == pytest.approx(plain_density([at(v) for v in values], at(space[0]), at(space[1]), at(x)), rel=1e-3)
    choices = T.Parzen(["b", "b", "c"], ["a", "b", "c"])
    assert [math.exp(choices.log_density(c)) for c in "abc"] == pytest.approx([1 / 6, 3 / 6, 2 / 6])


def test_learned_draws_beat_random_ones(spark):
    gains = []
    for seed in range(10):
        trial = lambda p: {"params": p, "score": truth(p)}
        learned = T.parzen_search(spark, trial, SPACE, 40, seed, at_once=2)
        assert len(learned) == 40 and learned == sorted(learned, key=lambda t: -t["score"])
        gains.append(learned[0]["score"] - max(truth(p) for p in M.trials(SPACE, 40, seed)))
    assert sum(g >= 0 for g in gains) >= 8 and np.mean(gains) > 0.1


def test_halving_spends_less_and_keeps_the_best(spark):
    spent = []

    def trial(p):
        spent.append(p["trees"])
        return {"params": p, "score": truth(p) - 1 / p["trees"]}

    for seed in range(5):
        spent.clear()
        found = T.halving_search(spark, trial, SPACE, 27, ("trees", 3, 27), seed=seed, at_once=1)
        assert len(found) == 27 and sum(t["fits"] for t in found) == sum(spent) < 27 * 27 / 2
        full = [t for t in found if t["params"]["trees"] == 27]
        assert full and found[: len(full)] == full and all(t["rung"] == 2 for t in full)
        # Where effort costs all the same, the best that any rung has seen has gone to the top, or was drawn last of all.
        best = max(found, key=lambda t: truth(t["params"]))
        assert truth(full[0]["params"]) >= truth(best["params"]) - 1e-9 or best["rung"] < 2
        again = T.halving_search(spark, trial, SPACE, 27, ("trees", 3, 27), seed=seed, at_once=1)
        assert again == found


def test_models_are_tuned(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") * 7) % 11).cast("double").alias("z")).withColumn("y", F.col("x") * F.col("x") + F.col("z")).cache()
    found = T.tuned(df, "id", ["x", "z"], "y", "boosted", {"stepSize": (0.05, 0.5), "maxDepth": (2, 4)}, 3, effort=("maxIter", 1, 3), at_once=3)
    assert len(found) == 3 and found[0]["params"]["maxIter"] == 3 and found[0]["score"] >= found[-1]["score"]
    assert [t["score"] for t in T.tuned(df, "id", ["x", "z"], "y", "ridge", {"regParam": (0.01, 10.0)}, 3)] == sorted((t["score"] for t in T.tuned(df, "id", ["x", "z"], "y", "ridge", {"regParam": (0.01, 10.0)}, 3)), reverse=True)
