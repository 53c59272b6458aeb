"""Text and embedding features, search over parameters, blended models, and what is read from their errors."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..sources.sinks import scratch
from .statistics import in_test, pipeline, regression_metrics


def grams(text: Column) -> Column:
    """Words of two characters or more in lower case, then pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    pairs = lambda w: F.concat(w, F.filter(F.transform(w, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))), lambda x: x.isNotNull()))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def fit_tfidf(df: DataFrame, text: str, most: int = 30, least_df: int = 10, highest_df: float = 0.5, small: int = 20) -> dict[str, float]:
    """Smoothed idf of the `most` commonest terms, by term in order; ties in frequency go by term.

    Below `small` texts no term is too rare or too common. Only `most` rows come to the driver.
    """
    n = df.count()
    rare, common = (1, 1.0) if n < small else (least_df, highest_df)
    terms = df.select(grams(F.col(text)).alias("g"))
    in_all = terms.select(F.explode("g").alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    in_texts = terms.select(F.explode(F.array_distinct("g")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    chosen = in_texts.where((F.col("df") >= rare) & (F.col("df") <= common * n)).join(in_all, "term").orderBy(F.desc("total"), "term").limit(most)
    return {r["term"]: float(np.log((1 + n) / (1 + r["df"])) + 1) for r in sorted(chosen.collect(), key=lambda r: r["term"])}


def tfidf(df: DataFrame, text: str, idf: dict[str, float], name: str = "tfidf") -> DataFrame:
    """df with an array of the terms' weights, sublinear and of unit length. One projection; nothing is shuffled."""
    # Of a text's words and pairs only those that are terms stay; each term is counted among them once.
    counts = F.transform(F.array(*map(F.lit, idf)), lambda t: F.size(F.filter("__g", lambda x: x == t))) if idf else F.array().cast("array<int>")
    scales = F.array(*map(F.lit, idf.values())).cast("array<double>")
    weights = F.zip_with(counts, scales, lambda n, w: F.when(n > 0, (1 + F.log(n.cast("double"))) * w).otherwise(0.0))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("__v", lambda x: F.coalesce(F.try_divide(x, F.col("__n")), F.lit(0.0)))
    known = F.filter(grams(F.col(text)), lambda x: x.isin(list(idf)) if idf else F.lit(False))
    return df.withColumn("__g", known).withColumn("__v", weights).withColumn("__n", norm).withColumn(name, unit).drop("__g", "__v", "__n")


def fit_components(df: DataFrame, column: str, most: int = 100, name: str = "components"):
    """A fitted model of principal components of an array column: centred first, as the transform does not do it.

    There are at most as many components as rows and dimensions. Signs are arbitrary.
    """
    vectors = df.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("__vector"))
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector_to_array("__vector"))).alias("d")).first()
    k = min(most, shape["n"], shape["d"] or 0)
    if k < 1:
        raise ValueError("no vectors to fit components on")
    centre = StandardScaler(inputCol="__vector", outputCol="__centred", withMean=True, withStd=False)
    return Pipeline(stages=[centre, PCA(k=k, inputCol="__centred", outputCol=name)]).fit(vectors)


def components(model, df: DataFrame, column: str) -> DataFrame:
    """df with the array of components that the model names; null stays null."""
    name = model.stages[-1].getOutputCol()
    some = df.where(F.col(column).isNotNull()).withColumn("__vector", array_to_vector(F.col(column).cast("array<double>")))
    done = model.transform(some).withColumn(name, vector_to_array(name)).drop("__vector", "__centred")
    return done.unionByName(df.where(F.col(column).isNull()), allowMissingColumns=True)


def _once(df: DataFrame, name: str) -> DataFrame:
    """The table written and read back: each fit reads its rows several times, and what made them, joins say, runs once."""
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def trials(space: dict, n: int, seed: int = 42) -> list[dict]:
    """n draws of parameters: from a list, any of them; from (low, high), whole numbers where both are, and else by
    the logarithm."""
    r = random.Random(seed)

    def one(v):
        if isinstance(v, list):
            return r.choice(v)
        low, high = v
        return r.randint(low, high) if isinstance(low, int) and isinstance(high, int) else float(np.exp(r.uniform(np.log(low), np.log(high))))

    return [{k: one(v) for k, v in space.items()} for _ in range(n)]


def side_by_side(spark: SparkSession, work: Callable, items: Iterable, at_once: int) -> list:
    """work of each item, in their order; the jobs of `at_once` of them run at a time."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(work), i) for i in items]  # each with job properties of its own
        return [s.result() for s in started]


def search(df: DataFrame, key: str, features: list[str], target: str, model: str, tried: list[dict], seed: str = "search", gap: float = 0.1, penalty: float = 0.5, at_once: int = 4) -> list[dict]:
    """The tried parameters with their r2 on a validation part, best first; r2 on the training part that is more than
    `gap` above it costs `penalty` times the rest. Both parts are scored in one pass a trial, and `at_once` trials share
    the cluster, so that one's last tasks don't keep the others waiting."""
    trial = trial_of(df, key, features, target, model, seed, gap, penalty)
    return sorted(side_by_side(df.sparkSession, trial, tried, at_once), key=lambda t: -t["score"])


def trial_of(df: DataFrame, key: str, features: list[str], target: str, model: str, seed: str = "search", gap: float = 0.1, penalty: float = 0.5) -> Callable[[dict], dict]:
    """A function that fits and scores one set of parameters as `search` does."""
    marked = _once(df.withColumn("__held", in_test(key, seed)).select(*dict.fromkeys([*features, target, "__held"])), "trials")

    def trial(params: dict) -> dict:
        fitted = pipeline(features, target, model, **params).fit(marked.where(~F.col("__held")))
        e, y = F.col(target) - F.col("predicted"), F.col(target)
        r2 = {r["__held"]: r["r2"] for r in fitted.transform(marked).groupBy("__held").agg((1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2")).collect()}
        held, own = r2.get(True), r2.get(False)
        if held is None or own is None:
            raise ValueError("too few rows, or a constant target, in one of the parts")
        return {"params": params, "r2": held, "r2_training": own, "score": held - max(0.0, (own - held - gap) * penalty)}

    return trial


def predicted_by(fitted: dict, df: DataFrame) -> DataFrame:
    """df with a column of predictions for each named model: one pass, no joins."""
    for name, model in fitted.items():
        df = model.transform(df).drop("features").withColumnRenamed("predicted", name)
    return df


def blend(weights: dict[str, float]) -> Column:
    """The weighted sum of columns of predictions."""
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def blends(df: DataFrame, target: str, choices: dict[str, dict[str, float]]) -> DataFrame:
    """A row of metrics for each named choice of weights."""
    out = None
    for name, weights in choices.items():
        one = regression_metrics(df.withColumn("__p", blend(weights)), target, "__p").select(F.lit(name).alias("blend"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def best_weights(df: DataFrame, columns: list[str], target: str, steps: int = 2000) -> dict[str, float]:
    """Weights of at least 0 that sum to 1 with the least squared error, from one pass over the rows."""
    e = [F.col(c) - F.col(target) for c in columns]  # weights sum to 1, so the errors blend alike
    sums = df.agg(*[F.avg(a * b) for i, a in enumerate(e) for b in e[i:]]).first()
    m, at = np.zeros((len(columns),) * 2), 0
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            m[i, j] = m[j, i] = sums[at] or 0.0
            at += 1
    w, rate = np.full(len(columns), 1 / len(columns)), 1 / max(np.linalg.norm(m, 2) * 2, 1e-12)
    for _ in range(steps):  # projected gradient on the simplex
        v = w - rate * 2 * m @ w
        u = np.sort(v)[::-1]
        over = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
        w = np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)
    return dict(zip(columns, map(float, w), strict=True))


def stack(df: DataFrame, key: str, features: list[str], target: str, bases: dict[str, tuple[str, dict]], folds: int = 5, seed: str = "stack", at_once: int = 4):
    """(fitted bases, fitted second model, out-of-fold predictions). bases: name -> (model, parameters).

    Each row's predictions for the second model come from bases that did not see its fold; `at_once` folds are fitted at a time.
    """
    fold = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % folds
    marked = _once(df.withColumn("__fold", fold), "stack")

    def part(k: int) -> DataFrame:
        fitted = {n: pipeline(features, target, m, **p).fit(marked.where(F.col("__fold") != k)) for n, (m, p) in bases.items()}
        return predicted_by(fitted, marked.where(F.col("__fold") == k))

    out = reduce(DataFrame.unionByName, side_by_side(df.sparkSession, part, range(folds), at_once)).drop("__fold")
    second = pipeline(list(bases), target, "ridge", regParam=0.0).fit(out)
    return {n: pipeline(features, target, m, **p).fit(marked) for n, (m, p) in bases.items()}, second, out


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mean, population deviation, least and greatest error."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("low"), F.max(e).alias("high"))


def importance_by_category(weights: dict[str, float], categories: dict[str, tuple]) -> dict[str, float]:
    """Importance by category, highest first; a feature is in the first category one of whose parts its name holds."""
    out: dict[str, float] = {}
    for feature, w in weights.items():
        name = next((c for c, parts in categories.items() if any(p in feature for p in parts)), "other")
        out[name] = out.get(name, 0.0) + w
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def label_codes(df: DataFrame, column: str, name: str):
    """(fitted codes, df with a code for each label in alphabetical order); unknown and null ones come last."""
    model = StringIndexer(inputCol=column, outputCol=name, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    return model, model.transform(df).withColumn(name, F.col(name).cast("long"))


def suggestion(actual: Column, wanted: Column, still: float = 0.01) -> Column:
    """Which way a feature should move towards its predicted ideal."""
    gap = wanted - actual
    return F.when(F.abs(gap) < still, "No change").when(gap > 0, F.concat(F.lit("Increase by "), F.round(gap, 2).cast("string"))).otherwise(F.concat(F.lit("Decrease by "), F.round(-gap, 2).cast("string")))


def ideal_features(df: DataFrame, given: list[str], targets: list[str], model: str = "forest", **params) -> dict:
    """One fitted regressor for each target: what a successful video of these inputs looks like."""
    return {t: pipeline(given, t, model, **params).fit(df) for t in targets}


def suggestions(fitted: dict, df: DataFrame) -> DataFrame:
    """A row for each row and target: feature, actual, wanted, suggestion."""
    asked = predicted_by({f"__{t}": m for t, m in fitted.items()}, df)
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("feature"), F.col(t).cast("double").alias("actual"), F.col(f"__{t}").alias("wanted")) for t in fitted]))
    return asked.withColumn("__s", pairs).select(*df.columns, "__s.*").withColumn("suggestion", suggestion(F.col("actual"), F.col("wanted")))
