"""Group comparisons, feature selection, splits, models and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import bin_of, bins_for, cuts_of


def erfc(x: Column) -> Column:
    """For x >= 0, the rational approximation of Abramowitz and Stegun 7.1.26; error below 2e-7."""
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


#: Parts in which the rows of one combination of keys meet its cuts, where combinations are many.
SPREAD = 32


def two_group_ranks(two: DataFrame, high: str, low: str, bins: int | None = None, keys: tuple[str, ...] = (), many: bool = False) -> DataFrame:
    """For each distinct v of two (keys, g, v), within the keys: t1 and t0, its rows by group; b1 and b0, those before it;
    n1 and n0, all of a group's rows; mid, a value near the median. Values are ordered inside bins, so no task holds all of
    them, and only the bins' totals meet in one task. Cuts and totals are sent to every task, a number for each bin and
    combination of the keys, so those must be few (names of columns, say); unless `many`, when they are joined, a combination's
    rows being spread over SPREAD parts."""
    bins = bins_for(two, bins)
    counts = two.groupBy(*keys, "v").agg(F.count_if(F.col("g") == high).alias("t1"), F.count_if(F.col("g") == low).alias("t0"))
    cuts = counts.groupBy(*keys).agg(cuts_of("v", bins).alias("cuts"))
    if many:
        parts = cuts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
        cut = counts.withColumn("part", F.pmod(F.hash("v"), F.lit(SPREAD))).join(parts, [*keys, "part"])
    else:
        cut = counts.join(F.broadcast(cuts), list(keys)) if keys else counts.crossJoin(F.broadcast(cuts))
    binned = cut.select(*keys, "v", "t1", "t0", F.get("cuts", F.lit(bins // 2 - 1)).alias("mid"), bin_of(F.col("cuts"), F.col("v"), bins).alias("bin"))
    sums = binned.groupBy(*keys, "bin").agg(F.sum("t1").alias("s1"), F.sum("t0").alias("s0"))
    whole = Window.partitionBy(*keys)
    earlier = lambda c: F.coalesce(F.sum(c).over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = sums.select(*keys, "bin", earlier("s1").alias("e1"), earlier("s0").alias("e0"), F.sum("s1").over(whole).alias("n1"), F.sum("s0").over(whole).alias("n0"))
    inside = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy(*keys, "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = binned.withColumns({"i1": inside("t1"), "i0": inside("t0")}).join(totals if many else F.broadcast(totals), [*keys, "bin"])
    return placed.select(*keys, "v", "t1", "t0", (F.col("e1") + F.col("i1")).alias("b1"), (F.col("e0") + F.col("i0")).alias("b0"), "n1", "n0", "mid")


def compare_groups(df: DataFrame, group: str, high: str, low: str, value: str, least: int = 5) -> DataFrame:
    """One row: means, medians, difference in %, Mann-Whitney p (two-sided, asymptotic, continuity), Cohen's d.

    p and d are null where a group has fewer than `least` values; d is 0 where both have no spread.
    """
    two = df.where(F.col(group).isin(high, low)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return compared(two_group_ranks(two, high, low), least)


def compare_columns(df: DataFrame, group: str, high: str, low: str, values: dict[str, Column], least: int = 5) -> DataFrame:
    """compare_groups for each named value, as a row each, in one reading and one shuffle of df; feature is the name. A
    value that is null everywhere has a row of no counts."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("v")) for n, v in values.items()]))
    two = df.where(F.col(group).isin(high, low)).select(F.col(group).alias("g"), named.alias("x")).select("g", "x.*").where("v IS NOT NULL")
    found = compared(two_group_ranks(two, high, low, keys=("feature",)), least, keys=("feature",))
    names = df.sparkSession.range(1, numPartitions=1).select(F.explode(F.array(*[F.lit(n) for n in values])).alias("feature"))
    return names.join(found, "feature", "left").fillna(0, ["n_high", "n_low"]).fillna(0.0, ["diff_pct"]).select(*found.columns[1:], "feature")


def compared(ranked: DataFrame, least: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The row of compare_groups for each combination of the keys, from two_group_ranks."""
    t = lambda i: F.col(f"t{i}")
    off = F.col("v") - F.col("mid")  # from about the median, so that squares don't cancel
    at = lambda i, rank: F.max(F.when((F.col(f"b{i}") <= rank) & (rank < F.col(f"b{i}") + t(i)), F.col("v")))
    half = lambda i: (F.col(f"n{i}") - 1) / 2
    stats = [x for i in (1, 0) for x in (F.coalesce(F.max(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.sum(t(i) * off).alias(f"o{i}"), F.sum(t(i) * off * off).alias(f"q{i}"), ((at(i, F.floor(half(i))) + at(i, F.ceil(half(i)))) / 2).alias(f"med{i}"))]
    ties = (t(1) + t(0)).cast("double")
    mid_rank = F.col("b1") + F.col("b0") + (ties + 1) / 2
    one = ranked.groupBy(*keys).agg(F.max("mid").alias("mid"), *stats, F.sum(t(1) * mid_rank).alias("r1"), F.sum(ties * (ties * ties - 1)).alias("t"))
    for i in (1, 0):
        spread = F.try_divide(F.col(f"q{i}") - F.try_divide(F.col(f"o{i}") * F.col(f"o{i}"), F.col(f"n{i}")), F.col(f"n{i}") - F.lit(1.0))
        one = one.withColumns({f"m{i}": F.col("mid") + F.try_divide(F.col(f"o{i}"), F.col(f"n{i}")), f"s{i}": F.sqrt(F.greatest(spread, F.lit(0.0)))})
    c = F.col
    n = c("n1") + c("n0")
    pairs = c("n1").cast("double") * c("n0")
    u1 = c("r1") - c("n1") * (c("n1") + 1) / 2
    sigma = F.sqrt(pairs / 12 * ((n + 1) - F.try_divide(c("t"), n * (n - 1.0))))
    z = F.try_divide(F.greatest(u1, pairs - u1) - pairs / 2 - 0.5, sigma)
    pooled = F.sqrt((c("s1") * c("s1") + c("s0") * c("s0")) / 2)
    enough = (c("n1") >= least) & (c("n0") >= least)
    half = F.abs(z) / F.sqrt(F.lit(2.0))
    p = F.when(enough, F.when(z.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.when(z >= 0, erfc(half)).otherwise(2 - erfc(half)))))
    d = F.when(enough, F.when(pooled == 0, 0.0).otherwise(F.try_divide(c("m1") - c("m0"), pooled)))
    return one.select(*keys, c("n1").alias("n_high"), c("n0").alias("n_low"), c("m1").alias("high_mean"), c("m0").alias("low_mean"), c("med1").alias("high_median"), c("med0").alias("low_median"),
                      F.coalesce(F.try_divide(c("m1") - c("m0"), c("m0")) * 100, F.lit(0.0)).alias("diff_pct"), p.alias("p_value"), d.alias("cohens_d"))


def shape(column: str) -> list[Column]:
    """Skewness and excess kurtosis corrected for bias."""
    n = F.count(column).cast("double")
    skew = F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))
    return [skew.alias("skewness"), kurt.alias("kurtosis")]


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, dot) for a <= b, in one pass; rows with a null in any column are left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    d = lambda c: F.col(c).cast("double")
    sums = df.select(*columns).na.drop().agg(*[F.sum(d(a) * d(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    stacked = ", ".join(f"'{a}', '{b}', s{i}" for i, (a, b) in enumerate(pairs))
    return sums.selectExpr(f"stack({len(pairs)}, {stacked}) AS (a, b, dot)")


def correlations_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair a before b, in one pass; rows with a null in either column don't count for the pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    stacked = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {stacked}) AS (a, b, r)")


def select_by_vif(df: DataFrame, columns: list[str], most: float = 10.0, correlation: float = 0.95) -> list[str]:
    """Columns left after dropping constants, those correlated above `correlation` with any earlier one, and then the
    highest variance inflation factor while one exceeds `most`. One scan; the driver holds a square of the columns."""
    one = df.withColumn("__one", F.lit(1.0))
    g = np.zeros((len(columns) + 1,) * 2)
    names = ["__one", *columns]
    for a, b, dot in gram(one, names).collect():
        g[names.index(a), names.index(b)] = g[names.index(b), names.index(a)] = dot or 0.0
    n, sums = g[0, 0], g[0, 1:]
    if not n:
        return []
    cov = g[1:, 1:] - np.outer(sums, sums) / n
    spread = np.sqrt(np.clip(np.diag(cov), 0, None))
    varied = [i for i in range(len(columns)) if spread[i] > 1e-9 * max(1.0, np.sqrt(g[i + 1, i + 1]))]
    keep = [i for k, i in enumerate(varied) if all(abs(cov[i, j]) <= correlation * spread[i] * spread[j] for j in varied[:k])]
    dots = g[1:, 1:]
    while len(keep) > 1:
        m = dots[np.ix_(keep, keep)]
        scale = np.sqrt(np.diag(m))
        unit = m / np.outer(scale, scale)
        vif = np.full(len(keep), np.inf) if np.linalg.matrix_rank(unit) < len(keep) else np.diag(np.linalg.inv(unit))
        if vif.max() <= most:
            break
        keep.pop(int(vif.argmax()))
    return [columns[i] for i in keep]


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns at mean 0 and population deviation 1; constant ones become 0."""
    state = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.col(c) * 0.0) for c in columns}
    return df.crossJoin(F.broadcast(state)).withColumns(z).select(*df.columns)


def in_test(key: str, seed: str, percent: int = 20) -> Column:
    """A split by the key's digest: the same whatever the partitions."""
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("long") % 100 < percent


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """df with a 0/1 column for each value but the first in order; unknown values are all 0."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values)[1:]})


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e, y = F.col(actual) - F.col(predicted), F.col(actual)
    total = F.var_pop(y) * F.count(y)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"))


#: Estimators by name. The forest's size is the published model's; a smaller one is a parameter away.
MODELS = {
    "forest": lambda **kw: RandomForestRegressor(**({"numTrees": 357, "maxDepth": 21, "featureSubsetStrategy": "0.5", "minInstancesPerNode": 1, "seed": 42, "maxMemoryInMB": 1024} | kw)),
    "boosted": lambda **kw: GBTRegressor(**({"seed": 42} | kw)),
    "ridge": lambda **kw: LinearRegression(**({"regParam": 1.0, "elasticNetParam": 0.0} | kw)),
    "lasso": lambda **kw: LinearRegression(**({"regParam": 0.1, "elasticNetParam": 1.0} | kw)),
}


def pipeline(features: list[str], target: str, model: str = "forest", **params) -> Pipeline:
    """Assembled features and an estimator; save and load it as Spark ML does."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), MODELS[model](labelCol=target, featuresCol="features", predictionCol="predicted", **params)])


def train(df: DataFrame, key: str, features: list[str], target: str, model: str = "forest", seed: str = "42", test_ids: list | None = None, **params):
    """The test rows are those of test_ids (a bounded list), else a fifth by digest. Fit on the training part, measure on the rest, fit again on all: (model, metrics as a DataFrame, predictions)."""
    test = in_test(key, seed) if test_ids is None else F.col(key).isin(*test_ids)
    sizes = df.agg(F.count_if(test).alias("test"), F.count_if(~test).alias("train")).first()
    if not sizes["test"] or not sizes["train"]:
        raise ValueError(f"the split leaves {sizes['train']} rows to learn from and {sizes['test']} to measure on")
    stages = pipeline(features, target, model, **params)
    predictions = stages.fit(df.where(~test)).transform(df.where(test)).drop("features")
    return stages.fit(df), regression_metrics(predictions, target, "predicted"), predictions


def importances(fitted, features: list[str]) -> dict[str, float]:
    """Importance by feature, highest first; names come from the assembler's own inputs."""
    weights = fitted.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(features, map(float, weights), strict=True), key=lambda x: (-x[1], x[0])))
