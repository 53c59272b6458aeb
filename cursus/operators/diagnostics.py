"""How a target is distributed: power transforms by likelihood, a normality statistic, and points of a Q-Q plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import exact_quantiles, ordered
from .statistics import shape

#: Coefficients of Acklam's rational approximation of the normal quantile; its relative error is below 1.2e-9.
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_LOW = 0.02425
#: Powers that are tried.
LAMBDAS = tuple(k / 10 for k in range(-20, 21))


def _poly(coefficients: tuple, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """The normal quantile of a share between 0 and 1."""
    tail = lambda share: _poly(_TAIL, F.sqrt(-2 * F.log(share))) / _poly(_TAIL_BELOW, F.sqrt(-2 * F.log(share)))
    q = p - 0.5
    middle = _poly(_MIDDLE, q * q) * q / _poly(_MIDDLE_BELOW, q * q)
    return F.when(p < _LOW, tail(p)).when(p > 1 - _LOW, -tail(1 - p)).otherwise(middle)


def power(x: Column, lam: float) -> Column:
    """The Box-Cox transform."""
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def power_likelihoods(df: DataFrame, column: str, shift: float = 0.0, lambdas: tuple = LAMBDAS) -> DataFrame:
    """(power, n, likelihood): the profile log-likelihood of each power, all in one pass. Values that aren't above 0 after the
    shift have no transform and don't count, nor do nulls."""
    x = F.col(column).cast("double") + shift
    some = df.select(x.alias("x")).where("x > 0")
    spread = [(F.var_pop(F.log("x")) if lam == 0 else F.var_pop(F.pow("x", F.lit(lam))) / (lam * lam)).alias(f"v{i}") for i, lam in enumerate(lambdas)]
    one = some.agg(F.count("x").alias("n"), F.sum(F.log("x")).alias("logs"), *spread)
    rows = F.inline(F.array(*[F.struct(F.lit(lam).alias("power"), F.col(f"v{i}").alias("v")) for i, lam in enumerate(lambdas)]))
    return one.select("n", "logs", rows).select("power", "n", ((F.col("power") - 1) * F.col("logs") - F.col("n") / 2 * F.log("v")).alias("likelihood"))


def best_power(df: DataFrame, column: str, shift: float = 0.0) -> dict:
    """The likeliest power, to two digits by a second pass around the first one's, and the skewness before and after."""
    best = lambda tried: power_likelihoods(df, column, shift, tried).orderBy(F.desc("likelihood"), F.abs("power")).first()["power"]
    near = best(LAMBDAS)
    lam = best(tuple(round(near + k / 100, 2) for k in range(-10, 11)))
    x = df.select((F.col(column).cast("double") + shift).alias("x")).where("x > 0").withColumn("y", power(F.col("x"), lam))
    before, after = (x.agg(*shape(c)).first()["skewness"] for c in "xy")
    return {"power": lam, "skewness": before, "skewness_after": after}


def normality(df: DataFrame, column: str) -> DataFrame:
    """(n, statistic): the squared correlation of the ordered values with normal quantiles (Shapiro and Francia), near 1 if
    normal, on all rows; equal values share their mid-rank's quantile. Values are ordered in bins. Null without spread."""
    ranked = ordered(df.select(F.col(column).cast("double").alias("v")), "v")
    m = probit((F.col("below") + (F.col("ties") + 1) / 2 - 0.375) / (F.col("n") + 0.25))
    sums = ranked.withColumn("m", m).agg(
        F.max("n").alias("n"), F.sum(F.col("ties") * F.col("m") * F.col("v")).alias("mv"), F.sum(F.col("ties") * F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("ties") * F.col("m")).alias("m"), F.sum(F.col("ties") * F.col("v")).alias("v"), F.sum(F.col("ties") * F.col("v") * F.col("v")).alias("vv"))
    c = F.col
    both, of_m, of_v = c("mv") - c("m") * c("v") / c("n"), c("mm") - c("m") * c("m") / c("n"), c("vv") - c("v") * c("v") / c("n")
    return sums.select("n", F.try_divide(both * both, of_m * of_v).alias("statistic"))


def qq_points(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(share, normal, value): the values' quantiles beside the normal ones, evenly spaced."""
    shares = [k / (points + 1) for k in range(1, points + 1)]
    q = exact_quantiles(df.select(F.col(column).cast("double").alias("v")), "v", shares)
    rows = q.select(F.posexplode("q").alias("k", "value")).withColumn("share", (F.col("k") + 1) / F.lit(float(points + 1)))
    return rows.select("share", probit(F.col("share")).alias("normal"), "value")
