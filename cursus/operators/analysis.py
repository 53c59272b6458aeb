"""The whole study of what works, for every subject and for all videos ('global'), each part in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .practices import duration_bin
from .statistics import compared, two_group_ranks

#: A subject is studied with so many videos, so many of them strong; its best channels that are named.
LEAST_VIDEOS, LEAST_HIGH, CHANNELS = 30, 10, 5
GLOBAL = "global"


def studied(df: DataFrame, subject: str, level: str, least: int = LEAST_VIDEOS, high: int = LEAST_HIGH) -> DataFrame:
    """df twice, with `scope`: each row under its subject, if that has enough videos, and under 'global'."""
    enough = df.groupBy(subject).agg(F.count("*").alias("__n"), F.count_if(F.col(level) == "High").alias("__h")).where((F.col("__n") >= least) & (F.col("__h") >= high))
    marked = df.join(F.broadcast(enough.select(subject, F.lit(True).alias("__enough"))), subject, "left")  # a row for each subject
    scopes = F.when(F.col("__enough"), F.array(F.col(subject), F.lit(GLOBAL))).otherwise(F.array(F.lit(GLOBAL)))
    return marked.withColumn("scope", F.explode(scopes)).drop("__enough")


def comparisons(scoped: DataFrame, features: dict[str, Column], level: str, least: int = 5) -> DataFrame:
    """(scope, feature, ...): high against low videos in each feature, with means, medians, p and Cohen's d, for all scopes and
    features in one reading. A feature that a scope has no values of has no row."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("v")) for n, v in features.items()]))
    two = scoped.where(F.col(level).isin("High", "Low")).select("scope", F.col(level).alias("g"), named.alias("x")).select("scope", "g", "x.*").where("v IS NOT NULL")
    keys = ("scope", "feature")
    found = compared(two_group_ranks(two, "High", "Low", keys=keys, many=True), least, keys=keys)
    return found.withColumns({"significant": F.col("p_value") < 0.05, "effect": C.effect_label(F.col("cohens_d"))})


def forms(scoped: DataFrame, tests: dict[str, Column], level: str) -> DataFrame:
    """(scope, form, high_pct, low_pct, lift_pct) of boolean columns, for all scopes in one pass; see practices.usage."""
    share = lambda t, g: F.coalesce(F.avg(F.when(F.col(level) == g, F.coalesce(t, F.lit(False)).cast("double"))), F.lit(0.0))
    one = scoped.groupBy("scope").agg(*[F.struct(F.lit(n).alias("form"), share(t, "High").alias("h"), share(t, "Low").alias("l")).alias(f"s{i}") for i, (n, t) in enumerate(tests.items())])
    rows = one.select("scope", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(tests))])))
    lift = F.when(F.col("l") > 0, (F.col("h") - F.col("l")) / F.col("l") * 100).when(F.col("h") > 0, 100.0).otherwise(0.0)
    return rows.select("scope", "form", (F.col("h") * 100).alias("high_pct"), (F.col("l") * 100).alias("low_pct"), lift.alias("lift_pct"))


def timing(scoped: DataFrame, at: str, minutes: Column, score: str, views: str) -> DataFrame:
    """(scope, part, value, n, mean_score, mean_views, place): day of the week, hour and duration bin, the best score first."""
    parts = F.array(
        F.struct(F.lit("day").alias("part"), F.date_format(at, "EEEE").alias("value")), F.struct(F.lit("hour").alias("part"), F.hour(at).cast("string").alias("value")),
        F.struct(F.lit("minutes").alias("part"), duration_bin(minutes).alias("value")))
    rows = scoped.select("scope", score, views, F.explode(parts).alias("p")).where("p.value IS NOT NULL")
    found = rows.groupBy("scope", F.col("p.part").alias("part"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(views).alias("mean_views"))
    # A part has few values: days, hours, bins.
    return found.withColumn("place", F.row_number().over(Window.partitionBy("scope", "part").orderBy(F.round("mean_score", 6).desc(), "value")))


def overview(scoped: DataFrame, level: str, score: str) -> DataFrame:
    return scoped.groupBy("scope").agg(F.count("*").alias("videos"), F.count_if(F.col(level) == "High").alias("high"), F.avg(score).alias("mean_score"))


def channels(scoped: DataFrame, channel: str, score: str, k: int = CHANNELS) -> DataFrame:
    """(scope, channel, mean_score, n, place): the k best channels by mean score, equal ones by name."""
    means = scoped.where(F.col(channel).isNotNull()).groupBy("scope", channel).agg(F.round(F.avg(score), 6).alias("mean_score"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("mean_score"), channel))
    return means.withColumn("place", place).where(F.col("place") <= k)
