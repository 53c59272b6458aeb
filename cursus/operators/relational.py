"""Relational operators that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must end in a tie-break."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def top_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def exact_sample(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """Exactly min(n, size) rows of each group, the same in every run."""
    draw = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(draw, key))).where(F.col("__r") <= n).drop("__r")


def missing_profile(df: DataFrame) -> DataFrame:
    """A row for each column with its nulls, in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr("__n", f"stack({len(df.columns)}, {pairs}) AS (column_name, missing)").selectExpr("column_name", "missing", "round(missing * 100.0D / __n, 6) AS missing_pct").drop("__n")


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Bounds at 1.5 interquartile ranges and the rows outside them; the bounds are one row."""
    q = exact_quantiles(df, column, [0.25, 0.75])
    bounds = q.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "q3"))]).selectExpr("q1", "q3", "q1 - 1.5 * (q3 - q1) AS low", "q3 + 1.5 * (q3 - q1) AS high")
    return df.crossJoin(F.broadcast(bounds)).groupBy("q1", "q3", "low", "high").agg(F.count_if((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).alias("outliers"), F.count("*").alias("total"))


def drop_repeats(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("__b", before).where(~F.col(value).eqNullSafe(F.col("__b")) | F.col("__b").isNull()).drop("__b")


def bins_for(df: DataFrame, bins: int | None = None) -> int:
    """How many bins to order values in, unless it is said: a task's worth each, so as many as the session's shuffle
    partitions, between 64 and 1024."""
    return bins or min(1024, max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cuts_of(value: str | Column, bins: int) -> Column:
    """Approximate quantiles that part the values in bins."""
    return F.percentile_approx(value, [i / bins for i in range(1, bins)], max(1000, 4 * bins))


def bin_of(cuts: Column, value: Column, bins: int) -> Column:
    """How many of the cuts, in order, lie below the value: found by halves, so in about log2(bins) comparisons."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bins.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at))


def ordered(df: DataFrame, value: str, bins: int | None = None) -> DataFrame:
    """(value, ties, below, n): each distinct value that isn't null, its rows, the rows before it, all rows.

    Distinct values are ordered inside bins between approximate quantiles, so no task sees more than about one bin;
    only the bins' totals meet in one task. The bins split the work and don't change the result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    bins = bins_for(df, bins)
    cuts = counts.agg(cuts_of(value, bins).alias("__cuts"))
    binned = counts.crossJoin(F.broadcast(cuts)).withColumn("__bin", bin_of(F.col("__cuts"), F.col(value), bins)).drop("__cuts")
    sums = binned.groupBy("__bin").agg(F.sum("ties").alias("__s"))
    before = F.sum("__s").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    totals = sums.select("__bin", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy()).alias("n"))
    inside = F.coalesce(F.sum("ties").over(Window.partitionBy("__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return binned.withColumn("__inside", inside).join(F.broadcast(totals), "__bin").select(value, "ties", (F.col("__before") + F.col("__inside")).alias("below"), "n")


#: Rows of one value that are no burden to a task.
FEW = 4096


def mid_ranks(df: DataFrame, value: str, bins: int | None = None, few: int = FEW) -> DataFrame:
    """df with mid_rank, the average rank of ties, and ties; rows with a null value are left out.

    Values with more than `few` rows and a thousandth of all, fewer than a thousand values therefore, are told to all tasks, so that their rows meet
    their rank in parts of about `few` rows.
    """
    ranks = ordered(df, value, bins)
    parts = F.when((F.col("ties") > few) & (F.col("ties") * 1000 > F.col("n")), F.ceil(F.col("ties") / few)).otherwise(1)
    hot = F.broadcast(ranks.select(value, parts.alias("__parts")).where("__parts > 1"))
    spread = df.join(hot, value, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    each = ranks.select(value, (F.col("below") + (F.col("ties") + 1) / 2).alias("mid_rank"), "ties", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__part"))
    return spread.join(each, [value, "__part"]).drop("__part")


def exact_quantiles(df: DataFrame, value: str, shares: list[float], bins: int | None = None) -> DataFrame:
    """One row with q, the linearly interpolated quantiles; no task holds all distinct values. Nulls don't count; q
    holds nulls where there are no values."""
    ranked = ordered(df, value, bins)
    v = F.col(value).cast("double")
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("ties")), v))
    place = {s: F.lit(s) * (F.col("n") - 1) for s in shares}
    ends = [x for i, s in enumerate(shares) for x in (at(F.floor(place[s])).alias(f"lo{i}"), at(F.ceil(place[s])).alias(f"hi{i}"), F.max(place[s] - F.floor(place[s])).alias(f"f{i}"))]
    parts = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(len(shares))]
    return ranked.agg(*ends).select(F.array(*parts).alias("q"))


def group_quantiles(df: DataFrame, group: str, value: str, shares: list[float], bins: int = 64) -> DataFrame:
    """(group, q, n) for each group: its interpolated quantiles. As in `ordered`, values are ordered inside bins, so no
    task holds all values of a group; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("ties"))
    cuts = counts.groupBy(group).agg(cuts_of(value, bins).alias("__cuts"))
    binned = counts.join(cuts, group).withColumn("__bin", bin_of(F.col("__cuts"), F.col(value), bins)).drop("__cuts")
    sums = binned.groupBy(group, "__bin").agg(F.sum("ties").alias("__s"))
    whole = Window.partitionBy(group)
    before = F.sum("__s").over(whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    totals = sums.select(group, "__bin", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__s").over(whole).alias("n"))
    inside = F.coalesce(F.sum("ties").over(Window.partitionBy(group, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = binned.withColumn("__inside", inside).join(totals, [group, "__bin"]).withColumn("below", F.col("__before") + F.col("__inside"))
    v = F.col(value).cast("double")
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("ties")), v))
    place = {s: F.lit(s) * (F.col("n") - 1) for s in shares}
    ends = [x for i, s in enumerate(shares) for x in (at(F.floor(place[s])).alias(f"lo{i}"), at(F.ceil(place[s])).alias(f"hi{i}"), F.max(place[s] - F.floor(place[s])).alias(f"f{i}"))]
    parts = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(len(shares))]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), *ends).select(group, F.array(*parts).alias("q"), "n")


def every_month(df: DataFrame, at: str) -> DataFrame:
    """(month, n) from the first month to the last, those without rows too."""
    counts = df.where(F.col(at).isNotNull()).groupBy(F.date_trunc("month", at).alias("month")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL")
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def limited(df: DataFrame, n: int | None, *order) -> DataFrame:
    """The first n rows in the order; all where n is 0 or None."""
    return df.orderBy(*order).limit(n) if n else df


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly min(n, rows) rows, the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    """Whether every row of a is in b."""
    return a.join(b.distinct(), a.columns, "left_anti").isEmpty()
