"""Boosted trees grown leaf by leaf on histograms, and target statistics for categories that do not leak.

Rows stay where they are: each partition counts gradients by leaf, feature and bin, the counts are summed by Spark, and the driver sees one
number for each bin only. Of a split's two children the smaller one is counted and the other is the difference.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import read_metadata, scratch, write_metadata
from .relational import bin_of


def target_statistics(df: DataFrame, column: str, target: str, weight: float = 1.0) -> DataFrame:
    """(value, statistic): the mean target of each category, drawn towards the mean of all by `weight` rows of it; for new rows."""
    mean = df.agg(F.avg(target).alias("__mean"))  # one row
    sums = df.groupBy(F.col(column).alias("value")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    return sums.crossJoin(F.broadcast(mean)).select("value", ((F.coalesce("s", F.lit(0.0)) + weight * F.col("__mean")) / (F.col("n") + weight)).alias("statistic"))


def ordered_target_statistics(df: DataFrame, key: str, column: str, target: str, name: str, weight: float = 1.0, parts: int = 64, seed: str = "order") -> DataFrame:
    """df with the category's statistic from the rows before each row, in an order drawn by a digest of the key, so that no
    row's own target is in its feature. The order is cut in parts; a common category is summed part by part."""
    place = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))
    part = (F.conv(F.substring(place, 1, 4), 16, 10).cast("int") * parts / 65536).cast("int")
    rows = df.withColumns({"__place": place, "__part": part})
    mean = df.agg(F.avg(target).alias("__mean"))
    sums = rows.groupBy(column, "__part").agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy(column).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(column).alias("__value"), F.col("__part").alias("__of"), before("s").alias("__s"), before("n").alias("__n"))  # `parts` rows a category at most
    inside = Window.partitionBy(column, "__part").orderBy("__place", key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__is": F.coalesce(F.sum(target).over(inside), F.lit(0)), "__in": F.count(target).over(inside)})
    found = rows.join(sums, F.col(column).eqNullSafe(F.col("__value")) & (F.col("__part") == F.col("__of"))).crossJoin(F.broadcast(mean))
    statistic = (F.col("__s") + F.col("__is") + weight * F.col("__mean")) / (F.col("__n") + F.col("__in") + weight)
    return found.withColumn(name, statistic).select(*df.columns, name)


@dataclass
class Tree:
    """Nodes by number: (feature, bin, left, right) where it splits at values up to the bin's cut, else the leaf's value."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for node, (f, b, left, right) in self.splits.items():  # parents come first
            here = at == node
            at[here] = np.where(bins[here, f] <= b, left, right)
        return at

    def value(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.values) + 1)
        for node, v in self.values.items():
            table[node] = v
        return table[self.leaves(bins)]


class Leafwise:
    """A fitted model: cuts of each feature, what all rows begin with, and the trees."""

    def __init__(self, features: list[str], cuts: list[list[float]], first: float, trees: list[Tree]):
        self.features, self.cuts, self.first, self.trees = features, cuts, first, trees

    def binned(self) -> Column:
        """The bin of each feature's value: how many cuts lie below it; null is in the first."""
        return F.array(*[F.coalesce(bin_of(F.array(*map(F.lit, c)), F.col(f).cast("double"), len(c) + 1), F.lit(0)) if c else F.lit(0) for f, c in zip(self.features, self.cuts, strict=True)])

    def transform(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        first, trees = self.first, df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def predicted(bins: pd.Series) -> pd.Series:
            x = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, 0), int)
            return pd.Series(first + sum((t.value(x) for t in trees.value), np.zeros(len(x))))

        return df.withColumn(name, predicted(self.binned()))

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [[[[k, *map(int, v)] for k, v in t.splits.items()], [[k, v] for k, v in t.values.items()]] for t in self.trees]
        write_metadata(spark, {"features": self.features, "cuts": self.cuts, "first": self.first, "trees": json.dumps(trees)}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Leafwise:
        m = read_metadata(spark, path)
        trees = [Tree({k: tuple(v) for k, *v in splits}, dict(map(tuple, values))) for splits, values in json.loads(m["trees"])]
        return cls(m["features"], m["cuts"], m["first"], trees)


def _histograms(rows: DataFrame, tree: Tree, nodes: list[int], n_features: int, n_bins: int) -> np.ndarray:
    """(node, feature, bin, 2): sums of gradients and rows."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(nodes), n_features, n_bins, 2))
        for frame in frames:
            if len(frame):
                x, g = np.stack(frame["bins"].to_numpy()), frame["gradient"].to_numpy()
                at = tree.leaves(x)
                for k, node in enumerate(nodes):
                    here = at == node
                    for f in range(n_features):
                        out[k, f, :, 0] += np.bincount(x[here, f], weights=g[here], minlength=n_bins)
                        out[k, f, :, 1] += np.bincount(x[here, f], minlength=n_bins)
        k, f, b = np.nonzero(out[..., 1])
        yield pd.DataFrame({"k": k, "f": f, "b": b, "g": out[k, f, b, 0], "n": out[k, f, b, 1]})

    found = rows.mapInPandas(counted, "k int, f int, b int, g double, n double").groupBy("k", "f", "b").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    out = np.zeros((len(nodes), n_features, n_bins, 2))
    for r in found.collect():  # a row for each bin
        out[r["k"], r["f"], r["b"]] = r["g"], r["n"]
    return out


def best_split(histogram: np.ndarray, least: int, smooth: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a leaf from its histogram (feature, bin, 2); of equals the first. No gain: feature -1."""
    left = histogram.cumsum(axis=1)[:, :-1]
    whole = histogram[0].sum(axis=0)
    right = whole - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + smooth)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), 0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (-1, -1)
    return (float(gain[f, b]), int(f), int(b)) if gain.size and gain[f, b] > 1e-9 else (0.0, -1, -1)


def fit_leafwise(df: DataFrame, features: list[str], target: str, trees: int = 50, leaves: int = 31, rate: float = 0.1, bins: int = 64, least: int = 20, smooth: float = 1.0) -> Leafwise:
    """Boosted regression trees of up to `leaves` leaves, always splitting the leaf that gains most. Rows without a target don't count."""
    spark, some = df.sparkSession, df.where(F.col(target).isNotNull())
    cuts_of = [F.percentile_approx(F.col(f).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(f"c{i}") for i, f in enumerate(features)]
    one = some.agg(F.avg(target).alias("mean"), *cuts_of).first()
    if one["mean"] is None:
        raise ValueError("no rows to learn from")
    model = Leafwise(features, [sorted(set(one[f"c{i}"] or [])) for i in range(len(features))], float(one["mean"]), [])

    def kept(rows: DataFrame, name: str) -> DataFrame:
        place = scratch(spark, name)
        rows.write.parquet(place)
        return spark.read.parquet(place)

    rows = kept(some.select(model.binned().alias("bins"), (F.col(target).cast("double") - model.first).alias("gradient")), "boosted")
    for _ in range(trees):
        tree = Tree()
        histograms = {0: _histograms(rows, tree, [0], len(features), bins)[0]}
        splits = {0: best_split(histograms[0], least, smooth)}
        while len(histograms) < leaves:
            node = max(splits, key=lambda k: (splits[k][0], -k))
            gain, f, b = splits.pop(node)
            if f < 0:
                break
            left, right = 2 * len(tree.splits) + 1, 2 * len(tree.splits) + 2
            tree.splits[node] = (f, b, left, right)
            whole = histograms.pop(node)
            n_left = whole[f, : b + 1, 1].sum()
            small, other = (left, right) if 2 * n_left <= whole[f, :, 1].sum() else (right, left)
            histograms[small] = _histograms(rows, tree, [small], len(features), bins)[0]
            histograms[other] = whole - histograms[small]
            for k in (left, right):
                splits[k] = best_split(histograms[k], least, smooth)
        sums = {k: h[0].sum(axis=0) for k, h in histograms.items()}
        tree.values = {k: rate * float(g / (n + smooth)) for k, (g, n) in sums.items()}
        model.trees.append(tree)
        shared = tree

        def stepped(frames: Iterator[pd.DataFrame], tree: Tree = shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(gradient=frame["gradient"] - tree.value(np.stack(frame["bins"].to_numpy())))

        rows = kept(rows.mapInPandas(stepped, rows.schema), "boosted")
    return model
