"""A regression network of dense layers, trained on rows that stay where they are.

Each step, every partition works out the gradient of its rows; Spark sums the gradients weight by weight, and the driver moves the weights,
of which it and each task hold one copy. Steps go over all training rows, so the result does not depend on the partitions but for
rounding. Training stops when a held-out part has not improved for some steps, and the best weights stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import read_metadata, scratch, write_metadata
from .statistics import in_test


@dataclass
class Network:
    """Weights (inputs, outputs) and offsets of each layer; all layers but the last cut negative values off."""

    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def drawn(cls, sizes: list[int], seed: int) -> Network:
        r = np.random.default_rng(seed)
        return cls([(r.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Network(out)

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """What goes into each layer, and at last what comes out."""
        out = [x]
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k + 1 < len(self.layers):
                x = np.maximum(x, 0)
            out.append(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.outputs(x)[-1][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of squared errors, and its derivative by each weight."""
        inputs = self.outputs(x)
        error = inputs[-1][:, 0] - y
        back, out = 2 * error[:, None], []
        for k in reversed(range(len(self.layers))):
            out.append(np.concatenate([(inputs[k].T @ back).ravel(), back.sum(axis=0)]))
            if k:
                back = (back @ self.layers[k][0].T) * (inputs[k] > 0)
        return float(error @ error), np.concatenate(out[::-1])


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(frame["x"].to_numpy()), frame["y"].to_numpy()


def _step(rows: DataFrame, network: Network) -> tuple[dict[bool, tuple[float, float]], np.ndarray]:
    """({held: (rows, sum of squared errors)}, the training part's gradient)."""

    def worked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = network.flat().size
        out = np.zeros(size + 4)  # then rows and errors of both parts
        for frame in frames:
            for held in (False, True):
                part = frame[frame["held"] == held]
                if len(part):
                    x, y = _arrays(part)
                    if held:
                        error = network.predict(x) - y
                        out[size + 2 :] += len(y), error @ error
                    else:
                        squares, gradient = network.gradient(x, y)
                        out[:size] += gradient
                        out[size : size + 2] += len(y), squares
        yield pd.DataFrame({"k": np.arange(len(out)), "v": out})

    sums = {r["k"]: r["v"] for r in rows.mapInPandas(worked, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}  # one for each weight
    size = network.flat().size
    return {False: (sums.get(size, 0), sums.get(size + 1, 0)), True: (sums.get(size + 2, 0), sums.get(size + 3, 0))}, np.array([sums.get(k, 0.0) for k in range(size)])


class NetworkModel:
    def __init__(self, network: Network, features: str, steps: int, held_mse: float):
        self.network, self.features, self.steps, self.held_mse = network, features, steps, held_mse

    def transform(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        network = self.network

        @F.pandas_udf("double")
        def predicted(vectors: pd.Series) -> pd.Series:
            return pd.Series(network.predict(np.stack(vectors.to_numpy())) if len(vectors) else [], dtype=float)

        return df.withColumn(name, predicted(as_array(df, self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        layers = json.dumps([[w.tolist(), b.tolist()] for w, b in self.network.layers])
        write_metadata(spark, {"layers": layers, "features": self.features, "steps": self.steps, "held_mse": self.held_mse}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NetworkModel:
        m = read_metadata(spark, path)
        return cls(Network([(np.array(w), np.array(b)) for w, b in json.loads(m["layers"])]), m["features"], m["steps"], m["held_mse"])


def as_array(df: DataFrame, column: str):
    return vector_to_array(column) if dict(df.dtypes)[column] == "vector" else F.col(column).cast("array<double>")


def fit_network(df: DataFrame, key: str, features: str, target: str, hidden: tuple[int, ...] = (64, 32), steps: int = 200, rate: float = 0.01, decay: float = 1e-4, patience: int = 20, seed: int = 42) -> NetworkModel:
    """A network on a column of vectors, scaled before (see matrix.feature_matrix). A fifth of the rows by a digest of the key is held out.
    Weights move by bias-corrected first and second moments of the mean gradient, and shrink by `decay` apart from it."""
    some = df.where(F.col(features).isNotNull() & F.col(target).isNotNull())
    place = scratch(df.sparkSession, "network")
    some.select(as_array(df, features).alias("x"), F.col(target).cast("double").alias("y"), in_test(key, f"network{seed}").alias("held")).write.parquet(place)
    rows = df.sparkSession.read.parquet(place)
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    network = Network.drawn([first["n"], *hidden, 1], seed)
    flat = network.flat()
    offset = rows.where(~F.col("held")).agg(F.avg("y")).first()[0] or 0.0
    flat[-1] = offset  # errors begin at the mean
    network = network.with_flat(flat)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    best, since = (np.inf, network, 0), 0
    for t in range(1, steps + 2):
        parts, gradient = _step(rows, network)
        n, squares = parts[True] if parts[True][0] else parts[False]
        if squares / n < best[0] * (1 - 1e-6):
            best, since = (squares / n, network, t - 1), 0
        else:
            since += 1
        if since >= patience or t > steps or not parts[False][0]:
            break
        gradient = gradient / parts[False][0]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        flat = flat - rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * flat)
        network = network.with_flat(flat)
    return NetworkModel(best[1], features, best[2], float(best[0]))
