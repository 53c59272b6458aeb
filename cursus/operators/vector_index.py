"""A vector index that prunes: inverted lists around trained centres, of which a search reads only those near its questions.

The centres come from k-means on a bounded sample; every row is in the list of its nearest centre. Lists are written as
blocks of unit vectors, a folder for each list, so that lists which no question needs are not read. Searching the `probes`
nearest lists is approximate; `exact` then adds the lists that could still hold a nearer row, by the angle between question
and centre and the widest angle in the list, so the result is that of a search of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from . import retrieval as V

#: Lists at most; rows that train each centre; rows and questions of a block.
MOST_LISTS, SAMPLE_A_LIST, BLOCK_ROWS, BLOCK_QUESTIONS = 16_384, 64, 4096, 1024
#: Shelves of an index at least, and rows of a shelf where there are more; angles and bytes that are held at once.
SHELVES, SHELF_ROWS, CELLS, FRAME_BYTES = 64, 16_384, 1_000_000, 16_000_000


def _units(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _slices(rows: int, lists: int) -> Iterator[slice]:
    """Rows in slices whose angles to all centres are CELLS at most."""
    size = max(1, CELLS // max(1, lists))
    return (slice(at, at + size) for at in range(0, rows, size))


def _nearest(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, which centre is nearest, and its cosine."""
    at, dots = np.zeros(len(units), np.int64), np.zeros(len(units))
    for part in _slices(len(units), len(centres)):
        near = units[part] @ centres.T
        at[part], dots[part] = near.argmax(axis=1), near.max(axis=1)
    return at, dots


def train(base: DataFrame, key: str, lists: int, seed: int = 42) -> np.ndarray:
    """Unit vectors of the centres, from at most SAMPLE_A_LIST rows a list, drawn by a hash of the key."""
    n = base.count()
    drawn = F.pmod(F.xxhash64(key), F.lit(max(1, n // (lists * SAMPLE_A_LIST)))) == 0
    sample = base.where(drawn & F.col("embedding").isNotNull()).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    fitted = KMeans(k=lists, featuresCol="v", distanceMeasure="cosine", seed=seed, maxIter=10).fit(sample)
    return _units(fitted.clusterCenters())


def build(base: DataFrame, key: str, path: str, lists: int | None = None) -> None:
    """Writes the index of base (key, embedding) to path: centres, with how wide their lists are, and the lists' blocks.
    Rows without a vector are in none. The number of lists follows the square root of the rows."""
    spark, kind = base.sparkSession, dict(base.dtypes)[key]
    base = base.where("embedding IS NOT NULL").select(F.col(key).alias("id"), "embedding")
    lists = lists or min(MOST_LISTS, max(1, math.isqrt(base.count())))
    centres = train(base, "id", lists)
    shared = spark.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                units = _units(part["embedding"])
                at, dots = _nearest(units, shared.value)
                yield pd.DataFrame({"list": at, "id": part["id"], "unit": [u.tobytes() for u in units], "angle": np.arccos(np.clip(dots, -1, 1))})

    place = scratch(spark, "placed")
    base.mapInPandas(placed, f"list int, id {kind}, unit binary, angle double").write.parquet(place)
    rows = spark.read.parquet(place)
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    table.join(F.broadcast(sizes), "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    # A long list is cut in parts of about a block each.
    parts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts")))
    dealt = rows.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("list", "part", "id", "unit").repartition("list", "part").sortWithinPartitions("list", "part")

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {"of": None, "ids": [], "units": []}

        def out() -> Iterator[pd.DataFrame]:
            if held["ids"]:
                yield pd.DataFrame({"list": [held["of"][0]], "ids": [held["ids"]], "units": [b"".join(held["units"])]})
            held["ids"], held["units"] = [], []

        for frame in frames:
            for of, i, u in zip(zip(frame["list"], frame["part"], strict=True), frame["id"].tolist(), frame["unit"], strict=True):
                if of != held["of"] or len(held["ids"]) == BLOCK_ROWS:
                    yield from out()
                    held["of"] = of
                held["ids"].append(i)
                held["units"].append(u)
        yield from out()

    dealt.mapInPandas(blocks, f"list int, ids array<{kind}>, units binary").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")


def lists_of(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """(list, ids, units) of an index; only the folders of the lists named are read."""
    lists = spark.read.parquet(f"{path}/lists")
    return lists if only is None else lists.where(F.col("list").isin(*only) if only else F.lit(False))


def _search(spark: SparkSession, path: str, asked: DataFrame, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], names: np.ndarray, shelf_lists: int) -> DataFrame:
    """asked (question_id, asked, k, near, least): each question's nearest rows in the lists that it wants.

    wanted(units, least) says of each question and each list, in the order of names, whether it wants it. Lists stand on shelves
    of `shelf_lists` each. A question's vector goes once to each shelf that holds a list it wants, and meets there what its block
    wants of that shelf, which may be more than it wants itself.
    """
    kind = dict(asked.dtypes)["question_id"]
    # Questions near the same centre want the same lists, so they share a block.
    dealt = asked.repartitionByRange(max(1, math.ceil(asked.count() / BLOCK_QUESTIONS)), "near", "question_id").sortWithinPartitions("near")
    packed = V.unit_blocks(dealt, "question_id", "asked", BLOCK_QUESTIONS, "asked", "k", "least")
    shelves = names // shelf_lists
    columns = ["shelf", "lists", "q_ids", "q_units", "q_ks", "q_bounds"]

    def wants(units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.concatenate([wanted(units[part], bounds[part]) for part in _slices(len(units), len(names))])

    def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for units, bounds in zip(frame["units"], frame["bounds"], strict=True):
                yield pd.DataFrame({"list": names[wants(np.frombuffer(units).reshape(len(bounds), -1), bounds).any(axis=0)]})

    def shelved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for frame in frames:
            for ids, units, ks, bounds in zip(frame["ids"], frame["units"], frame["ks"], frame["bounds"], strict=True):
                rows = np.frombuffer(units).reshape(len(ids), -1)
                open_ = wants(rows, bounds)
                for shelf in np.unique(shelves[open_.any(axis=0)]):
                    here = open_[:, shelves == shelf]
                    at = np.flatnonzero(here.any(axis=1))
                    out.append((shelf, names[shelves == shelf][here.any(axis=0)], ids[at], rows[at].tobytes(), ks[at], bounds[at]))
                    held += rows[at].nbytes
                    if held > FRAME_BYTES:  # a frame is bounded, however many lists are wanted
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    asking = packed.select("ids", "units", "ks", "bounds").mapInPandas(shelved, f"shelf int, lists array<int>, q_ids array<{kind}>, q_units binary, q_ks array<int>, q_bounds array<double>")
    held = lists_of(spark, path, sorted(r["list"] for r in packed.select("units", "bounds").mapInPandas(probed, "list int").distinct().collect()))  # MOST_LISTS at most
    # A question's vector goes to many shelves, which packs well on disk, so the planner would take the whole for small and
    # send it through the driver. Blocks of questions pass by the lists of their shelf, which are held.
    meet = (F.col("shelf") == F.floor(F.col("list") / shelf_lists).cast("int")) & F.array_contains("lists", F.col("list"))
    return V.best_of_pairs(asking.join(held.hint("merge"), meet), kind, dict(held.dtypes)["ids"][6:-1])


def search(spark: SparkSession, path: str, questions: DataFrame, k: int | str, probes: int = 8, exact: bool = False) -> DataFrame:
    """(question_id, k, score, rank): the k nearest rows to each question (question_id, asked), from its `probes` nearest
    lists, or, if exact, from all rows. k may be a column of questions."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS rows at most
    names = np.array([r["list"] for r in centres])
    shared = spark.sparkContext.broadcast((np.array([r["centre"] for r in centres]), np.array([r["widest"] for r in centres])))
    kind = dict(questions.dtypes)["question_id"]
    asked = questions.select("question_id", F.col("asked").cast("array<double>").alias("asked"), (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k")).where("asked IS NOT NULL")

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(near=_nearest(_units(frame["asked"]), shared.value[0])[0])

    place = scratch(spark, "questions")
    asked.mapInPandas(placed, f"question_id {kind}, asked array<double>, k int, near int").write.parquet(place)
    asked = spark.read.parquet(place)

    def nearest(units: np.ndarray, _: np.ndarray) -> np.ndarray:
        near = np.argsort(-(units @ shared.value[0].T), axis=1, kind="stable")[:, :probes]
        open_ = np.zeros((len(units), len(names)), bool)
        np.put_along_axis(open_, near, True, axis=1)
        return open_

    first = _search(spark, path, asked.withColumn("least", F.lit(-2.0)), nearest, names, 1)
    if not exact:
        return first
    # A question with fewer rows than it asks for has no bound yet.
    found = first.groupBy("question_id").agg(F.count("*").alias("n"), F.min("score").alias("bound"))
    bounded = asked.join(found.hint("merge"), "question_id", "left").select(*asked.columns, F.when(F.col("n") >= F.col("k"), F.col("bound")).otherwise(-2.0).alias("least"))
    place = scratch(spark, "bounded")
    bounded.write.parquet(place)

    def left(units: np.ndarray, least: np.ndarray) -> np.ndarray:
        middle, widest = shared.value
        best = np.cos(np.maximum(0, np.arccos(np.clip(units @ middle.T, -1, 1)) - widest))
        return best >= least[:, None] - V.SLACK

    # Whatever is among the best has the bound's score at least, so this finds the first search's rows again.
    rows = sum(r["n"] for r in centres)
    shelf_lists = max(1, math.ceil(len(names) / max(SHELVES, rows // SHELF_ROWS)))
    return _search(spark, path, spark.read.parquet(place), left, names, shelf_lists)
