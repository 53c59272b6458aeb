"""The knowledge base: texts as vectors in one table, and ranked retrieval from it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from .preparation import knowledge_chunks

CHUNK = "chunk_id string, category string, subject string, content string"
#: Scores have six digits; two products of the same vectors may round apart.
SLACK = 2e-6


def knowledge_base(spark: SparkSession, folder: str, suffix: str = "_best_practices.json", skip: tuple = ("combined_best_practices.json",)) -> DataFrame:
    """The chunks of each subject's JSON file in a folder that Spark reads: (chunk_id, category, subject, content)."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    named = files.select(name.alias("name"), "value").where(~F.col("name").isin(*skip))
    return knowledge_chunks(named.select(F.substring_index("name", suffix, 1).alias("subject"), "value"))


def hashing_embedder(size: int = 384):
    """Words hashed into a unit vector: a stand-in with the shape of a sentence model, which can be passed instead."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts.fillna(""):
                v = np.zeros(size, np.float32)
                for w in text.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1 if h >> 31 else -1
                out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
            yield pd.Series(out)

    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<float>")


def embedded(df: DataFrame, text: str, embed=None) -> DataFrame:
    """df with `embedding`; each distinct text is embedded once."""
    embed = embed or hashing_embedder()
    vectors = df.select(text).distinct().withColumn("embedding", embed(F.col(text)))
    return df.join(vectors, df[text].eqNullSafe(vectors[text])).drop(vectors[text])


def cosine(a: str, b: str) -> Column:
    d = lambda c: F.col(c).cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def retrieve(base: DataFrame, asked: list[float], k: int, key: str = "chunk_id", category: Column | None = None) -> DataFrame:
    """The k nearest rows to one vector; the category filters first, so k rows come back whenever there are k."""
    hits = base if category is None else base.where(category)
    return hits.withColumn("__q", F.array(*[F.lit(float(x)) for x in asked])).withColumn("score", F.round(cosine("embedding", "__q"), 6)).drop("__q").orderBy(F.desc("score"), key).limit(k)


def prioritised(hits: DataFrame, key: str, subject: str, wanted: str, k: int, least: int = 3) -> DataFrame:
    """Retrieved rows (key, subject, score), once each: the subject's own; the general ones ('global') join when it has
    fewer than `least`; others only when there are neither. The best k by score."""
    once = hits.groupBy(key).agg(F.max_by(subject, "score").alias(subject), F.max("score").alias("score"))
    tier = F.when(F.col(subject) == wanted, 0).when(F.col(subject) == "global", 1).otherwise(2)
    counts = once.agg(F.count_if(F.col(subject) == wanted).alias("__own"), F.count_if(F.col(subject) == "global").alias("__general"))
    allowed = (F.col("tier") == 0) | ((F.col("tier") == 1) & (F.col("__own") < least)) | ((F.col("tier") == 2) & (F.col("__own") + F.col("__general") == 0))
    return once.withColumn("tier", tier).crossJoin(F.broadcast(counts)).where(allowed).select(key, subject, "score", "tier").orderBy(F.desc("score"), key).limit(k)


def unit_blocks(df: DataFrame, key: str, vector: str, size: int, name: str, k: int | str = 0, bound: str | None = None) -> DataFrame:
    """(ids, units, ks, bounds): up to `size` rows of a partition with their unit vectors side by side, k, a number or a column of
    numbers, and the column of least scores, if any, written to the shared folder so that each block is made once. Rows
    without a vector are in none."""
    kind = dict(df.dtypes)[key]

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, ks, bounds = [], [], [], []

        def block() -> pd.DataFrame:
            rows = np.array(vectors, np.float64)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
            return pd.DataFrame({"ids": [list(ids)], "units": [rows.tobytes()], "ks": [list(ks)], "bounds": [list(bounds)]})

        for part in parts:
            for i, v, n, b in zip(part["id"].tolist(), part["vector"], part["k"].tolist(), part["bound"].tolist(), strict=True):
                ids.append(i)
                vectors.append(v)
                ks.append(n)
                bounds.append(b)
                if len(ids) == size:
                    yield block()
                    ids, vectors, ks, bounds = [], [], [], []
        if ids:
            yield block()

    place = scratch(df.sparkSession, name)
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int").alias("k"), (F.col(bound) if bound else F.lit(-2.0)).alias("bound")).where("vector IS NOT NULL")
    rows.mapInPandas(packed, f"ids array<{kind}>, units binary, ks array<int>, bounds array<double>").write.parquet(place)
    return df.sparkSession.read.parquet(place)


def best_per_question(questions: DataFrame, base: DataFrame, key: str, k: int | str, asked_rows: int = 1024, held_rows: int = 4096) -> DataFrame:
    """The k nearest rows of base (key, embedding) for each question (question_id, asked); k may be a column of questions.

    Blocks of questions are held against blocks of base, each pair of blocks one matrix product that keeps the k best of
    each question, so only these are shuffled and neither side comes to the driver. Work is the product of both sides;
    memory is that of a few pairs of blocks. Of equal scores (to six digits) the smaller key goes first; a row or a
    question without a vector has no part in it.
    """
    asked = unit_blocks(questions, "question_id", "asked", asked_rows, "asked", k).select(F.col("ids").alias("q_ids"), F.col("units").alias("q_units"), F.col("ks").alias("q_ks"), F.col("bounds").alias("q_bounds"))
    pairs = unit_blocks(base, key, "embedding", held_rows, "held").drop("ks", "bounds").crossJoin(asked)  # of blocks, never of rows

    kinds = dict(base.dtypes) | dict(questions.dtypes)
    return best_of_pairs(pairs, kinds["question_id"], kinds[key]).withColumnRenamed("k", key)


def best_of_pairs(pairs: DataFrame, question_kind: str, key_kind: str) -> DataFrame:
    """(question_id, k, score, rank): each question's nearest rows, from pairs of blocks (ids, units, q_ids, q_units, q_ks,
    q_bounds). Rows that score less than a question's bound may be left out."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, units, q_ids, q_units, q_ks, q_bounds in part.itertuples(index=False, name=None):
                held, ask = (np.frombuffer(u).reshape(len(i), -1) for i, u in ((ids, units), (q_ids, q_units)))
                scores, keys, ks = ask @ held.T, np.asarray(ids), np.asarray(q_ks)
                open_ = scores >= np.asarray(q_bounds)[:, None] - SLACK
                many = open_.sum(axis=1) > ks
                for n in np.unique(ks[many & (ks > 0)]):
                    of = np.flatnonzero(many & (ks == n))
                    low = np.partition(np.where(open_[of], scores[of], -np.inf), -n, axis=1)[:, -n]
                    open_[of] &= scores[of] >= low[:, None] - SLACK
                row, at = np.nonzero(open_)
                score = np.round(scores[row, at], 6)
                order = np.lexsort((keys[at], -score, row))
                row, at, score = row[order], at[order], score[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < ks[row]  # place among the question's own
                yield pd.DataFrame({"question_id": np.asarray(q_ids)[row[top]], "asks": ks[row[top]], "k": keys[at[top]], "score": score[top]})

    found = pairs.select("ids", "units", "q_ids", "q_units", "q_ks", "q_bounds").mapInPandas(best, f"question_id {question_kind}, asks int, k {key_kind}, score double")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "k")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("asks")).select("question_id", "k", "score", "rank")


def metric_status(name: str, value: Column) -> Column:
    """How a transcript's metric compares with the benchmarks."""
    # Speech rate optimum, diversity of high and low groups, sentence length, reading ease.
    rate, high, low, short, long, ease = 105, 0.36, 0.27, 10, 20, -2112.0
    ladders = {
        "speech_rate_wpm": F.when(value < rate - 10, "slow").when(value > rate + 10, "fast").otherwise("optimal"),
        "lexical_diversity": F.when(value >= high, "excellent").when(value >= (high + low) / 2, "moderate").otherwise("low"),
        "avg_words_per_sentence": F.when(value < short, "too_short").when(value > long, "too_long").otherwise("good"),
        "flesch_reading_ease": F.when(value > ease, "accessible").otherwise("complex"),
    }
    return F.when(value.isNotNull(), ladders[name])
