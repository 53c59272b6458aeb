"""Quality by supervised subword embeddings: one learned vector for each bucket of hashed features, averaged over a text,
and a softmax over the two labels.

Features are words, their character n-grams with the spaces around the word, and pairs of neighbouring words; a word that
repeats the one before it makes the same pair whatever the word. Each word counts as one, shared out over itself and its n-grams, and
each pair counts as one. Vectors and output are learned together, text by text, by stochastic gradient descent in numpy, on a
bounded sample of labelled training rows. Every whole text is scored. As the output is linear in the average, only each
bucket's share of the margin goes to the tasks; buckets that training has not seen have none.

Defined results: a null or empty text has no features and gets the score of the bias alone; a row without doc_id is no
training row by label; repeated rows are scored each for itself, and of an id's several texts or labels the least is learned
from; a very long text is scored whole; an empty table gives an empty result; without labels, or with one label alone, the
score is the share of label 1 (0 without any); further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import array_slices, distinct_words

#: The sample: labelled training rows at most, and bytes of text that they may have together.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16_000_000
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 18, 16, 5, 0.5
GRAMS = (3, 4, 5)
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: What tells words, repeated words and pairs from n-grams of the same characters.
_WORD, _PAIR, _SAME = (np.uint64(zlib.crc32(s) + 1) for s in (b"word", b"pair", b"same"))


def is_training(doc_id: int, folds: int = 5, held: int = 0) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds != held


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int32)


def word_features(words: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(a hash of each word, (words, buckets) of the words themselves and of their n-grams by length)."""
    chars = np.frombuffer(f" {' '.join(words.to_pylist())} ".encode("utf-32-le", "surrogatepass"), "<u4")
    spaces = np.flatnonzero(chars == 32)
    gap = np.diff(spaces)
    word = np.repeat(np.arange(len(gap)), gap)  # of each place but the last, the space before a word being its own
    stop = spaces[1:][word]
    place = np.arange(len(word))
    powers = np.cumprod(np.full(int(gap.max(initial=1)) + 1, _PRIME, np.uint64))
    codes = chars.astype(np.uint64) + np.uint64(1)
    whole = np.add.reduceat(codes[:-1] * powers[place - spaces[:-1][word]], spaces[:-1]) if len(gap) else np.zeros(0, np.uint64)
    out = [(np.arange(len(gap)), _bucket(whole ^ _WORD))]
    h = codes.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _PRIME + codes[n - 1 :]
        if n in GRAMS:
            fits = np.flatnonzero(place[: len(h)] + n - 1 <= stop[: len(h)])
            out.append((word[fits], _bucket(h[fits])))
    return whole, out


def pair_buckets(whole: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bucket of each word and the next one, in texts laid end to end."""
    a, b = whole[places[:-1]], whole[places[1:]]
    return _bucket(np.where(places[:-1] == places[1:], _SAME, (a * _PRIME + b) ^ _PAIR))


def _of_texts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text's features."""
    ends, places, words = distinct_words(pa.array(texts, pa.string()))
    whole, parts = word_features(words)
    owner, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    held = np.bincount(owner, minlength=len(words))
    first = np.cumsum(held) - held
    pairs = pair_buckets(whole, places)
    out = []
    for low, high in pairwise([0, *ends.tolist()]):
        its, n = np.unique(places[low:high], return_counts=True)
        at = np.concatenate([np.arange(first[w], first[w] + held[w]) for w in its]) if len(its) else np.zeros(0, int)
        both = np.concatenate([bucket[at], pairs[low : max(low, high - 1)]])
        weight = np.concatenate([np.repeat(n / np.maximum(1, held[its]), held[its]), np.ones(max(0, high - low - 1))])
        found, inverse = np.unique(both, return_inverse=True)
        out.append((found, (np.bincount(inverse, weight, len(found)) / max(1, 2 * (high - low) - 1)).astype(np.float32)))
    return out


class Model:
    """Learned from (text, label) rows; margin holds each bucket's share of the margin of label 1 over label 0."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        y = np.array(labels, int)
        self.share = float(y.mean()) if len(y) else 0.0
        self.learned = 0 < self.share < 1
        if not self.learned:
            return
        r = np.random.default_rng(seed)
        vectors = ((r.random((BUCKETS, DIMENSIONS), np.float32) - 0.5) * (2 / DIMENSIONS)).astype(np.float32)
        output, bias = np.zeros((2, DIMENSIONS), np.float32), np.array([math.log(1 - self.share), math.log(self.share)], np.float32)
        rows = [row for k in range(0, len(texts), 64) for row in _of_texts(texts[k : k + 64])]  # a text's features don't depend on the others
        seen = np.zeros(BUCKETS, bool)
        for found, _ in rows:
            seen[found] = True
        done, steps = 0, EPOCHS * len(rows)
        for _ in range(EPOCHS):
            for i in r.permutation(len(rows)):
                found, weight = rows[i]
                rate = RATE * (1 - done / steps)
                done += 1
                average = weight @ vectors[found] if len(found) else np.zeros(DIMENSIONS, np.float32)
                z = output @ average + bias
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[y[i]] -= 1
                back = error @ output
                output -= rate * np.outer(error, average)
                bias -= rate * error * np.float32(0.1)
                if len(found):
                    vectors[found] -= rate * weight[:, None] * back
        self.bias = float(bias[1] - bias[0])
        self.margin = np.where(seen, vectors @ (output[1] - output[0]), 0).astype(np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.learned:
            return np.full(len(texts), self.share)
        ends, places, words = distinct_words(texts)
        whole, parts = word_features(words)
        total, n = np.zeros(len(words)), np.zeros(len(words))
        for word, bucket in parts:
            total += np.bincount(word, self.margin[bucket], len(words))
            n += np.bincount(word, minlength=len(words))
        sums = np.concatenate([[0], np.cumsum((total / np.maximum(1, n))[places])])
        begins = np.concatenate([[0], ends[:-1]])
        margin = sums[ends] - sums[begins]
        sums = np.concatenate([[0], np.cumsum(self.margin[pair_buckets(whole, places)], dtype=float), [0]])
        size = ends - begins
        margin += np.where(size > 1, sums[np.maximum(begins, ends - 1)] - sums[begins], 0)
        return 1 / (1 + np.exp(-np.clip(self.bias + margin / np.maximum(1, 2 * size - 1), -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of at most sample_rows labelled training rows and sample_bytes bytes: those that come first by a hash of their id,
    a row that would pass the bytes being left out."""
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & training)
    chosen = written(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labelled")
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = written(rows, "sample")  # a row for each of the sample's ids
    taken, used = [], 0
    for r in sorted(rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        if used + r["n"] <= sample_bytes:
            taken.append(r["doc_id"])
            used += r["n"]
    rows = sorted(rows.where(F.col("doc_id").isin(*taken)).collect() if taken else [], key=lambda r: r["doc_id"])
    return Model([r["text"] for r in rows], [r["quality"] for r in rows])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # a number for each bucket
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in array_slices(batches, 1_000_000):
            s = model.score(texts)
            held = [d is not None and not is_training(d) for d in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=kinds)

    return text_of(docs).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
