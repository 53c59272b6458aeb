"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon of words and of word beginnings that the training rows set apart, their nearness to
second-person pronouns, and the rates of capitals, punctuation, stretched and obfuscated words. The
lexicon, the trees and the calibration are learned on a bounded sample of labelled training rows; every
whole text is scored.

Defined results: a null or empty text has zero features and a score like any other; a row without doc_id is no
training row by label; repeated rows are scored each for itself, and of an id's several texts or labels the least is
learned from; a very long text is scored whole; of equal splits the first feature's counts; an empty table gives an empty
result; without labels, or with one label alone, the score is the share of label 1 (0 without any); further columns,
whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .tokens import in_slices, words_of

#: The sample: labelled training rows at most, and bytes of text that they may have together.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32_000_000
#: Second-person pronouns of the corpus' languages, and the letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros os".split())
LEET = str.maketrans("01345789@$!+|", "oieastbgasitl")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NEAR = 5
STEMS = (4, 5, 6, 7)
PER_WORD = ("lexicon", "weight", "stem", "stem_weight", "unmasked", "second_person", "masked", "stretched", "upper", "shouted", "exclaimed", "asked", "marks", "letters")


def is_training(doc_id: int, folds: int = 3, held: int = 1) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds != held


def _terms(text: str) -> set[str]:
    """Words without marks at their ends, and the beginnings of words, written with a hyphen."""
    words = {EDGE.sub("", w) for w in set(text.lower().split())}
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def lexicon(texts: list[str], labels: list[int], least: int = 5, most: int = 4000) -> dict[str, float]:
    """Log odds of the terms that toxic texts use far more than others."""
    seen = {0: Counter(), 1: Counter()}
    for t, y in zip(texts, labels, strict=True):
        seen[y].update(_terms(t))
    n1, n0 = sum(labels), len(labels) - sum(labels)
    odds = {t: math.log((k + 0.5) / (n1 + 1)) - math.log((seen[0][t] + 0.5) / (n0 + 1)) for t, k in seen[1].items() if k >= least}
    best = sorted((t for t in odds if odds[t] > 1.5), key=lambda t: (-odds[t] * math.sqrt(seen[1][t]), t))
    return {t: odds[t] for t in best[:most]}


class Features:
    """Dense features; those of a distinct word are kept, at most `most` words."""

    def __init__(self, terms: dict[str, float], most: int = 300_000):
        self.terms, self.most, self.place, self.rows = terms, most, {}, np.zeros((0, len(PER_WORD)), np.float32)

    def of_word(self, raw: str) -> tuple:
        low = raw.lower()
        word = EDGE.sub("", low)
        weight = self.terms.get(word, 0.0)
        stem = max((self.terms.get(word[:n] + "-", 0.0) for n in STEMS if len(word) > n), default=0.0)
        letters = sum(map(str.isalpha, raw))
        upper = sum(map(str.isupper, raw))
        masked = letters > 1 and letters < len(word) and not word.isalpha()
        plain = word.translate(LEET) if masked else word
        plain = STRETCHED.sub(r"\1", plain) if masked or STRETCHED.search(plain) else plain
        unmasked = 0.0 if plain == word else self.terms.get(plain, 0.0) or self.terms.get(re.sub(r"[\W_]", "", plain), 0.0)
        return (weight > 0, weight, stem > 0, stem, unmasked, word in SECOND_PERSON, masked, STRETCHED.search(word) is not None, upper, letters > 1 and upper == letters, raw.count("!"), raw.count("?"), len(raw) - sum(map(str.isalnum, raw)), letters)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        words = list(map(words_of, texts))
        new = sorted({w for its in words for w in its if w not in self.place})
        if len(self.place) + len(new) > self.most:
            self.place, self.rows = {}, self.rows[:0]
            new = sorted({w for its in words for w in its})
        if new:
            first = len(self.place)
            self.place.update((w, first + i) for i, w in enumerate(new))
            self.rows = np.concatenate([self.rows, np.array([self.of_word(w) for w in new], np.float32)])
        return np.array([self.of_text(its) for its in words]) if texts else np.zeros((0, len(PER_WORD) + 5))

    def of_text(self, words: list[str]) -> np.ndarray:
        m = self.rows[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        total, n = m.sum(axis=0, dtype=np.float64), max(1, len(words))
        hits = (m[:, 0] > 0) | (m[:, 4] > 0)
        near = 0.0
        if hits.any() and (m[:, 5] > 0).any():
            you, hit = np.flatnonzero(m[:, 5]), np.flatnonzero(hits)
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(hit - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hit))
            near = float((gap <= NEAR).sum())
        most = m.max(axis=0) if len(m) else np.zeros(len(PER_WORD))
        rates = total / n
        rates[8] = total[8] / max(1.0, total[13])
        return np.concatenate([rates, [total[0], total[2], near, most[1], math.log1p(len(words))]])


class Boosted:
    """Logistic gradient boosting with histograms of at most `bins` bins a feature."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 15):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.first, self.grown = math.log(share / (1 - share)), []
        margin = np.full(len(y), self.first)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.grown.append(tree)
            margin += self._value(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)]).astype(np.uint8)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        g0, h0 = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.least:
            for f in range(b.shape[1]):
                c = b[rows, f]
                gs, hs = (np.bincount(c, weights=w[rows], minlength=self.bins).cumsum()[:-1] for w in (g, h))
                ns = np.bincount(c, minlength=self.bins).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g0 - gs) ** 2 / (h0 - hs + 1) - g0**2 / (h0 + 1)
                gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return self.rate * g0 / (h0 + 1)
        near = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(b, g, h, rows[near], depth - 1), self._grow(b, g, h, rows[~near], depth - 1)

    def _value(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, k, low, high = tree
        near = b[:, f] <= k
        out = np.empty(len(b))
        out[near], out[~near] = self._value(low, b[near]), self._value(high, b[~near])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.first + sum((self._value(t, b) for t in self.grown), np.zeros(len(x)))


class Isotonic:
    """The monotone step function nearest to the labels, by pooling adjacent violators; linear between steps."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v in zip(margin[order], y[order], strict=True):
            pools.append([float(v), 1.0, float(m), float(m)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                s, n, _, high = pools.pop()
                pools[-1][0] += s
                pools[-1][1] += n
                pools[-1][3] = high
        self.x = np.array([m for p in pools for m in p[2:]])
        self.y = np.array([v for s, n, _, _ in pools for v in [(s + 0.5 * (s / n)) / (n + 0.5)] * 2])
        return self

    def score(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)


class Model:
    def __init__(self, ids: list[int], texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.share = float(y.mean()) if len(y) else 0.0
        self.learned = 0 < self.share < 1 and len(y) >= 50
        self.terms: dict[str, float] = {}
        if not self.learned:
            return
        # Two folds by id: each fold's features come from a lexicon of the other, so training sees honest densities.
        fold = np.array([zlib.crc32(b"fold" + str(i).encode()) % 2 for i in ids])
        x = np.zeros((len(y), len(PER_WORD) + 5))
        margin = np.zeros(len(y))
        for k in (0, 1):
            other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(own):
                x[own] = Features(lexicon([texts[i] for i in other], [labels[i] for i in other])).of_texts([texts[i] for i in own])
        for k in (0, 1):
            other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(own) and len(other):
                margin[own] = Boosted().fit(x[other], y[other]).margin(x[own])
        self.trees, self.calibrated = Boosted().fit(x, y), Isotonic().fit(margin, y)
        self.terms = lexicon(texts, labels)

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.calibrated.score(self.trees.margin(features)) if self.learned else np.full(len(features), self.share)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of at most sample_rows labelled training rows and sample_bytes bytes, those that come first by a hash of
    their id, texts of any length. A row that would pass the bytes is left out, later ones that fit are not."""
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training)
    chosen = written(chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "labelled")
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    rows = written(rows, "sample")  # a row for each of the sample's ids
    sizes = sorted(rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"]))
    taken, used = set(), 0
    for r in sizes:
        if used + r["n"] <= sample_bytes:
            taken.add(r["doc_id"])
            used += r["n"]
    fits = rows if len(taken) == len(sizes) else rows.where(F.col("doc_id").isin(*taken))
    rows = sorted(fits.collect(), key=lambda r: r["doc_id"])
    return Model([r["doc_id"] for r in rows], [r["text"] for r in rows], [r["toxic"] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each whole text."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of 4000 terms, 80 small trees, and the steps
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.terms)
        for doc_ids, texts in in_slices(batches):
            s = model.score(features.of_texts(texts))
            held = [d is not None and not is_training(d) for d in doc_ids]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=kinds)

    return text_of(docs).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
