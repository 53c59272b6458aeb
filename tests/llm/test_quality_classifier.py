"""The subword classifier: features and scores against plain loops, held-out accuracy, awkward rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("cursus.llm")
from cursus.llm import quality_classifier as qc  # noqa: E402
from cursus.llm.tokens import words_of  # noqa: E402

M64 = (1 << 64) - 1
PRIME, MIX = int(qc._PRIME), int(qc._MIX)


def bucket(h):
    h = h * MIX & M64
    return ((h ^ (h >> 29)) * MIX & M64) >> 64 - int(math.log2(qc.BUCKETS))


def hashed(chars):
    h = 0
    for c in chars:
        h = (h * PRIME + ord(c) + 1) & M64
    return h


def whole(word):
    return sum((ord(c) + 1) * pow(PRIME, k + 1, 1 << 64) for k, c in enumerate(" " + word)) & M64


def plain_features(text):
    """{bucket: weight} of a text."""
    w, out = words_of(text), {}
    for x in w:
        its = [bucket(whole(x) ^ int(qc._WORD))]
        its += [bucket(hashed(f" {x} "[i : i + n])) for n in qc.GRAMS for i in range(len(x) + 3 - n)]
        for b in its:
            out[b] = out.get(b, 0) + 1 / len(its)
    for a, b in zip(w, w[1:]):
        h = bucket(int(qc._SAME) if a == b else (whole(a) * PRIME + whole(b) & M64) ^ int(qc._PAIR))
        out[h] = out.get(h, 0) + 1
    return {b: v / (2 * len(w) - 1) for b, v in out.items()}


TEXTS = ["", " \n", "a", "a a", "The quick  brown\tfox", "été été naïve 日本 \x1c x", "no no no no yes", "ABC!! " * 40, "x" * 300]


def test_features_are_the_plain_ones():
    for text, (found, weight) in zip(TEXTS, qc._of_texts(TEXTS), strict=True):
        want = plain_features(text)
        assert set(found.tolist()) == set(want)
        assert np.allclose(weight, [want[b] for b in found.tolist()], atol=1e-6)


def labelled(n=400, seed=3):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "re un con der st".split() for b in "ing ed lich ción er".split()]
    rows = []
    for i in range(n):
        good = r.random() < 0.75
        w = r.choices(words, k=r.randint(5, 60))
        kind = r.randrange(3)
        text = " ".join(w) if good else " ".join(x + "###" for x in w) if kind == 0 else " ".join(x.upper() + "!!" for x in w) if kind == 1 else " ".join([w[0]] * len(w))
        rows.append((i, text, int(good)))
    return rows


def test_scores_are_the_plain_ones_and_hold_on_held_out_rows():
    rows = labelled()
    train = [x for x in rows if qc.is_training(x[0])]
    model = qc.Model([t for _, t, _ in train], [y for *_, y in train])
    again = qc.Model([t for _, t, _ in train], [y for *_, y in train])
    assert np.array_equal(model.margin, again.margin)
    got = model.score(pa.array(TEXTS))
    for text, s in zip(TEXTS, got, strict=True):
        margin = model.bias + sum(v * float(model.margin[b]) for b, v in plain_features(text).items())
        assert math.isclose(s, 1 / (1 + math.exp(-margin)), rel_tol=1e-6)
    held = [x for x in rows if not qc.is_training(x[0])]
    s = model.score(pa.array([t for _, t, _ in held]))
    y = np.array([y for *_, y in held])
    assert len(held) > 50 and ((s >= 0.3) == (y == 1)).mean() > 0.97


def test_query(spark):
    rows = labelled(120)
    extra = [(500, None), (501, ""), (None, "no id"), (3, rows[3][1]), (502, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t, _ in rows] + [(i, t, None, None) for i, t in extra], "doc_id long, text string, quality string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 1), (7, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = qc.classify(docs, labels).collect()
    assert len(got) == 125 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[500] == by_id[501]
    # The labels of held-out rows play no part.
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in qc.classify(docs, flipped).collect()} == by_id
    assert qc.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in qc.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in qc.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
