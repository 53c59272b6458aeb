"""The near-duplicate stage finds links through SimHash and its vantage-point trees, and keeps those that are similar."""

import random

import pytest

pytest.importorskip("cursus.llm")

from pyspark.sql import functions as F  # noqa: E402

from cursus.llm import jaccard, simhash  # noqa: E402


def test_simhash_links_without_bands(spark, monkeypatch):
    """With no band in common, rows within the bits are still linked if they are similar, and only then."""
    r = random.Random(3)
    words = [f"w{r.randrange(400)}" for _ in range(600)]
    near = [[*words[:-k], *["x"] * k] for k in range(1, 6)]
    texts = [" ".join(w) for w in (words, *near, ["y"] * 50, ["y"] * 50 + ["z"])]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    linked = {k for k in range(1, 6) if (fps[0] ^ fps[k]).bit_count() <= simhash.BITS}
    assert linked
    made = jaccard.signatures
    monkeypatch.setattr(jaccard, "signatures", lambda rows, n: made(rows, n).withColumn("bands", F.array(F.xxhash64("__row"))))
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    root = {x["__row"]: x["root"] for x in jaccard.near_roots(rows).collect()}
    assert all(root.get(k) == 0 for k in linked) and root.get(6, 6) != root.get(7, 7)


def test_pairs_of_fingerprints(spark):
    """Equal fingerprints and linked ones, the smaller row first; rows far apart are no pair."""
    texts = ["a b c d e f g", "A B C D E F G", "q r s t u v w x y z", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    assert {(x["a"], x["b"]) for x in jaccard.fingerprint_pairs(rows).collect()} == {(0, 1), (3, 4)}
