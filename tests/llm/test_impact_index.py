"""Ranked search against scores worked out document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("cursus.llm")
from cursus.llm import impact_index  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s and i is not None:
                scored.append((-s, i))
        out.update((item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


def made():
    r = random.Random(9)
    words = ["the", "The", "of", "x1", "été", "ÉTÉ", "naïve", "a_b", "日本", "don't", "½", "\x00q", *(f"w{i}" for i in range(40))]
    texts = [r.choice([" ", "\n", "--"]).join(r.choices(words, k=int(r.paretovariate(0.9) * 4) % 300)) for _ in range(500)]
    texts += [None, "", " !! ", " ".join(["the"] * 30_000 + ["rare"]), texts[5], texts[5]]
    return [(i * 7 % 4001, t) for i, t in enumerate(texts)] + [(35, texts[5]), (None, "w1 w2 rare"), (None, None)]


ITEMS = [(1, "the of"), (2, "THE, w3 w3 w4 été"), (3, "nowhere"), (4, None), (5, "rare W5 q a b don t"), (5, "½ 日本"), (6, " ".join(f"w{i}" for i in range(40)))]


@pytest.mark.parametrize(("k", "chars", "docs_a_block", "side"), [(10, 8_000_000, 8192, 64), (3, 3000, 50, 2), (1000, 20_000, 64, 3)])
def test_search_is_the_plain_one(spark, monkeypatch, k, chars, docs_a_block, side):
    monkeypatch.setattr(impact_index, "SIDE_BY_SIDE", side)
    monkeypatch.setattr(impact_index, "JOB_ITEMS", 4)
    docs = spark.createDataFrame([(i, t, "c", None) for i, t in made()], "doc_id long, text string, term string, block long").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    # Tasks have a copy of the module, so what they read of it goes as arguments of build.
    index = impact_index.build(docs, chars, docs_a_block)
    got = Counter(tuple(r) for r in impact_index.search(index, items, k).collect())
    assert got == plain_search(made(), ITEMS, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(made(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact_index.search(impact_index.build(docs.limit(0)), items).count() == 0
    assert impact_index.search(impact_index.build(docs), items.limit(0)).count() == 0


def test_adders_and_top():
    r = np.random.default_rng(3)
    width, values, want = 2, r.integers(0, 1 << 20, (4, 5, 128)), np.zeros((5, 128), np.int64)
    slices = lambda v, n: np.stack([np.packbits(v >> s & 1, axis=-1, bitorder="little").view("<u8") for s in range(n)])
    total = np.zeros((30, 5, width), np.uint64)
    for shift, v in enumerate(values):
        impact_index._add(total, slices(v, 20), shift)
        want += v << shift
    assert np.array_equal(total, slices(want, 30))
    few = np.minimum(want % 7, 4)  # many ties
    valid = np.packbits(np.arange(128) < 100, bitorder="little").view("<u8")
    sure, ties = impact_index._top(slices(few, 3), valid, 30)
    for i in range(5):
        best = sorted((-x, d) for d, x in enumerate(few[i, :100].tolist()) if x)[:30]
        at = [*impact_index._places(sure[i]), *impact_index._places(ties[i])]
        assert sorted(at[:30]) == sorted(d for _, d in best)
