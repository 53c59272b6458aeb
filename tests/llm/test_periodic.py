"""Periodic runs against a search of all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("cursus.llm")
from cursus.llm import periodic  # noqa: E402

SCHEMA = "doc_id long, text string, runs string, start long"


def plain_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            seg = w[s : x + q]
            if len(seg) >= max(least, 2 * q) and not any(seg[p:] == seg[:-p] for p in range(1, q)):
                out.append((s, len(seg), q))
            x += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    r = random.Random(letters)
    for _ in range(300):
        w = [r.randrange(letters) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.5:
            a = r.randrange(len(w))
            w = w[:a] + [w[a + i % (1 + (len(w) - a) // r.randint(2, 9))] for i in range(len(w) - a)]
        least = r.choice([2, 5, 12])
        assert list(map(tuple, periodic.maximal_runs(np.array([*w, -1]), least).tolist())) == plain_runs(w, least)


def test_runs_of_words_that_repeat_much():
    fib, two = [0], [0, 1]
    while len(two) < 400:
        fib, two = two, two + fib
    thue = [i.bit_count() % 2 for i in range(512)]
    for w in (two, thue, [0] * 300, [0, 1, 1] * 100, [*range(40)] * 5 + [7] * 60):
        assert list(map(tuple, periodic.maximal_runs(np.array([*w, -1])).tolist())) == plain_runs(w)
    assert periodic.maximal_runs(np.array([*([3] * 100_000), -1])).tolist() == [[0, 100_000, 1]]


def made():
    r = random.Random(4)
    words = "a b c ä la la la the, \x1c x\x00y".split(" ")
    texts = [r.choice([" ", "\n", " \t\x0b"]).join(r.choices(words, k=r.randint(0, 60))) for _ in range(150)]
    texts += ["na " * 40 + "end", " ".join(["one two three"] * 9), " ".join(f"w{i}" for i in range(3000)), ("la " * 20_000).strip(), "", " \n", None]
    return [(i, t, "clash", None) for i, t in enumerate(texts)] + [(3, texts[3], None, 1), (None, "so " * 14, None, None), (None, None, None, None)]


def plain_row(doc_id, text, tails):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if len(w) < 5000 else [(0, len(w), 1)]  # the long text has one word
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, n, q, None if n is None else 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


@pytest.mark.parametrize("tails", [True, False])
def test_query_against_plain_search(spark, tails):
    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    got = [tuple(r) for r in periodic.digest(periodic.periodic_runs(docs, tails=tails)).collect()]
    want = [plain_row(i, t, tails) for i, t, *_ in made() if t is None or len(t) < 9000 or "w1 " not in t]
    long = [plain_row(i, t, False) for i, t, *_ in made() if t and "w1 " in t and not (tails and zlib.crc32(str(i).encode()) % 10 == 0)]
    assert sorted(set(want + long) - set(got), key=str) == []
    assert len(got) == len(made()) and sum(r[1] for r in got) > (10 if tails else 3)
    assert periodic.digest(periodic.periodic_runs(docs.limit(0))).count() == 0
