"""Leaf-wise boosting against a plain version that tries every split, and statistics that leave a row's own target out."""

import hashlib
import random

import numpy as np
import pytest

from cursus.operators import boosting as B


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(4)
    rows = [(i, float(r.randint(0, 9)), float(r.randint(0, 5)) if i % 11 else None, r.choice("abc"), 0.0) for i in range(400)]
    rows = [(i, a, b, c, 2 * a + (a > 5) * (b or 0) * 3 + r.gauss(0, 1)) for i, a, b, c, _ in rows]
    return rows, spark.createDataFrame([*rows, (400, 1.0, 1.0, "a", None)], "id int, a double, b double, c string, y double").repartition(4).cache()


def plain(rows, trees, leaves, rate, least, smooth):
    """Each step tries all cuts at all values of both features in all leaves."""
    x = np.array([[a, -1.0 if b is None else b] for _, a, b, *_ in rows])  # null lies below all
    y = np.array([r[-1] for r in rows])
    g, first = y - y.mean(), y.mean()
    score = lambda s: s.sum() ** 2 / (len(s) + smooth)
    for _ in range(trees):
        leaf, n = np.zeros(len(y), int), 1
        while n < leaves:
            best = (1e-9, None)
            for k in sorted(set(leaf)):
                here = leaf == k
                for f in (0, 1):
                    for cut in sorted(set(x[:, f]))[:-1]:
                        low = here & (x[:, f] <= cut)
                        if min(low.sum(), here.sum() - low.sum()) >= least:
                            gain = score(g[low]) + score(g[here & ~low]) - score(g[here])
                            if gain > best[0] + 1e-9:
                                best = (gain, (here & ~low))
            if best[1] is None:
                break
            leaf[best[1]] = n
            n += 1
        for k in range(n):
            here = leaf == k
            g[here] -= rate * g[here].sum() / (here.sum() + smooth)
    return first, y - g


@pytest.mark.parametrize(("trees", "leaves"), [(1, 2), (1, 6), (3, 5)])
def test_splits_are_those_of_a_search_of_all(spark, table, tmp_path, trees, leaves):
    rows, df = table
    model = B.fit_leafwise(df, ["a", "b"], "y", trees=trees, leaves=leaves, rate=0.5, least=5)
    _, want = plain(rows, trees, leaves, 0.5, 5, 1.0)
    got = {r["id"]: r["predicted"] for r in model.transform(df).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want.tolist()) and len(model.trees) == trees
    model.save(spark, f"file://{tmp_path}/m")
    assert {r["id"]: r["predicted"] for r in B.Leafwise.load(spark, f"file://{tmp_path}/m").transform(df).collect()} == got


def test_any_partitioning_gives_the_same_trees(table):
    _, df = table
    one, seven = (B.fit_leafwise(df.repartition(n), ["a", "b"], "y", trees=2, leaves=4) for n in (1, 7))
    assert [t.splits for t in one.trees] == [t.splits for t in seven.trees]


def test_ordered_statistics_leave_the_own_target_out(table):
    rows, df = table
    got = {r["id"]: r["s"] for r in B.ordered_target_statistics(df, "id", "c", "y", "s", parts=8).collect()}
    mean = np.mean([r[-1] for r in rows])
    place = lambda i: hashlib.md5(f"order:{i}".encode()).hexdigest()
    for i, _, _, c, _ in rows:
        before = [r[-1] for r in rows if r[3] == c and (place(r[0]), r[0]) < (place(i), i)]
        assert got[i] == pytest.approx((sum(before) + mean) / (len(before) + 1))
    assert len(got) == 401
    whole = {r["value"]: r["statistic"] for r in B.target_statistics(df, "c", "y").collect()}
    for c in "abc":
        own = [r[-1] for r in rows if r[3] == c]
        assert whole[c] == pytest.approx((sum(own) + mean) / (len(own) + 1))
