"""The regression network: gradients against differences, the same result for any partitions, early stopping, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cursus.operators import network as N


def test_gradients_are_those_of_small_steps():
    r = np.random.default_rng(1)
    net = N.Network.drawn([3, 5, 4, 1], 2)
    x, y, flat = r.normal(size=(7, 3)), r.normal(size=7), net.flat()
    loss, gradient = net.gradient(x, y)
    assert loss == pytest.approx(((net.predict(x) - y) ** 2).sum())
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert gradient[k] == pytest.approx((net.with_flat(up).gradient(x, y)[0] - net.with_flat(down).gradient(x, y)[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_fit(spark, tmp_path):
    df = spark.range(600).select("id", ((F.col("id") % 31) / 15 - 1).alias("a"), ((F.col("id") * 7 % 29) / 14 - 1).alias("b"))
    df = df.select("id", F.array("a", "b").alias("x"), (F.col("a") * F.col("a") + F.abs("b") + 3).alias("y")).unionByName(spark.createDataFrame([(9000, None, 1.0), (9001, [0.0, 0.0], None)], "id long, x array<double>, y double"))
    one, five = (N.fit_network(df.repartition(n), "id", "x", "y", hidden=(8,), steps=12, rate=0.05) for n in (1, 5))
    assert np.allclose(one.network.flat(), five.network.flat(), atol=1e-9) and one.steps == five.steps
    rows = df.where("x IS NOT NULL AND y IS NOT NULL")
    spread = rows.agg(F.var_pop("y")).first()[0]
    assert one.held_mse < 0.9 * spread
    one.save(spark, f"file://{tmp_path}/net")
    got, again = ({r["id"]: r["predicted"] for r in m.transform(rows).collect()} for m in (one, N.NetworkModel.load(spark, f"file://{tmp_path}/net")))
    assert got == again and len(got) == 600
    stopped = N.fit_network(df, "id", "x", "y", hidden=(4,), steps=50, rate=0.0, patience=2)
    assert stopped.steps == 0
