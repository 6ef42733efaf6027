"""Walks in dense graphs strip by strip against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import graphs as G
from gneiss.operators import products as P
from gneiss.operators import strips


def graph(spark, n, share, ids=lambda i: i):
    x = np.triu(np.random.default_rng(7).random((n, n)) < share, 1)
    return spark.createDataFrame([(ids(int(i)), ids(int(j))) for i, j in np.argwhere(x)], "src long, dst long"), (x | x.T).astype(int)


@pytest.mark.parametrize(("share", "ids"), [(0.05, lambda i: i), (0.12, lambda i: 3 - i), (0.3, lambda i: i * 10**14 - 5)])
def test_walks_of_dense_graphs(spark, monkeypatch, share, ids):
    """Several strips, little and much reached, ids with a start and scattered ones; no pair of nodes is a row of a product, as all were before."""
    def never(*_, **__):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(G, "products", never)
    monkeypatch.setattr(strips, "ITEMS", 40)
    n = 150
    edges, x = graph(spark, n, share, ids)
    w = 0.01 * x + 0.01**2 * (x @ x) + 0.01**3 * (x @ x @ x)
    got = {(r["src"], r["dst"]): r["w"] for r in G.katz(edges, 0.01, 3).collect()}
    assert got == pytest.approx({(ids(i), ids(j)): v for (i, j), v in np.ndenumerate(w) if v})
    for hops in (2, 3):
        reach = (sum(np.linalg.matrix_power(x, k) for k in range(1, hops + 1)) > 0).astype(int)
        want = {frozenset((ids(i), ids(j))): v for (i, j), v in np.ndenumerate(reach @ reach) if i < j and v >= 20}
        rows = G.common_neighbors(edges, 20, hops).collect()
        assert {frozenset((r["a"], r["b"])): r["common"] for r in rows} == want
        assert len(rows) == len(want) and all(r["a"] < r["b"] for r in rows)


def test_longer_walks_are_exact(spark):
    """Counts that outgrow small numbers, and the same weights as by products."""
    edges, x = graph(spark, 130, 0.5)
    power = [np.linalg.matrix_power(x, k) for k in range(1, 6)]
    want = {(int(i), int(j)): v for (i, j), v in np.ndenumerate(sum(0.01**k * p for k, p in enumerate(power, 1)))}
    assert {(r["src"], r["dst"]): r["w"] for r in G.katz(edges, 0.01, 5).collect()} == pytest.approx(want, rel=1e-12)


def test_sparse_graphs_keep_products(spark):
    ring = spark.range(2000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 2000).alias("dst"))
    assert not strips.is_dense(G.neighbours(ring))
    assert G.common_neighbors(ring, 2, 2).count() == 3 * 2000 and P.ROWS
