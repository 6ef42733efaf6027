"""Products of sparse matrices by blocks and by paths against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import graphs as G
from gneiss.operators import products as P


def entries(spark, x, ids=lambda i: i):
    return spark.createDataFrame([(ids(int(i)), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "node long, item long, w double")


@pytest.mark.parametrize("blocks", [True, False, None])
def test_products(spark, monkeypatch, blocks):
    """Several blocks, dense and sparse ones, weights of one and others, ids that fill their range and scattered ones."""
    monkeypatch.setattr(P, "ROWS", 64)
    monkeypatch.setattr(P, "ITEMS", 32)
    monkeypatch.setattr(P, "PATHS", 50)
    draw = np.random.default_rng(5)
    x = (draw.random((150, 100)) < 0.05) * 1.0
    x[:40, :50] = draw.random((40, 50)) < 0.7
    want, d = x @ x.T, (x > 0).sum(axis=1)
    got = {(r["a"], r["b"]): (r["da"], r["db"], r["value"]) for r in P.products(entries(spark, x), blocks=blocks).collect()}
    assert got == {(i, j): (d[i], d[j], want[i, j]) for i in range(150) for j in range(i + 1, 150) if want[i, j]}
    y = np.floor(draw.random((70, 100)) * 3) * (draw.random((70, 100)) < 0.2)
    far = P.products(entries(spark, x, lambda i: i * 10**14 - 5), entries(spark, y), lambda da, db, v: v >= 2, blocks)
    assert {(r["a"], r["b"]): r["value"] for r in far.collect()} == {(i * 10**14 - 5, j): v for (i, j), v in np.ndenumerate(x @ y.T) if v >= 2}


def test_what_a_task_holds_of_a_dense_graph_is_bounded(spark, monkeypatch):
    """No operator on the pairs of a dense graph makes a row for each path; before, all did."""
    joined = []
    monkeypatch.setattr(P, "_joined", lambda *a: joined.append(a))
    n = 60
    edges = spark.range(n).select(F.col("id").alias("src")).join(spark.range(n).select(F.col("id").alias("dst"))).where("src < dst")
    assert {r["common"] for r in G.wedge_counts(edges).collect()} == {n - 2}
    assert {r["common"] for r in G.common_neighbors(edges, 2, 2).collect()} == {n}
    assert G.jaccard(edges, 0.5).count() == n * (n - 1) // 2
    w = {r["src"] == r["dst"]: r["w"] for r in G.katz(edges, 0.001, 3).collect()}
    assert w[False] == pytest.approx(1e-3 + (n - 2) * 1e-6 + ((n - 1) * (n - 2) + 1) * 1e-9)
    assert w[True] == pytest.approx((n - 1) * 1e-6 + (n - 1) * (n - 2) * 1e-9)
    assert not joined


def test_no_key_of_a_join_has_a_whole_blocks_pairs(spark):
    """Each pair of a block comes once, whatever the parts; the join has keys for each two parts, where it had one a block."""
    part = spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 3).alias("block")).where("block < 2 or node < 4")
    rows = [(r["node"], r["block"]) for r in part.collect()]
    want = sorted((a, b) for a, x in rows for b, y in rows if x == y and a < b)
    for size in (1, 7, 1024):
        assert sorted((r["a"], r["b"]) for r in G.same_group_pairs(part, size).collect()) == want
