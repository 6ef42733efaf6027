"""Operators that use a table many times compute it once, and what stands in for wide shuffles keeps their rows."""

import pytest
from pyspark.sql import functions as F

from gneiss.catalog import links
from gneiss.operators import blocks, features, splits


@pytest.fixture
def counted(spark, tmp_path):
    """Edges ``(src, dst, w)``, and how often they were computed."""
    log = tmp_path / "log"

    def seen(batches):
        for b in batches:
            if b.num_rows:
                with open(log, "a") as f:
                    f.write("x")
            yield b

    rows = [(a, b, 1 + (a * b) % 3) for a in range(12) for b in range(12) if (a * 5 + b * 3) % 4 == 0]
    edges = spark.createDataFrame(rows, "src long, dst long, w long").coalesce(1).mapInArrow(seen, "src long, dst long, w long")
    return edges, lambda: len(log.read_text())


def test_edges_are_computed_once(spark, counted, monkeypatch):
    edges, times = counted
    part = spark.range(12).select(F.col("id").alias("node"), (F.col("id") % 3).alias("block"))
    blocks.em_partition(edges, part, 2).count()
    assert times() == 1
    splits.train_negatives(edges, part, 1).count()
    assert times() == 2
    monkeypatch.setattr(links, "supply_edges", lambda *_: edges)
    monkeypatch.setattr(links, "nation_part", lambda *_: part)
    links.sbm16_flat_likelihood(spark, "").count()
    assert times() == 3


def test_padding_shuffles_rows_not_the_grid(spark):
    """Cells that occur twice or lie outside the grid as before; the grid isn't joined cell by cell."""
    cells = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 1, 3.0), (1, 3, 2, None), (2, 1, 2, 5.0), (2, 0, 1, 9.0)], "graph_id long, i long, j long, v double")
    padded = features.pad_batch(cells)
    got = sorted((r.graph_id, r.i, r.j, r.v) for r in padded.collect())
    want = [(g, i, j, 0.0) for g in (1, 2) for i in (1, 2, 3) for j in (1, 2, 3) if (g, i, j) not in {(1, 1, 1), (2, 1, 2)}]
    assert got == sorted([*want, (1, 1, 1, 2.0), (1, 1, 1, 3.0), (2, 1, 2, 5.0)])
    plan = padded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Generate explode(concat(")[0] and "array_except" in plan


def test_core_rounds_broadcast_nothing(spark, monkeypatch):
    from gneiss.operators import graphs

    monkeypatch.setattr(graphs, "until_settled", lambda df, step, mark: step(df))
    one = graphs.kcore(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long"))
    assert {tuple(r) for r in one.collect()} == {(1, 2), (2, 2), (3, 2), (4, 1)}
    assert "Broadcast" not in one._jdf.queryExecution().executedPlan().toString()
