import numpy as np
import pytest

from gneiss.llm.vantage import PIECE, Tree, neighbours


def brute(rows, queries, k):
    """Ranked lists of each query row: all other rows by inner product, ties to the smaller id."""
    out = []
    for q in queries:
        rest = [(-float(sum(a * b for a, b in zip(rows[q][1], v, strict=True))), i) for r, (i, v) in enumerate(rows) if r != q]
        out.append((rows[q][0], [(i, -s) for s, i in sorted(rest)[:k]]))
    return out



def test_repeated_ids_count_and_own_row_is_left_out(spark, monkeypatch):
    """Rows that share an id are candidates for each other, also with equal vectors; each vector of a query's id has its own ranks."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-4, 5, 6)]) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)]
    at = {i: r for r, (i, _) in enumerate(rows)}
    rows += [(20, [4.0, -4.0, 3.0, 1.0, 0.0, 2.0]), (40, list(rows[at[40]][1])), (40, list(rows[at[40]][1])), (7, list(rows[at[60]][1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr("gneiss.llm.vantage.PIECE", 5)
    found = neighbours(df, df.where("vec_id % 20 = 0"), 10, shard=40, block=7)
    sides = {}
    for r in found.collect():
        sides.setdefault(r.query_id, []).append(r)
    want = brute(rows, [r for r, (i, _) in enumerate(rows) if i % 20 == 0], 10)
    once = []
    for q, near in want:  # equal rows are one query
        if (q, near) not in once:
            once.append((q, near))
    got = {}
    for q, rs in sides.items():
        assert len(rs) == 10 * sum(1 for i, _ in once if i == q)
        got[q] = sorted((r["rank"], r.vec_id, r.score) for r in rs)
    for q in got:
        assert got[q] == sorted((k, v, s) for i, near in once if i == q for k, (v, s) in enumerate(near, 1))


@pytest.mark.parametrize("scale", [1e155, 1e-160])
def test_huge_and_tiny_numbers(spark, scale):
    """Products beyond the doubles: neighbours are found by the scaled product."""
    x = np.random.default_rng(4).normal(size=(600, 8))
    rows, score = Tree(x * scale).nearest(x[:20] * scale, 5, 1.0)
    assert np.isfinite(score).all()
    for i in range(20):
        assert set(rows[i]) == set(np.argsort(-(x @ x[i]))[:5])
    df = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours(df, df.where("vec_id % 100 = 0"), 5).count() == 30


def test_recall_beyond_factor_one():
    x = np.random.default_rng(5).normal(size=(6000, 12))
    asked = x[: PIECE // 8]
    exact, _ = Tree(x).nearest(asked, 20, 1.0)
    near, _ = Tree(x).nearest(asked, 20, 1.25)
    want = np.argsort(-(asked @ x.T), axis=1)[:, :20]
    share = lambda rows: np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows, want, strict=True)])
    assert share(exact) == 1
    assert share(near) >= 0.9
