"""Position-weighted sums of vectors."""

import math

from gneiss.catalog import more
from gneiss.operators import features


def test_codes_of_odd_vectors(spark):
    """Vectors of all lengths, with NaN, null places, and none; no lambda goes over the places, as one did before."""
    rows = [(1, [1.0, 0.5, 2.0]), (2, []), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [0.0] * 1000 + [1.0])]
    df = more._code(spark.createDataFrame(rows, "id long, features array<double>"), ["id"])
    got = {r.id: (r.width, r.code) for r in df.collect()}
    assert got.pop(3)[0] == 2 and got == {1: (3, 8.0), 2: (0, 0.0), 4: (2, None), 5: (1001, 1001.0)}
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_vectors_are_made_of_doubles(spark):
    """Without a cast of the whole vector."""
    atoms = spark.createDataFrame([(1, 1, 5, 9, 4, 1, 1, None)], "graph_id long, node_id long, atomic_num int, degree int, num_h int, charge int, ring int, aromatic int")
    df = features.atom_features_wide(atoms)
    x = df.first().features
    assert [i for i, v in enumerate(x) if v] == [5, 1005, 1010, 1011, 1012] and len(x) == 1014
    assert "array<double>" not in df._jdf.queryExecution().optimizedPlan().toString()
