"""Pairs of rows of one id, which Kendall's tau leaves out, by tasks and by inversions of blocks."""

import random

import pytest

from gneiss.functions import metrics


def test_rows_of_one_id_are_counted_in_tasks(spark, monkeypatch):
    """The same by both ways and by the pairs; where no id has many rows, only the groups themselves take a global order."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([3, 4, *range(40)]), float(rng.randrange(9)), float(rng.randrange(6))) for _ in range(500)]
    df, calls, count = spark.createDataFrame(rows, "g long, i long, y double, score double"), [], metrics._sums_by_inversions
    monkeypatch.setattr(metrics, "_sums_by_inversions", lambda d, by, block: calls.append(list(by)) or count(d, by, block))
    got = lambda **k: {r.g: r.kendall for r in metrics.kendall(df, ["g"], "i", **k).collect()}
    one = got()
    assert calls == [["g"]]
    assert one == pytest.approx(got(few=1000)) and one == pytest.approx(got(most=8)) and calls[-2:] == [["g", "_who"], ["g"]]
