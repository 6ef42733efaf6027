"""Removal of repeated sequences against a count of all windows, and what anchors promise."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from gneiss.llm.recompression import anchors, without_repeats
from gneiss.llm.shared import mixed

SCHEMA = "doc_id long, text string, mark string, found int"


def plain(rows, window):
    """Every window of every row, counted."""
    texts = [[w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t or "").split(" ") if w] for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def sample():
    draw = np.random.default_rng(3)
    prose = lambda n, letters=300: " ".join(f"w{k}" for k in draw.integers(0, letters, n))
    rows = [(None, None, "x", 1), (None, "", "x", 1), (1, prose(34), "x", 1), (1, prose(34), "x", 1)]
    exact, passage, short = prose(400), prose(60), prose(35)
    rows += [(2, exact, "", 0), (3, exact, "", 0), (3, exact, "", 0), (None, prose(100), "", 0), (None, passage, None, 0)]
    rows += [(k, f"{prose(90)} {passage} {prose(50)}", "", 0) for k in range(10, 30)]
    rows += [(k, f"{prose(k)}\t{short}\n{prose(40)}", "", 0) for k in range(40, 46)]
    near = exact.split()
    for k in range(50, 58):
        changed = list(near)
        for j in draw.integers(0, 400, 6):
            changed[j] = f"n{j}-{k}"
        rows.append((k, " ".join(changed), "", 0))
    rows += [(60, "a " * 35, "", 0), (61, "b " * 36, "", 0), (62, f"{prose(20)} {'a ' * 90}{prose(20)}", "", 0), (63, "c d " * 60, "", 0), (64, f"x {'d c ' * 30}", "", 0), (65, prose(20) + " e f g" * 30, "", 0)]
    rows += [(70, prose(5000, 2), "", 0), (71, prose(3000, 3), "", 0), (72, "É " + passage, "", 0)]
    return rows


@pytest.mark.parametrize(("window", "size", "segment"), [(35, 6 << 20, 1 << 20), (35, 900, 100), (12, 6 << 20, 1 << 20), (2, 3000, 57)])
def test_removal(spark, window, size, segment):
    """In one chunk and in many, texts whole and in segments, with other windows; nulls, repeats, runs, periods, two and three words only."""
    rows = sample()
    got = [tuple(r) for r in without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window, size, segment).collect()]
    want = plain(rows, window)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 2000


def test_words_are_compared_unchanged(spark):
    """Sequences that differ in case alone aren't repeats; those of the same case are."""
    words = [f"Word{k}" for k in range(40)]
    rows = [(1, " ".join(words), "", 0), (2, " ".join(words).lower(), "", 0), (3, " ".join(words).upper(), "", 0), (4, "x " + " ".join(words[:39]), "", 0), (5, " ".join(words[1:]).replace("Word20", "word20"), "", 0)]
    got = {tuple(r) for r in without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(plain(rows, 35))
    assert {r[0]: r[2] for r in got} == {1: 39, 2: 0, 3: 0, 4: 39, 5: 0}


def test_an_empty_table_and_one_row(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert without_repeats(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA).where("doc_id = 1")).first()["n_removed"] == 0


def test_equal_windows_have_equal_anchors_at_equal_places():
    draw = np.random.default_rng(8)
    for letters in (1, 2, 5, 1000):
        inner = draw.integers(0, letters, 80)
        seen = {}
        for _ in range(30):
            x = np.concatenate([draw.integers(0, letters, int(draw.integers(0, 50))), inner, draw.integers(0, letters, int(draw.integers(0, 50)))])
            words = mixed(x.astype(np.uint64) + np.uint64(1))
            starts = np.arange(len(x) - 34)
            names, places = anchors(words, np.zeros(len(x), np.int32), starts, 35)
            for s in starts.tolist():
                assert seen.setdefault(tuple(x[s : s + 35].tolist()), (names[s], places[s] - s)) == (names[s], places[s] - s)


def test_anchors_are_few():
    x = np.random.default_rng(4).integers(0, 5000, 20_000)
    names, places = anchors(mixed(x.astype(np.uint64)), np.zeros(len(x), np.int32), np.arange(len(x) - 34), 35)
    assert np.count_nonzero(np.diff(places)) < len(x) / 7
    assert Counter(names.tolist()).most_common(1)[0][1] <= 35
