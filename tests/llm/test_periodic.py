"""Runs and Lyndon arrays against their definitions."""

from hashlib import sha256
from zlib import crc32

import numpy as np

from gneiss.llm.periodic import lyndon_array, periodic_runs, runs


def plain_lyndon(x):
    n, out = len(x), []
    for i in range(n):
        j = i + 1
        while j < n and x[j:] > x[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(x, exponent, least):
    """Stretches that keep a period and can't be extended, by their smallest period."""
    n, found = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j + p - i >= 2 * p:
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted(((s, size, p) for (s, size), p in found.items() if size >= max(least, exponent * p)), key=lambda r: (r[0], r[2]))


def texts():
    draw = np.random.default_rng(5)
    for k in range(400):
        n, letters = int(draw.integers(0, 60)), int(draw.integers(1, 5))
        x = draw.integers(0, letters, n)
        if k % 2 and n > 4:
            a, p = int(draw.integers(0, n)), int(draw.integers(1, 6))
            x[a:] = x[a + np.arange(n - a) % p]
        yield x
    morse = np.array([bin(i).count("1") % 2 for i in range(1 << 12)])  # sums of hashes that wrap around are blind to it
    yield morse[:300]
    yield np.tile([0, 1, 0, 0, 1], 30)
    yield np.zeros(200, int)


def test_lyndon_arrays():
    for x in texts():
        assert lyndon_array(x.tolist()) == plain_lyndon(x.tolist())


def test_runs_of_every_exponent():
    for x in texts():
        for exponent, least in ((2, 2), (3, 4), (4, 6)):
            assert runs(x, exponent, least) == plain_runs(x.tolist(), exponent, least)


def test_long_texts_take_linear_time():
    """A word repeated, two copies of a word that a hash of sums can't tell from its complement, and random words around a run."""
    assert runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    morse = np.array([bin(i).count("1") % 2 for i in range(1 << 14)])
    assert all(size >= 4 * p for _, size, p in runs(np.concatenate([morse, 1 - morse] * 4)))
    assert (0, 8 << 14, 2 << 14) in runs(np.concatenate([morse, 1 - morse] * 4))
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.integers(0, 50, 100_000), np.tile(np.arange(100, 130), 9)])
    assert (100_000, 270, 30) in runs(x)


def row(doc_id, text, plant):
    words = "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    n, h = len(words), crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    got = plain_runs([numbers[w] for w in words], 4, 6)
    best = min(got, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, size, p in got for i in range(s + p, s + size)}
    ends = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in got)
    return doc_id, len(got), *ends, sha256(listed.encode()).hexdigest(), sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_query_rows(spark):
    draw = np.random.default_rng(9)
    rows = [(None, None, "x", 1), (3, "", "x", 2), (3, None, "x", 1), (4, " \t\n", "x", 1), (5, "a b " * 8 + "c", "x", 1), (5, "a b " * 8 + "c", "x", 1), (None, "z " * 9, "x", 1), (6, "é é " * 7, "x", 1)]
    rows += [(i, " ".join(f"w{k}" for k in draw.integers(0, 8, int(draw.integers(0, 90)))), "x", 0) for i in range(20, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string, start int")
    for plant in (False, True):
        got = [tuple(r) for r in periodic_runs(docs, plant=plant).collect()]
        want = [row(d, t, plant) for d, t, *_ in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sum(r[1] for r in got) > (10 if plant else 3)
    assert periodic_runs(docs.limit(0)).count() == 0
