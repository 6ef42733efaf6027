import itertools
import random
import re

from gneiss.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string"


def shingle_set(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {d: (len(s), top(d), top(d) == d) for d, s in sets}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([60, 120, 200]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy), "clash"))
            n += 1
    for text in (None, "", "  \t", "one two", "One  two", "one two three", rows[0][1].upper(), rows[0][1], "long " * 30000):
        rows.append((n, text, "clash"))
        n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_small_blocks_give_the_same_groups(spark, monkeypatch):
    """Blocks cut by what they hold, and by few members, still compare every pair that shares a bucket."""
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for n in range(70):
        copy = list(base if n % 3 else base[:45])
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(base)
        rows.append((n, " ".join(copy), ""))
    want = brute(rows)
    for block, fill in ((128, 150), (3, 1 << 21)):
        monkeypatch.setattr("gneiss.llm.minhash.BLOCK", block)
        monkeypatch.setattr("gneiss.llm.minhash.FILL", fill)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want


def test_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    got = near_duplicates(spark.createDataFrame([(None, text, ""), (5, text, ""), (5, text, ""), (7, text, "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
