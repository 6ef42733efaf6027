"""The manifest against trees that are built level by level in memory."""

import zlib
from hashlib import sha256

from gneiss.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, way string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def climbed(leaves):
    """The digest that remains, and each leaf's siblings (before, after) from below."""
    paths, under, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(now) > 1:
        runs = [now[k : k + 8] for k in range(0, len(now), 8)]
        for k, run in enumerate(runs):
            for j in range(len(run)):
                for i in under[8 * k + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
        under = [sum(under[8 * k : 8 * k + 8], []) for k in range(len(runs))]
        now = [h(run) for run in runs]
    return now[0], paths


def plain(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    of = {}
    for d, source, lang, n, text in rows:
        leaf = h(field(x) for x in (d, source, lang, n, text))
        touched = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        of.setdefault(lang, []).append((d, leaf, h(field(x) for x in (d, source, lang, n, low(text))) if touched else leaf))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        of[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [climbed([x[1] for x in of[lang]]) for lang in langs]
    root, above = climbed([t[0] for t in trees])
    out = []
    for lang, (subroot, paths), more in zip(langs, trees, above, strict=True):
        for (d, leaf, now), path in zip(of[lang], paths, strict=True):
            for before, after in path + more:
                now = h([*before, now, *after])
            out.append((d, leaf, subroot, root, h(x for b, a in path + more for x in b + a), now, now == root))
    return out


def check(spark, rows):
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(plain([r[:5] for r in rows]), key=str)


def test_manifest_of_many_languages_and_of_one_with_several_sweeps(spark):
    """Null in every column, rows that repeat, runs of one, a tree of more than 512 leaves and more than 8 languages."""
    rows = [(None, None, None, None, None, 1, "")] * 3 + [(5, "x", "en", 1, "A", 2, "q")] * 2 + [(7, "x", "en", 1, "a", 0, ""), (7, "x", "en", 1, "B", 0, "")]
    rows += [(i, "s", f"l{i % 20}" if i % 3 else "de", i, f"Text {i} É", 0, "z") for i in range(1700)]
    rows += [(i, "", "de", None, "", 0, None) for i in range(3000, 3200)]
    check(spark, rows)


def test_manifest_at_the_edges(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, "a", "en", 3, "ABC", 1, "")])
    check(spark, [(i, "a", "en", 3, "X" * 400_000, 1, "") for i in range(9)])
    check(spark, [(i, "a", None, 3, None, 1, "") for i in range(513)])
