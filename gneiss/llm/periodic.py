"""Periodic runs of words: Lyndon arrays by the grouping phase of Baier's suffix sorter, roots extended to runs.

The grouping phase takes suffixes in groups, from the greatest group down. A suffix's group is known by the Lyndon word it
starts with; the nearest earlier suffix of a lower group takes that word to the end of its own. When all groups are done, each
position has its longest Lyndon word, without suffixes being sorted. Doing it under an order of the words and under the reverse
gives every run's root at least once. A root is extended both ways while words one period apart agree: common extensions are
found by halving on prefix sums of hashes, and each run found is compared word by word.

A run of exponent e holds each of its words at least e times. So a word seen fewer times in a stretch can't lie in a run there and cuts
it; what is left of prose is a few stretches, and no run is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import hash_powers, pieces, table

EXPONENT, LEAST = 4, 6  # a run's length over its period, and its length in words, at least
PLANTED = 10  # one document in so many gets a periodic end in the query
_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_U = np.uint64
_VALUES = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, size=2, dtype=np.uint64) * _U(2) + _U(1)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position of ``ranks``; the end counts as less than any word."""
    n = len(ranks)
    members = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)
    live = [len(m) for m in members]
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    found, previous = [0] * n, [-1] * n  # found: 0 until a position's group is done
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        own.sort()
        word, follows = length[now], {}
        for i in own:
            p = i - 1
            while p >= 0 and found[p]:
                p = previous[p]
            previous[i], found[i] = p, word
            if p >= 0:
                follows[p] = follows.get(p, 0) + 1
        if follows:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, times in follows.items():
                parts.setdefault((group[p], times), []).append(p)
            # What the word follows more often is greater, and all of it is greater than the rest of its group.
            for old, times in sorted(parts, reverse=True):
                moved = parts[old, times]
                if len(moved) == live[old]:
                    length[old] += times * word
                    continue
                new = len(members)
                members.append(moved)
                live.append(len(moved))
                length.append(length[old] + times * word)
                live[old] -= len(moved)
                for p in moved:
                    group[p] = new
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
        now = below[now]
    return found


def _extended(ranks: np.ndarray, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words at ``at`` and ``period`` later: how many further ones agree, rightwards from there and leftwards before."""
    n = len(ranks)
    power, inverse = hash_powers(n + 1)
    values = (ranks.astype(np.uint64) + _U(1)) * _VALUES[0]
    values ^= values >> _U(29)
    values *= _VALUES[1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n], dtype=np.uint64)])
    part = lambda a, b: (sums[b] - sums[a]) * inverse[a]
    right, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    later = at + period
    for bit in range(max(1, n).bit_length() - 1, -1, -1):
        try_ = right + (1 << bit)
        fits = later + try_ <= n
        a, b, size = at[fits], later[fits], try_[fits]
        right[np.flatnonzero(fits)[part(a, a + size) == part(b, b + size)]] += 1 << bit
        try_ = left + (1 << bit)
        fits = at - try_ >= 0
        a, b, size = at[fits], later[fits], try_[fits]
        left[np.flatnonzero(fits)[part(a - size, a) == part(b - size, b)]] += 1 << bit
    return right, left


def _whole(ranks: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether words ``period`` apart agree from ``start`` to ``end`` and no further."""
    if not np.array_equal(ranks[start : end - period], ranks[start + period : end]):
        return False
    return (start == 0 or ranks[start - 1] != ranks[start - 1 + period]) and (end == len(ranks) or ranks[end] != ranks[end - period])


def _plainly(ranks: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The run through a root, word by word: for where two hashes agree by chance."""
    same = ranks[:-period] == ranks[period:]
    after, before = np.flatnonzero(~same[at:]), np.flatnonzero(~same[:at])
    return (before[-1] + 1 if len(before) else 0), (at + after[0] if len(after) else len(same)) + period


def _runs_of_stretch(ranks: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    n, out = len(ranks), set()
    listed = ranks.tolist()
    top = int(ranks.max())
    for order in (listed, [top - r for r in listed]):
        period = np.array(lyndon_array(order), np.int64)
        at = np.arange(n)
        later = at + period
        may = (later < n) & (ranks == ranks[np.minimum(later, n - 1)])
        may[1:] |= ranks[:-1] == ranks[later[1:] - 1]
        at, period = at[may], period[may]
        right, left = _extended(ranks, at, period)
        length = right + left + period
        kept = (length >= exponent * period) & (length >= least)
        rows = np.stack([at[kept] - left[kept], length[kept], period[kept], at[kept]], axis=1)
        first = np.unique(rows[:, :3], axis=0, return_index=True)[1]
        for start, size, p, root in rows[first].tolist():
            if not _whole(ranks, start, start + size, p):
                start, end = _plainly(ranks, root, p)
                size = end - start
            if size >= max(least, exponent * p):
                out.add((start, size, p))
    return sorted(out)


def runs(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the maximal runs of ``words`` (numbers) by start, then period, that are ``exponent >= 2`` periods and ``least`` words long."""
    at, stretch = np.arange(len(words)), np.zeros(len(words), np.int64)
    while len(at):
        key = words[at] + stretch * (int(words.max()) + 1)
        if len(at) == len(words):
            often = np.bincount(words)[words] >= exponent
        else:
            _, where, count = np.unique(key, return_inverse=True, return_counts=True)
            often = count[where] >= exponent
        at = at[often]
        stretch = np.cumsum(np.diff(at, prepend=at[:1] - 2) > 1) - 1
        size = np.bincount(stretch)
        long = size[stretch] >= least
        settled = often.all() and long.all()
        at, stretch = at[long], stretch[long]
        if settled:
            break
    out = []
    for own in np.split(at, np.flatnonzero(np.diff(stretch)) + 1) if len(at) else []:
        _, ranks = np.unique(words[own], return_inverse=True)
        out += [(int(own[0]) + s, size, p) for s, size, p in _runs_of_stretch(ranks, exponent, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(words: np.ndarray, h: int) -> np.ndarray:
    """``words`` with a periodic end, by the number ``h``."""
    g, n = h // PLANTED, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def _found(plant: bool, exponent: int, least: int):
    def of_text(doc_id: int | None, text: str | None) -> tuple:
        spelt = (text or "").encode().split()  # bytes split at \x20 and \x09 to \x0D
        names = list(dict.fromkeys(spelt))
        words = np.fromiter(map(dict(zip(names, range(len(names)), strict=True)).__getitem__, spelt), np.int64, len(spelt))
        h = crc32(str(doc_id).encode()) if doc_id is not None else 1
        if plant and h % PLANTED == 0 and len(words):
            words = _planted(words, h)
            spelt = [names[w] for w in words.tolist()]
        got = runs(words, exponent, least)
        start = length = period = milli = None
        if got:
            start, length, period = max(got, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            milli = 1000 * length // period
            inside = np.zeros(len(words) + 1, np.int64)
            for s, size, p in got:
                inside[s + p] += 1
                inside[s + size] -= 1
            spelt = [spelt[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()]
        listed = "".join(f"{s},{size},{p}\n" for s, size, p in got)
        return doc_id, len(got), start, length, period, milli, sha256(listed.encode()).hexdigest(), sha256(b" ".join(spelt)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in _OUT.split(", ")]
        for piece in pieces(batches, "text"):
            rows = [of_text(d.as_py(), t.as_py()) for d, t in zip(piece.column("doc_id"), piece.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, plant: bool = False) -> DataFrame:
    """Runs of each row of ``docs(doc_id, text)``: their number, the one of greatest exponent, and digests of all and of the text without them.

    A null or empty text has no words and no runs: four nulls, and digests of nothing. Among runs of equal exponent the first
    counts, then the shorter period. Rows that repeat a doc_id are rows of their own; other columns are ignored; a text of any
    length is taken whole, in time that grows with its length but for a logarithm. ``plant`` first gives a tenth of the texts, by the hash of their
    doc_id, a periodic end; a null doc_id gets none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(plant, exponent, least), _OUT)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
