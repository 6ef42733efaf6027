"""Removal of word sequences that repeat anywhere, found by recompression.

Texts are compressed round by round: a run of equal symbols becomes a symbol, then symbols are parted in two kinds and each pair
of neighbours of the first and second kind becomes a symbol. A symbol's name and kind are hashes of what it stands for, so one round names
runs and pairs alike in all texts, on all machines. What a round does inside a sequence depends on that sequence alone, but for
a symbol or two at each end, which are left out. So equal windows of words keep equal symbols inside, at equal places.

A window is known by one symbol of the highest round that leaves three: the triple with the smallest hash among them. Neighbouring
windows mostly share it, so there is about a row for ten words. Triples that occur more than once, anywhere, reveal
windows that may repeat; only those are then compared by hashes of their 35 words. No window is lost: equal ones have equal
triples. What is frequent does not pile up: a task counts a chunk of text first and sends a sequence once, whatever its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.members import marked
from gneiss.llm.shared import hash_powers, hashed_words, mixed, pieces, table, text_bytes, written

WINDOW = 35
ROUNDS = ("runs", "pairs", "pairs", "runs", "pairs", "pairs")
WIDEST = 12  # words of a pair's symbol, at most, so that windows hold several
CHUNK = 5 << 19  # bytes of text that are counted together
SEGMENT = 1 << 20  # windows of a text that are looked at together
_U = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, size=8, dtype=np.uint64) * _U(2) + _U(1)
_ROWS = "key long, tail long, doc_id long, mark long, many int, n int"  # tail: 31 more bits of the key, and the first window
_PLACE = _U(24)


class _Symbols:
    """Names of a round's symbols and the words they start at; for each window the symbols inside that depend on nothing else."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.names, self.starts, self.owner, self.low, self.high = names, starts, owner, low, high

    def _joined(self, heads: np.ndarray, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> _Symbols:
        at = np.flatnonzero(heads)
        return _Symbols(names, self.starts[at], self.owner[at], low, np.maximum(low, high))

    def runs(self, words: int) -> _Symbols:
        """Runs of equal names get names; the first and last run of a window may go on outside."""
        x = self.names
        heads = np.ones(len(x), bool)
        heads[1:] = (x[1:] != x[:-1]) | (self.owner[1:] != self.owner[:-1])
        at = np.flatnonzero(heads)
        size = np.diff(at, append=len(x)).astype(np.uint64)
        names = np.where(size > 1, mixed(x[at] * _SEEDS[0] + size * _SEEDS[1]), x[at])
        which = (np.cumsum(heads) - 1).astype(np.int32)
        empty = self.high <= self.low
        low, high = which[np.minimum(self.low, len(x) - 1)] + 1, which[np.maximum(self.high - 1, 0)]
        return self._joined(heads, names, low, np.where(empty, low, high))

    def pairs(self, words: int) -> _Symbols:
        """Pairs of a first and a second kind get names; an end of a window that may pair with what lies outside is left out."""
        x = self.names
        kind = (mixed(x * _SEEDS[2]) & _U(1)).astype(bool)
        wide = np.diff(self.starts, append=words)
        first = np.zeros(len(x), bool)
        first[:-1] = ~kind[:-1] & kind[1:] & (self.owner[1:] == self.owner[:-1]) & (wide[:-1] + wide[1:] <= WIDEST)
        heads = np.ones(len(x), bool)
        heads[1:] = ~first[:-1]
        at = np.flatnonzero(heads)
        names = np.where(first[at], mixed(x[at] * _SEEDS[3] + x[np.minimum(at + 1, len(x) - 1)] * _SEEDS[4]), x[at])
        which = (np.cumsum(heads) - 1).astype(np.int32)
        low = self.low + kind[np.minimum(self.low, len(x) - 1)]
        high = self.high - ~kind[np.maximum(self.high - 1, 0)]
        empty = high <= low
        low, high = which[np.minimum(low, len(x) - 1)], which[np.maximum(high - 1, 0)] + 1
        return self._joined(heads, names, low, np.where(empty, low, high))


def _least(values: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of ``values[low : low + size]`` for each row, ``size >= 1``."""
    tables = [values]
    while (2 << (len(tables) - 1)) <= size.max(initial=1):
        before, step = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(before[:-step], before[step:]))
    out = np.empty(len(low), values.dtype)
    power = np.floor(np.log2(size)).astype(np.int64)
    for k, own in enumerate(tables):
        rows = np.flatnonzero(power == k)
        out[rows] = np.minimum(own[low[rows]], own[low[rows] + size[rows] - (1 << k)])
    return out


def anchors(words: np.ndarray, owner: np.ndarray, starts: np.ndarray, window: int, rounds: tuple[str, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For windows that start at ``starts`` of ``words`` (hashes, of texts ``owner``): a name and the word where it was found. Equal windows get equal names at equal places."""
    n = len(words)
    at = _Symbols(words, np.arange(n, dtype=np.int32), owner, starts.astype(np.int32), (starts + window).astype(np.int32))
    levels = [at]
    for r in rounds:
        at = getattr(at, r)(n)
        levels.append(at)
    names, places = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for level in range(len(levels) - 1, -1, -1):
        at = levels.pop()
        width = min(3, window)
        rows = open_[at.high[open_] - at.low[open_] >= width]
        if not len(rows):
            continue
        x = at.names
        triple = x[: len(x) - width + 1] * _SEEDS[5]
        for k in range(1, width):
            triple = (triple ^ (triple >> _U(31))) * _SEEDS[6] + x[k : len(x) - width + 1 + k]
        triple = mixed(triple + _U(level) * _SEEDS[7])
        ordered = ((triple >> _PLACE) << _PLACE) | np.arange(len(triple), dtype=np.uint64)
        best = (_least(ordered, at.low[rows], at.high[rows] - at.low[rows] - width + 1) & _U((1 << 24) - 1)).astype(np.int64)
        names[rows], places[rows] = triple[best], at.starts[best]
        open_ = np.setdiff1d(open_, rows, assume_unique=True)
        if not len(open_):
            break
    return names, places


def _chunks(batches: Iterator[pa.RecordBatch], window: int, size: int, segment: int) -> Iterator[tuple]:
    """Words of texts of about ``size`` bytes, the segment of each word, and each segment's text (``doc_id``, ``mark``, row), first word and place of its first word here.

    A long text is in several segments, which share what a window reaches over.
    """
    held: list[tuple] = []
    total = 0

    def told() -> tuple:
        words, docs, marks, rows, firsts = zip(*held, strict=True)
        held.clear()
        sizes = np.array([len(w) for w in words])
        places = np.cumsum(sizes) - sizes
        return np.concatenate(words), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(docs), np.array(marks), rows, np.array(firsts), places

    for piece in pieces(batches, "text"):
        raw, offsets = text_bytes(piece.column("text"))
        words, at = hashed_words(raw, offsets, fold=False)
        docs, marks = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
        found = piece.column("found") if "found" in piece.schema.names else None
        for k in np.flatnonzero(np.diff(at) >= window).tolist():
            n, listed = at[k + 1] - at[k], found[k].as_py() if found is not None else None
            for s in range(0, n - window + 1, segment):
                held.append((words[at[k] + s : min(at[k + 1], at[k] + s + segment + window - 1)], docs[k], marks[k], listed, s))
                total += len(held[-1][0])
                if total * 6 >= size:
                    yield told()
                    total = 0
    if held:
        yield told()


def _sent(key: np.ndarray, more: np.ndarray, place: np.ndarray, doc: np.ndarray, mark: np.ndarray, first: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """Rows that ask for the number of a key, and rows of keys that this chunk holds at several places: those need no answer, so
    they carry a key of their own, and one row tells others of the key."""
    order = np.lexsort((place, more, key))
    k, m, p = key[order], more[order], place[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    heads = np.flatnonzero(~same)
    again = same.copy()
    again[1:] &= p[1:] == p[:-1]
    group = np.cumsum(~same) - 1
    places = np.add.reduceat((~again).astype(np.int64), heads) if len(heads) else heads
    known = places[group] > 1
    doc, mark, first, many = (c[order] for c in (doc, mark, first, many))
    asks, shared = np.flatnonzero(~known), np.flatnonzero(known)
    asks = asks[np.argsort(order[asks])]  # in the order of the texts, so that rows of a text pack well
    told = heads[places > 1]
    # Neighbouring windows of a text that need no answer are one row.
    shared = shared[np.lexsort((first[shared], mark[shared], doc[shared]))]
    d, r, f, c = doc[shared], mark[shared], first[shared], many[shared]
    opens = np.ones(len(shared), bool)
    opens[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (f[1:] != f[:-1] + c[:-1])
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], len(f)) - 1
    tail = lambda more, first: (more.astype(np.int64) << 32) | first
    nought = np.zeros(len(told), np.int64)
    cols = [
        np.concatenate([k[asks], mixed(d[at].astype(np.uint64) * _SEEDS[0] + f[at].astype(np.uint64) * _SEEDS[1] + r[at].astype(np.uint64)), k[told]]).view(np.int64),
        np.concatenate([tail(m[asks], first[asks]), f[at], tail(m[told], nought)]),
        np.concatenate([doc[asks], d[at], nought]),
        np.concatenate([mark[asks], r[at], nought]),
        np.concatenate([many[asks], f[ends] + c[ends] - f[at] if len(at) else f, nought]).astype(np.int32),
        np.concatenate([~again[asks], np.full(len(at), 2), np.full(len(told), 2)]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "tail", "doc_id", "mark", "many", "n"])


def _revealing(window: int, size: int, segment: int):
    """A row for each stretch of windows that are known by one symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, owner, docs, marks, _, firsts, places in _chunks(batches, window, size, segment):
            ok = np.ones(len(words), bool)
            ok[-(window - 1) :] = False
            ok[: -(window - 1)] &= owner[: -(window - 1)] == owner[window - 1 :]
            starts = np.flatnonzero(ok)
            names, found = anchors(words, owner, starts, window)
            own = owner[starts]
            opens = np.ones(len(starts), bool)
            opens[1:] = (found[1:] != found[:-1]) | (names[1:] != names[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(opens)
            many = np.diff(at, append=len(starts))
            s = own[at]
            yield _sent(names[at], np.zeros(len(at), np.int32), found[at], docs[s], marks[s], starts[at] - places[s] + firsts[s], many)

    return run


def _comparing(window: int, size: int, segment: int):
    """A row for each window of the stretches ``found``, with 96 bits of hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, docs, marks, found, firsts, places in _chunks(batches, window, size, segment):
            power, inverse = hash_powers(len(words) + 1)
            asked, owner = [], []
            for k, stretches in enumerate(found):
                here = (firsts[k], firsts[k] + segment)
                spans = np.array([(s["first"], s["many"]) for s in stretches], np.int64)
                rows = np.repeat(spans[:, 0], spans[:, 1]) + np.arange(spans[:, 1].sum()) - np.repeat(np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1])
                rows = np.unique(rows[(rows >= here[0]) & (rows < here[1])])
                asked.append(rows - firsts[k] + places[k])
                owner.append(np.full(len(rows), k))
            at, s = np.concatenate(asked), np.concatenate(owner)
            hashes = []
            for values in (words, mixed(words ^ _SEEDS[3])):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(words)], dtype=np.uint64)])
                hashes.append(mixed((sums[at + window] - sums[at]) * inverse[at]))
            yield _sent(hashes[0], (hashes[1] >> _U(33)).astype(np.int32), at, docs[s], marks[s], at - places[s] + firsts[s], np.ones(len(at), np.int64))

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """``doc_id, mark, found``: for each text its stretches of windows whose key occurs more than once."""
    total = F.sum("n").over(Window.partitionBy("key", F.shiftright("tail", 32)))
    kept = rows.withColumn("total", total).where("total > 1 and many > 0").withColumn("first", F.col("tail").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    return kept.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "many")).alias("found"))


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            out = []
            for doc_id, text, found in zip(piece.column("given"), piece.column("text"), piece.column("found"), strict=True):
                words, found, gone = (text.as_py() or "").encode().split(), found.as_py(), 0
                n = len(words)
                if found:
                    inside = np.zeros(n + 1, np.int64)
                    spans = np.array([(s["first"], s["many"]) for s in found], np.int64)
                    np.add.at(inside, spans[:, 0], 1)
                    np.add.at(inside, spans[:, 0] + spans[:, 1] + window - 1, -1)
                    stay = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
                    words, gone = [words[i] for i in stay.tolist()], n - len(stay)
                out.append((doc_id.as_py(), n, gone, sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, size: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``: words of windows whose words start anywhere else too are removed.

    A null text has no words; a text of fewer than ``window`` words keeps all. Rows that repeat a doc_id are texts of their own,
    equal rows repeat each other, and a null doc_id is a document like any other. Windows are compared by 64-bit hashes of
    words and 96-bit hashes of windows. Other columns are ignored; an empty table gives no rows.
    """
    mark = F.xxhash64("text", F.col("doc_id").isNull())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select(F.col("doc_id").alias("given"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), mark.alias("mark"), "text")
    revealed = written(_shared(texts.select("doc_id", "mark", "text").mapInArrow(_revealing(window, size, segment), _ROWS)), "revealed")
    may = marked(texts, revealed.select("doc_id")).where("_may").select("doc_id", "mark", "text").join(revealed, ["doc_id", "mark"])
    repeated = written(_shared(may.mapInArrow(_comparing(window, size, segment), _ROWS)), "repeated")
    rows = marked(texts, repeated.select("doc_id"))
    none = F.lit(None).cast("array<struct<first:int,many:int>>").alias("found")
    others = rows.where("not _may").select("given", "text", none)
    met = rows.where("_may").join(repeated, ["doc_id", "mark"], "left").select("given", "text", "found")
    return met.unionByName(others).mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
