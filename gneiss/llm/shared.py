"""Folders, packing and text hashing that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gneiss.plans.store import shared_folder, written

__all__ = ["hash_powers", "hashed_spans", "hashed_words", "mixed", "pieces", "shared_folder", "shingles", "spans", "table", "text_bytes", "written"]
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut where ``column`` (text) reaches about ``size`` bytes; a longer text is a piece of its own. What a batch took goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_LOWER = _BYTES[_FOLDED]
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 20:  # a longer text's are made anew each time, so that a worker doesn't keep them
            _powers[base] = have
    return have


_INVERSE = pow(_BASE, -1, 1 << 64)


def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base of rolling sums, and of its inverse."""
    return _powers_of(_BASE, n), _powers_of(_INVERSE, n)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the ``len + 1`` offsets of the texts."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds; a run doesn't reach over the end of a text."""
    n = len(inside)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    opens[heads] |= inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] |= inside[tails]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hashed_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z lower-cased; as they are without ``fold``."""
    n = len(raw)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if fold else _BYTES)[raw] * _powers_of(_BASE, n)[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers_of(_INVERSE, n)[starts])


def hashed_words(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased (without ``fold`` as they are), and offsets of the texts' words."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = spans(~_SPACE[raw], offsets)
    return hashed_spans(raw, starts, ends, fold), np.searchsorted(starts, offsets)


_PLACE = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words (fewer words: the whole sequence as one), and their offsets; repeats stay."""
    counts = np.diff(offsets)
    sizes = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
    into = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(into[-1], np.uint64)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1] * _PLACE[0]
        for k in range(1, width):
            rolled += words[k : len(words) - width + 1 + k] * _PLACE[k]
        full = counts >= width
        if full.any():
            take = np.repeat(offsets[:-1][full] - np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), sizes[full]) + np.arange(sizes[full].sum())
            put = np.repeat(into[:-1][full] - np.concatenate([[0], np.cumsum(sizes[full])[:-1]]), sizes[full]) + np.arange(sizes[full].sum())
            out[put] = rolled[take]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[offsets[i] : offsets[i + 1]]
        out[into[i]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + _U(len(own))
    return mixed(out), into
