"""Quality scores from histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver to the binned statistics of at most ``sample`` labelled rows, chosen by a hash of
the doc_id; this is the one bound. Their nodes are flattened into arrays, and every document is scored in its partition
by a numpy traversal over all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import hashed_spans, pieces, spans, table, text_bytes

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 4, 0.15, 64, 20, 1.0
THRESHOLD = 0.7

NAMES = "chars words word_length space capital digit mark symbol bar bang accent lines line_length distinct repeats commonest line_ends distinct_pairs sentence long_words".split()


def _class(codes: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in codes]] = True
    return out


_SPACES = _class(" \t\n\x0b\x0c\r")
_CLASSES = np.stack([_SPACES, _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:'\"()-?"), _class("%$&*#@^~<>{}[]=+_\\/"), _class("|"), _class("!"), np.arange(256) >= 128, _class("\n"), _class(".?!")])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of numbers (``NAMES``) for each text; all nought for one without words."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    heads = offsets[:-1][full]
    shares = np.stack([np.add.reduceat(mask[raw], heads, dtype=np.int64) for mask in _CLASSES], axis=1)
    starts, ends = spans(~_SPACES[raw], offsets)
    at = np.searchsorted(starts, offsets)
    words = hashed_spans(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lengths = ends - starts
    long = np.concatenate([[0], np.cumsum(lengths > 14)])
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], words[1:] == words[:-1]]))]) if len(words) else np.zeros(1, int)
    pairs = words[:-1] * np.uint64(31) + words[1:] if len(words) > 1 else words[:0]
    for row, i in enumerate(full):
        a, b = at[i], at[i + 1]
        n, size, s = b - a, sizes[i], shares[row]
        if not n:
            continue
        own, times = np.unique(words[a:b], return_counts=True)
        bigrams = len(np.unique(pairs[a : b - 1])) / (n - 1) if n > 1 else 1.0
        lines = s[8] + 1
        repeats = (same[b] - same[a + 1]) / n
        out[i] = (np.log1p(size), np.log1p(n), lengths[a:b].mean(), s[0] / size, s[1] / size, s[2] / size, s[3] / n, s[4] / n, s[5] / n, s[6] / n, s[7] / size, lines / n, np.log1p(size / lines), len(own) / n, repeats, times.max() / n, s[8] / size, bigrams, s[9] / n, (long[b] - long[a]) / n)
    return out


@dataclass
class Forest:
    """Nodes of all trees end to end: a leaf points to itself, so each step of a traversal is one gather."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Level-wise trees for the logistic loss. Without rows every score is 1: nothing is known to be bad."""
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 1.0
    base = float(np.log(share / (1 - share))) if len(y) else 50.0
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(nodes))
            nodes.append([0, 0.0, 0, 0, 0.0])
            level = [(len(nodes) - 1, np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for node, rows in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, -1, 0)
                    if d < depth and len(rows) >= 2 * LEAST_ROWS:
                        for j in range(x.shape[1]):
                            b, m = binned[rows, j], len(cuts[j]) + 1
                            gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                            ok = (nl >= LEAST_ROWS) & (len(rows) - nl >= LEAST_ROWS)
                            gain = np.where(ok, gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE), 0.0)
                            if len(gain) and gain.max() > best[0]:
                                best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] < 0:
                        value = -rate * gs / (hs + RIDGE)
                        nodes[node] = [0, 0.0, node, node, value]
                        f[rows] += value
                        continue
                    _, j, k = best
                    go = binned[rows, j] <= k
                    nodes[node] = [j, float(cuts[j][k]), len(nodes), len(nodes) + 1, 0.0]
                    below += [(len(nodes), rows[go]), (len(nodes) + 1, rows[~go])]
                    nodes.extend([[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]])
                level = below
    flat = np.array(nodes).reshape(-1, 5)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), base, depth + 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        x = statistics(piece.column("text"))
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([lists, piece.column("quality")], ["x", "quality"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees for ``labels(doc_id, quality)``, fitted to at most ``sample`` labelled documents that aren't held out, the first by a hash.

    A doc_id that several rows of ``docs`` bear stands for the one whose text comes first by its hash, so rows that repeat change nothing.
    A label that repeats counts once, one that contradicts itself twice; null labels and ids are left out.
    """
    chosen = labels.where(~held_out(F.col("doc_id"))).where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    chosen = chosen.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # At most `sample` rows of 16 bytes, so a broadcast is bounded.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # ``sample`` rows at most
    found = rows.select("text", "quality").mapInArrow(_counted, "x array<double>, quality double").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = pa.concat_arrays([c.flatten() for c in found.column("x").chunks]).to_numpy().reshape(-1, len(NAMES))
    y = found.column("quality").to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees, however Spark orders the rows
    return fit(x[order], y[order])


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            score = forest.score(statistics(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(piece.num_columns)), pa.array(score)], [*piece.schema.names, "score"])

    return run


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """The given columns of ``docs(text, ...)`` and ``score``, from whole texts; a column named ``score`` is replaced.

    A null or empty text has statistics of nought and the trees' score for those. Repeated rows have equal scores; no
    rows give none.
    """
    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scored(forest), f"{fields}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = learned(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
