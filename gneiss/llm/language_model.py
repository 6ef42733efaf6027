"""Stupid-backoff scores of documents under bigrams counted over the whole corpus.

Every document is scored by what the other documents say: its own occurrences are taken off each count, so a text isn't
its own evidence. A bigram that occurs elsewhere scores its count over its context's count; any other backs off to
``BACKOFF`` times the share of its second word. Begin and end of a document are words of their own.

The work is joins and sums of n-gram rows. Words are counted first, in a table dealt by their hash. Then each document is
exploded to a row for each of its different bigrams, dealt by the bigram's hash, where its count is the sum over equal
rows. A row then needs one word's count: its context's if the bigram occurs elsewhere, or else its second word's. For the
``FREQUENT`` commonest words that count comes from a broadcast table of that size, for others from an equi-join with the
word counts. Scores are summed by document.

No group is large: bigrams that are common in a sample of documents are counted exactly with the words, at most
``COMMON`` of them, and scored where they are found, so that what is dealt by hash is rare. Which bigrams go that way
changes where they are scored, not how.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import hashed_words, mixed, pieces, table, text_bytes, written

BACKOFF, FLOOR = 0.4, 0.5
FREQUENT, COMMON, SAMPLE = 1 << 18, 1 << 18, 8192  # words and bigrams whose counts every task gets; documents that name the bigrams
CHUNK, AT_ONCE = 8 << 20, 1 << 17  # bytes of text whose bigrams are sorted together; rows sent at once
BEGIN, END = np.uint64(0x1357_9BDF_0246_8ACE), np.uint64(0x0F1E_2D3C_4B5A_6978)
_U = np.uint64
_ROWS = "first long, second long, row long, n int, own long, doc_id long, known double"


def _sequences(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's words between a begin and an end, and the place in ``counts`` that each belongs to."""
    ends = np.cumsum(counts + 2)
    seq = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    inner = np.ones(len(seq), bool)
    inner[ends - 1] = inner[ends - counts - 2] = False
    seq[inner] = words
    seq[ends - 1], seq[ends - counts - 2] = END, BEGIN
    return seq, np.repeat(np.arange(len(counts)), counts + 2)


def _bigram(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _U(0x9E3779B97F4A7C15) + second)


class _Known:
    """Hashes in order; most others are told from them by a few of their bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.may = keys, np.zeros(1 << 22, bool)
        self.may[keys >> _U(42)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of ``x``; the number of hashes where it isn't one."""
        out = np.full(len(x), len(self.keys))
        may = np.flatnonzero(self.may[x >> _U(42)])
        at = np.searchsorted(self.keys, x[may])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == x[may] if len(self.keys) else np.zeros(0, bool)
        out[may[hit]] = at[hit]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, numbers of words and words of documents that together have about ``size`` bytes."""
    ids, counts, words, held = [], [], [], 0
    for piece in pieces(batches, "text"):
        raw, offsets = text_bytes(piece.column("text"))
        w, at = hashed_words(raw, offsets)
        ids.append(piece.column("doc_id").to_numpy(zero_copy_only=False))
        counts.append(np.diff(at))
        words.append(w)
        held += len(raw)
        if held >= size:
            yield np.concatenate(ids), np.concatenate(counts), np.concatenate(words)
            ids, counts, words, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(counts), np.concatenate(words)


def _bigrams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's different bigrams, as hashes."""
    for _, counts, words in _chunks(batches, CHUNK):
        seq, owner = _sequences(counts, words)
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        keys = _bigram(seq[pairs], seq[pairs + 1])
        order = np.lexsort((keys, owner[pairs]))
        keys, of = keys[order], owner[pairs][order]
        keys = keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])]
        for i in range(0, len(keys), AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + AT_ONCE].view(np.int64))], ["key"])


def _counted(keys: np.ndarray):
    """``kind, key, n``: how often a chunk has each word (kind 0), and each of the common bigrams (kind 1)."""
    common = _Known(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, counts, words in _chunks(batches, CHUNK):
            seq, owner = _sequences(counts, words)
            pairs = np.flatnonzero(owner[1:] == owner[:-1])
            at = common.find(_bigram(seq[pairs], seq[pairs + 1]))
            times = np.bincount(at, minlength=len(common) + 1)[: len(common)]
            for kind, (found, n) in enumerate((np.unique(seq, return_counts=True), (common.keys[times > 0], times[times > 0]))):
                for i in range(0, len(found), AT_ONCE):
                    k = found[i : i + AT_ONCE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[i : i + AT_ONCE].astype(np.int64))], ["kind", "key", "n"])

    return run


def _exploded(words: np.ndarray, word_counts: np.ndarray, bigrams: np.ndarray, bigram_counts: np.ndarray):
    """A row for each document with what its common bigrams score, and one for each of its other bigrams.

    A frequent word is named by its rank, any other by its hash. ``own`` holds how often the document itself has the two
    words: in a byte each, the second one's higher, or negative in 31 bits each.
    """
    frequent, common = _Known(words), _Known(bigrams)
    rank = np.empty(len(words), np.uint64)
    rank[np.argsort(-word_counts, kind="stable")] = np.arange(len(words))

    def rows(start: int, ids: np.ndarray, counts: np.ndarray, found: np.ndarray) -> list[np.ndarray]:
        seq, owner = _sequences(counts, found)
        known, of = np.unique(seq, return_inverse=True)
        place = frequent.find(known)
        names = np.where(place < len(frequent), np.append(rank, _U(0))[place], known | _U(FREQUENT))
        by = np.argsort(names)
        known, place, names = known[by], place[by], names[by]
        of = np.argsort(by)[of]
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        key = of[pairs] * len(known) + of[pairs + 1]
        order = np.argsort(key, kind="stable")  # by first and second word, so that equal words lie together
        key, doc = key[order], owner[pairs][order]
        lead = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(lead, len(key)))
        key, doc = key[lead], doc[lead]
        first, second = key // len(known), key % len(known)
        mine, own = np.unique(of * len(counts) + owner, return_counts=True)
        own_first, own_second = (own[np.searchsorted(mine, w * len(counts) + doc)] for w in (first, second))
        there = np.append(bigram_counts, 0)[common.find(_bigram(known[first], known[second]))] - n
        context = place[first]
        scored = (there > 0) & (context < len(frequent))
        rest = np.append(word_counts, 1)[context] - own_first
        score = np.bincount(doc[scored], n[scored] * np.log(there[scored] / rest[scored]), len(counts))
        own = np.where((own_first < 256) & (own_second < 256), own_first | own_second << 8, -(own_first | own_second << 31))
        first, second, doc, n, own = (x[~scored] for x in (names[first], names[second], doc, n, own))
        heads = np.arange(len(counts)) + start  # a document's own row is dealt by its number; no word is named 2 * FREQUENT
        none = np.zeros(len(doc))
        columns = [(mixed(heads.astype(np.uint64)), first), (np.full(len(heads), 2 * FREQUENT), second), (heads, doc + start), (counts, n), (np.zeros(len(heads)), own), (ids, none), (score, none)]
        return [np.concatenate([a.astype(t), b.astype(t)]) for (a, b), t in zip(columns, (np.uint64, np.uint64, np.int64, np.int32, np.int64, np.int64, np.float64), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        start = (task.partitionId() if task else 0) << 33
        for ids, counts, found in _chunks(batches, CHUNK):
            out = rows(start, ids, counts, found)
            heads = np.zeros(len(out[0]), bool)
            heads[: len(counts)] = True
            start += len(counts)
            for i in range(0, len(heads), AT_ONCE):
                part = [x[i : i + AT_ONCE] for x in out]
                arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in part[:5]]
                arrays += [pa.array(x, mask=~heads[i : i + AT_ONCE]) for x in part[5:]]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _ROWS.split(", ")])

    return run


def language_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_score`` for each row of ``docs(doc_id, text, ...)``; other columns are ignored.

    ``log_score`` sums natural logarithms over the words and the end; ``mean_score`` divides it by their number. A null
    or empty text has the score of an empty document. Rows that repeat a doc_id are documents of their own; rows with
    a null doc_id are left out. No rows give none.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    step = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    common = some.mapInArrow(_bigrams_of, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    common = np.sort(common.column("key").to_numpy().view(np.uint64))
    counts = written(texts.mapInArrow(_counted(common), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    total = counts.where(F.col("kind") == 0).where(F.col("key") != int(BEGIN.view(np.int64))).agg(F.sum("n")).first()[0] or 1

    ordered = lambda t: (lambda keys, n: (keys[o := np.argsort(keys)], n[o]))(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy())
    words = ordered(counts.where("kind = 0").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n").toArrow())
    rows = texts.mapInArrow(_exploded(*words, *ordered(counts.where("kind = 1").select("key", "n").toArrow())), _ROWS)
    # No more than FREQUENT rows, so they may be broadcast.
    frequent = docs.sparkSession.createDataFrame(pa.table({"word": np.arange(len(words[0])), "count": -np.sort(-words[1])}).to_pandas(), "word long, count long")
    others = counts.where("kind = 0").select(F.col("key").bitwiseOR(F.lit(FREQUENT)).alias("word"), F.col("n").alias("count"))

    rest = F.sum("n").over(Window.partitionBy("first", "second")) - F.col("n")
    met = rows.withColumn("rest", F.when(F.col("known").isNull(), rest)).withColumn("seen", F.col("rest") > 0)
    half = lambda c, bits: F.when(F.col("seen"), c.bitwiseAND(F.lit((1 << bits) - 1))).otherwise(F.shiftright(c, bits))
    own = F.when(F.col("own") < 0, half(-F.col("own"), 31)).otherwise(half(F.col("own"), 8))
    met = met.select("row", "doc_id", "known", "n", "rest", own.alias("own"), F.when(F.col("seen"), F.col("first")).when(~F.col("seen"), F.col("second")).alias("word"))
    met = met.join(F.broadcast(frequent), "word", "left")
    left = F.col("count") - F.col("own")
    score = F.col("n") * F.when(F.col("rest") > 0, F.log("rest") - F.log(left)).otherwise(F.log(BACKOFF * F.greatest(left, F.lit(FLOOR)) / F.lit(float(total))))
    tokens = F.when(F.col("known").isNotNull(), F.col("n")).otherwise(0).cast("long")
    near = met.where("known is not null or count is not null").select("row", "doc_id", tokens.alias("tokens"), F.coalesce("known", score).alias("score"))
    rare = met.where("known is null and count is null").drop("count").join(others, "word").select("row", "doc_id", F.lit(0).cast("long").alias("tokens"), score.alias("score"))
    out = near.union(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"), F.sum("score").alias("log_score"))
    return out.select("doc_id", "n_tokens", "log_score", (F.col("log_score") / (F.col("n_tokens") + 1)).alias("mean_score"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
