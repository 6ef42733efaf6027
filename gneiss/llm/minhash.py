"""Near-duplicate groups: universal hash minima, banding, signature and exact verification, connected components.

Two texts are linked if the Jaccard similarity of their word-shingle sets reaches ``least`` percent. Texts with
equal sets form a class first and only one of each goes on, so exact copies cost nothing. Classes that share a band
are compared in two passes. The first compares every member of a band's bucket with one member drawn by hash; the
links found there join most of a large group of near copies. The second takes what still shares a bucket with members
of another component and compares it, in blocks of bounded size, with the component that is most frequent there and
with whatever else met that component: every pair that shares a bucket and lies in different components is compared,
and no other pair can change the result. So no bucket is capped, and a task emits fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.components import components
from gneiss.llm.members import with_ids
from gneiss.llm.shared import hashed_words, mixed, pieces, shingles, table, text_bytes, written

WIDTH, LEAST = 5, 75
BANDS, ROWS = 32, 4  # a pair at 0.75 shares no band with probability (1 - 0.75**4)**32 < 6e-6
SIGNATURE_LEAST = 0.56  # five standard deviations under 0.75 with 128 minima
BLOCK = 128
FILL = 1 << 21  # shingles that a block's members hold on average, at most, unless one member has more
DRAWS = 3  # orders in which members are drawn: more would send a text to more blocks, fewer join less of a group
_U = np.uint64
_draw = np.random.Generator(np.random.PCG64(11))
_A = _draw.integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_B = _draw.integers(0, 2**63, size=BANDS * ROWS, dtype=np.uint64)
_BAND = _draw.integers(1, 2**63, size=(BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, end to end, and their offsets."""
    every, at = shingles(*hashed_words(*text_bytes(texts)), width)
    own = [np.unique(every[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(own) if own else every, np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def _minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of minima for each text that has shingles: top halves of ``a * x + b`` modulo 2**64."""
    heads = at[:-1][np.diff(at) > 0]
    out = np.empty((len(heads), len(_A)), np.uint32)
    if len(heads):
        hashed = np.empty_like(sets)
        for k in range(len(_A)):
            np.multiply(sets, _A[k], out=hashed)
            hashed += _B[k]
            out[:, k] = np.minimum.reduceat(hashed, heads) >> _U(32)
    return out


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets, at = _sets(piece.column("text"), width)
            sizes = np.diff(at)
            full = sizes > 0
            keys = np.zeros((2, len(sizes)), np.uint64)
            if full.any():
                keys[0, full] = np.add.reduceat(mixed(sets), at[:-1][full])
                keys[1, full] = np.bitwise_xor.reduceat(mixed(sets ^ _A[0]), at[:-1][full])
            bands = mixed((_minima(sets, at).reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            sets, at = _sets(piece.column("text"), width)
            rows = iter(_minima(sets, at))
            signs = [next(rows).tobytes() if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(signs, pa.binary()), pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "signature", "shingles"])

    return run


def _links(least: int, signature_least: float):
    """Links within a block between members of different components; as many as join them, no more."""
    none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    def run(block: pa.Table) -> pa.Table:
        ids, comps, sides = (block.column(c).to_numpy() for c in ("id", "component", "side"))
        found: list[tuple[int, int]] = []
        a, b = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        if not len(a) or not len(b):  # a hash may deal no member to one side
            return none
        signs = np.stack([np.frombuffer(x, np.uint32) for x in block.column("signature").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        alike = np.stack([(signs[b] == signs[i]).sum(axis=1) for i in a])
        may = (alike >= signature_least * signs.shape[1]) & (comps[a][:, None] != comps[b][None, :])
        may &= 100 * np.minimum(sizes[a][:, None], sizes[b][None, :]) >= least * np.maximum(sizes[a][:, None], sizes[b][None, :])
        may &= (sides[a] != 2)[:, None] | (a[:, None] < b[None, :])
        root = {c: c for c in comps.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        x, y = np.nonzero(may)
        for k in np.argsort(-alike[x, y], kind="stable"):
            i, j = a[x[k]], b[y[k]]
            p, q = top(int(comps[i])), top(int(comps[j]))
            if p == q:
                continue
            short, long = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.searchsorted(long, short)
            both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
            if 100 * both >= least * (sizes[i] + sizes[j] - both):
                root[max(p, q)] = min(p, q)
                found.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _compared(blocks: DataFrame, signed: DataFrame, keys: list[str], least: int, signature_least: float) -> DataFrame:
    """Links of ``blocks(keys, side, id, component)``. Side 0 is compared with side 1; rows of side 2 among themselves."""
    return blocks.join(signed, "id").groupBy(*keys).applyInArrow(_links(least, signature_least), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: int = LEAST, signature_least: float = SIGNATURE_LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text, ...)``; other columns are ignored.

    A text without words has an empty set and is linked with nothing; null counts as such a text. Rows that repeat a
    doc_id share its component. A null doc_id is never linked: its component is null and it is kept. No rows give no
    rows. The smallest doc_id that can be reached names a component, so ties can't arise.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = written(texts.mapInArrow(_features(width), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "features")
    known = features.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "hash")).select("id", "n_shingles", F.xxhash64("band", "hash").alias("bucket"))
    drawn = F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(DRAWS))).alias("draw"), "id")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min(drawn)["id"].alias("hub"))
    buckets = buckets.where("low < high").dropDuplicates(["size", "low", "high", "mark"])  # the same members in several bands
    members = written(banded.join(buckets.select("bucket", "hub"), "bucket"), "members")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    signed = written(with_ids(texts, ids).mapInArrow(_signed(width), "id long, signature binary, shingles binary"), "signed")
    signed = signed.where("length(shingles) > 0")

    spokes = members.where("id <> hub").select("hub", "id", "n_shingles").distinct()
    parts = spokes.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / (BLOCK - 1), F.sum("n_shingles") / FILL)).alias("parts"))
    dealt = spokes.join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(1).alias("side"), "id")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("id"))
    links = written(_compared(dealt.unionByName(hubs).withColumn("component", F.col("id")), signed, ["hub", "part"], least, signature_least), "links")
    named = components(links)

    mine = F.coalesce("component", "id").alias("component")
    placed = members.join(named.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n_shingles", mine)
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = shares.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("several")).where("several > 1")
    # Whatever meets a component in any bucket is dealt to that component once, however many bands they share.
    open_ = placed.join(split, "bucket").select("main", "id", "n_shingles", "component").distinct().withColumn("is_main", F.col("component") == F.col("main"))
    of = lambda is_main, value: F.when(F.col("is_main") == is_main, value)
    many = lambda is_main: F.ceil(F.greatest(F.count(of(is_main, F.lit(1))) / BLOCK, F.coalesce(F.sum(of(is_main, F.col("n_shingles"))), F.lit(0)) / FILL))
    open_ = written(open_, "open")
    open_ = open_.join(open_.groupBy("main").agg(many(True).alias("mains"), many(False).alias("others")), "main")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    at = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
    beside = F.transform(upto(F.col("others")), lambda k: at(k, -1 - F.col("own"), 1))
    across = F.transform(upto(F.col("mains")), lambda k: at(F.col("own"), -1 - k, 0))
    among = F.transform(upto(F.col("others")), lambda k: F.struct(F.least("own", k).cast("long").alias("x"), F.greatest("own", k).cast("long").alias("y"), F.when(F.col("own") == k, 2).when(F.col("own") < k, 0).otherwise(1).alias("side")))
    blocks = open_.select("main", "id", "component", F.explode(F.when(F.col("is_main"), beside).otherwise(F.concat(across, among))).alias("at")).select("main", "at.x", "at.y", "at.side", "id", "component")
    more = written(_compared(blocks, signed, ["main", "x", "y"], least, signature_least), "more")
    named = components(named.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    of_class = classes.join(named.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "id").alias("found"))
    out = features.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
