"""Walks in graphs so dense that two or three steps reach most nodes: a strip of sources at a time against all edges.

A strip's numbers are a matrix of all nodes by its sources in a task's memory. The edges come in packed rows, once for each strip and step, so
what is shuffled is strips times edges and no row is written or shuffled for a pair of nodes but the results'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.products import _numbered
from gneiss.plans.store import written

NODES = 64  # of a packed row
CELLS = 1 << 27  # entries of a strip's matrix at most
LEAST = 16  # strips at least, where they have NODES sources or more
ITEMS = 2048  # nodes of a row of what a strip reaches


class Dense:
    """Packed edges of ``near(src, dst)``, each in both directions: nodes are numbered ``0`` to ``n - 1`` after ``low`` or by ``names``."""

    def __init__(self, near: DataFrame):
        sides, self.names = _numbered([near.select(F.col("src").alias("node"), F.col("dst").alias("item"))])
        side = sides[0]
        low, high = side.agg(F.min("node"), F.max("node")).first()
        self.low, self.n = (low, high - low + 1) if low is not None else (0, 1)
        rows = min(CELLS // self.n, -(-self.n // LEAST))
        self.rows = max(NODES, rows // NODES * NODES)
        self.strips = -(-self.n // self.rows)
        short = self.n <= 1 << 16

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            src, dst = t.column("src").to_numpy(), t.column("dst").to_numpy()
            order = np.lexsort((dst, src))
            counts = np.bincount(src - key[0].as_py() * NODES, minlength=NODES)
            return pa.table({"m": [key[0].as_py()], "counts": [counts.astype(np.int32).tobytes()], "dst": [dst[order].astype(np.uint16 if short else np.int32).tobytes()]})

        at = side.select((F.col("node") - self.low).alias("src"), (F.col("item") - self.low).alias("dst"))
        self.short, self.packed = short, written(at.groupBy(F.floor(F.col("src") / NODES).alias("m")).applyInArrow(pack, "m long, counts binary, dst binary"), "packed")

    def walked(self, steps: int, strip: Callable[[int, int], object], schema: str, last_from_own: bool = False) -> DataFrame:
        """What a strip's walker gives: ``strip(low, high)`` makes one, its ``step(i, node, neighbours)`` is called for the strip's own nodes at step 0, then
        ``steps`` times for all nodes in order, and gives batches or None; ``done()`` ends each step. ``last_from_own``: the last step leaves out nodes before the strip's own."""
        rows, short, n = self.rows, self.short, self.n
        own = F.floor(F.col("m") * NODES / rows)
        every = self.packed.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(self.strips - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        sent = every.where((F.col("step") > 0) | (F.col("strip") == own))
        if last_from_own:
            sent = sent.where((F.col("step") < steps) | (own >= F.col("strip")))
        sent = sent.repartition(4 * self.strips, "strip").sortWithinPartitions("strip", "step", "m")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = walker = None
            for b in batches:
                keys, counts, dst = [b.column(c).to_pylist() for c in ("strip", "step", "m")], b.column("counts"), b.column("dst")
                for i, (s, step, m) in enumerate(zip(*keys, strict=True)):
                    if at != (s, step):
                        if walker is not None:
                            yield from walker.done()
                        if at is None or at[0] != s:
                            walker = strip(s * rows, min(n, (s + 1) * rows))
                        at = s, step
                    many = np.frombuffer(counts[i].as_buffer(), np.int32)
                    ends = np.frombuffer(dst[i].as_buffer(), np.uint16 if short else np.int32).astype(np.int64)
                    stop = np.cumsum(many)
                    near = [(m * NODES + k, ends[stop[k] - many[k] : stop[k]]) for k in range(NODES) if many[k]]
                    yield from walker.step(step, near)
            if walker is not None:
                yield from walker.done()

        return sent.select("strip", "step", "m", "counts", "dst").mapInArrow(run, schema)

    def named(self, found: DataFrame, a: str, b: str) -> DataFrame:
        """``found`` with the nodes' own ids in columns ``a`` and ``b``."""
        rest = [c for c in found.columns if c not in (a, b)]
        if self.names is None:
            return found.select((F.col(a) + self.low).alias(a), (F.col(b) + self.low).alias(b), *rest)
        of = lambda c: self.names.select((F.col("at") - self.low).alias(c), F.col("id").alias(f"_{c}"))
        return found.join(of(a), a).join(of(b), b).select(F.col(f"_{a}").alias(a), F.col(f"_{b}").alias(b), *rest)


def is_dense(near: DataFrame) -> bool:
    """Whether walks of three steps are more than the matrix of all nodes has cells: then strips cost less than rows for pairs."""
    degree = near.groupBy("src").agg(F.count("*").alias("d"))
    n, m, paths = degree.agg(F.count("*"), F.sum("d"), F.sum(F.col("d") * F.col("d"))).first()
    return bool(n) and n * NODES <= CELLS and 16 * (paths / m) ** 2 >= n


def _summed(x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """The sum of rows ``near`` of ``x``, whose numbers are ``most`` at most; exact."""
    total = None
    for k in range(0, len(near), 4096):
        part = x.take(near[k : k + 4096], axis=0)
        kind = np.uint16 if most * len(part) < 1 << 16 else np.uint32 if most * len(part) < 1 << 32 else np.float64
        got = part.sum(axis=0, dtype=kind)
        total = got.astype(np.float64) if total is None else total + got
    return total


class _Katz:
    """Numbers of walks from a strip's sources to all nodes, and in the last step their weighed sum."""

    def __init__(self, low: int, high: int, n: int, beta: float, terms: int):
        self.low, self.width, self.n, self.beta, self.terms = low, high - low, n, beta, terms
        self.walks, self.most, self.next, self.peak = [np.zeros((n, self.width), np.uint8)], [1], None, 0

    def step(self, i: int, near: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not i:
            for node, ends in near:
                self.walks[0][ends, node - self.low] = 1
            return
        if i < self.terms - 1:
            for node, ends in near:
                got = _summed(self.walks[-1], ends, self.most[-1])
                top = int(got.max())
                kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.float64
                if self.next is None or np.promote_types(self.next.dtype, kind) != self.next.dtype:
                    self.next = np.zeros((self.n, self.width), kind) if self.next is None else self.next.astype(kind)
                self.next[node], self.peak = got, max(self.peak, top)
            return
        src, dst, w = [], [], []
        for node, ends in near:
            if node < self.low:
                continue
            total = _summed(self.walks[-1], ends, self.most[-1]) * self.beta**self.terms
            for k, x in enumerate(self.walks, 1):
                total += x[node] * self.beta**k
            upto = min(self.width, node - self.low + 1)
            at = np.flatnonzero(total[:upto])
            mirror = at[at + self.low < node]
            src += [at + self.low, np.full(len(mirror), node)]
            dst += [np.full(len(at), node), mirror + self.low]
            w += [total[at], total[mirror]]
        if src:
            yield pa.RecordBatch.from_arrays([np.concatenate(src), np.concatenate(dst), np.concatenate(w)], ["src", "dst", "w"])

    def done(self) -> list:
        if self.next is not None:
            self.walks.append(self.next)
            self.most.append(self.peak)
            self.next, self.peak = None, 0
        return []


def katz(near: DataFrame, beta: float, terms: int) -> DataFrame:
    """``src, dst, w`` of :func:`gneiss.operators.graphs.katz` for a dense graph and three terms or more."""
    graph = Dense(near)
    n = graph.n
    found = graph.walked(terms - 1, lambda low, high: _Katz(low, high, n, beta, terms), "src long, dst long, w double", last_from_own=True)
    return graph.named(found, "src", "dst")


class _Reach:
    """The sources of a strip, as bits, that reach each node in 1 to ``hops`` steps; then rows of ``items`` nodes, and one with the numbers of nodes reached."""

    def __init__(self, low: int, high: int, n: int, hops: int, items: int):
        self.low, self.width, self.n, self.hops, self.items, self.at = low, high - low, n, hops, items, 0
        self.own, self.now, self.next = np.zeros((n, self.width), np.bool_), None, None

    def step(self, i: int, near: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not i:
            for node, ends in near:
                self.own[ends, node - self.low] = True
        else:
            if self.next is None:
                self.next = np.zeros_like(self.now)
            for node, ends in near:
                for k in range(0, len(ends), 4096):
                    self.next[node] |= np.bitwise_or.reduce(self.now.take(ends[k : k + 4096], axis=0), axis=0)
        return iter(())

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.own is not None:
            self.now = self.reach = np.packbits(self.own, axis=1)
            self.own = None
        else:
            self.now, self.next, self.reach = self.next, None, self.reach | self.next
        self.at += 1
        if self.at < self.hops:
            return
        d = np.zeros(self.width, np.int64)
        for k in range(0, self.n, self.items):
            bits = self.reach[k : k + self.items]
            d += np.unpackbits(bits, axis=1, count=self.width).sum(axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([self.low]), pa.array([k]), pa.array([bits.tobytes()]), pa.array([int(np.bitwise_count(bits).sum())])], ["low", "item", "bits", "ones"])
        yield pa.RecordBatch.from_arrays([pa.array([self.low]), pa.array([-1]), pa.array([d.tobytes()]), pa.array([0])], ["low", "item", "bits", "ones"])


def common_reached(near: DataFrame, k: int, hops: int) -> DataFrame:
    """``a, b, common``: pairs ``a < b`` that share ``k`` nodes or more of what each reaches in 1 to ``hops`` steps, for a dense graph.

    Where most is reached, what isn't is counted instead: of that, nodes that all sources of a strip reach are neither sent nor looked at.
    """
    graph = Dense(near)
    n, rows, items = graph.n, graph.rows, ITEMS
    reach = written(graph.walked(hops - 1, lambda low, high: _Reach(low, high, n, hops, items), "low long, item long, bits binary, ones long"), "reach")
    total = reach.agg(F.sum("ones")).first()[0] or 0
    flipped = 2 * total > n * n
    cells = F.least(F.lit(n) - F.col("item"), F.lit(items)) * F.least(F.lit(n) - F.col("low"), F.lit(rows))
    some = reach.where((F.col("item") < 0) | (F.col("ones") < cells if flipped else F.col("ones") > 0)).drop("ones")
    last = F.lit((graph.strips - 1) * rows)
    a = some.select(F.col("low").alias("A"), F.explode(F.sequence("low", last, F.lit(rows))).alias("B"), "item", "bits")
    b = some.select(F.explode(F.sequence(F.lit(0), F.col("low"), F.lit(rows))).alias("A"), F.col("low").alias("B"), *(F.col(c).alias(c) for c in ("item", "bits")))
    tasks = min(2000, graph.strips * (graph.strips + 1) // 2)

    def held(t: pa.Table, width: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        d, out = None, {}
        for item, bits in zip(t.column("item").to_pylist(), t.column("bits").to_pylist(), strict=True):
            if item < 0:
                d = np.frombuffer(bits, np.int64)
            else:
                x = np.frombuffer(bits, np.uint8).reshape(-1, -(-width // 8))
                out[item] = ~x if flipped else x
        return d, out

    def met(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        la, lb = (v.as_py() for v in key)
        wa, wb = min(rows, n - la), min(rows, n - lb)
        (da, xs), (db, ys) = held(x, wa), held(y, wb)
        common = np.zeros((wa, wb), np.float32)
        for item in sorted(xs.keys() & ys.keys()):
            p, q = np.unpackbits(xs[item], axis=1, count=wa), np.unpackbits(ys[item], axis=1, count=wb)
            both = p.any(axis=1) & q.any(axis=1)
            if both.any():
                common += p[both].astype(np.float32).T @ q[both].astype(np.float32)
        if flipped:
            common += (da[:, None] + db[None, :] - n).astype(np.float32)
        kept = common >= max(1, k)
        if la == lb:
            kept &= np.arange(wa)[:, None] < np.arange(wb)[None, :]
        i, j = np.nonzero(kept)
        return pa.table([i + la, j + lb, common[i, j].astype(np.int64)], names=["a", "b", "common"])

    found = a.repartition(tasks, "A", "B").groupBy("A", "B").cogroup(b.repartition(tasks, "A", "B").groupBy("A", "B")).applyInArrow(met, "a long, b long, common long")
    return graph.named(found, "a", "b")
