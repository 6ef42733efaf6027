"""Leading eigenvectors of graphs. Of the normalized adjacency by restarted Krylov spaces: vectors stay packed by part (:mod:`gneiss.operators.parts`), and in a
step a part sends one packed row to each part with edges to it. Of the non-backtracking operator by orthogonal iteration: vectors are columns of written tables.

Only Gram matrices of a few times ``k`` numbers a side reach the driver; rounds end when the eigenvalues of the projected operator stand still.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.parts import packed
from gneiss.plans.store import written


def _names(k: int) -> list[str]:
    return [f"x{i}" for i in range(k)]


def _mixed(df: DataFrame, keys: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """Columns times a matrix."""
    rows, cols = matrix.shape
    total = lambda j: sum((F.col(f"x{i}") * float(matrix[i, j]) for i in range(rows)), F.lit(0.0))
    return df.select(*keys, *(total(j).alias(f"x{j}") for j in range(cols)))


def _products(df: DataFrame, left: Sequence[Column], right: Sequence[Column]) -> np.ndarray:
    """Inner products of columns, as a matrix."""
    row = df.agg(*(F.sum(a * b) for a in left for b in right)).first()
    return np.array([x or 0.0 for x in row]).reshape(len(left), len(right))


def _iterated(start: DataFrame, keys: Sequence[str], k: int, images: Callable[[DataFrame], DataFrame], rounds: int, least: float) -> tuple[DataFrame, np.ndarray]:
    """Columns that span the leading invariant subspace of an operator, and its eigenvalues. ``images`` gives columns ``y`` beside ``x``: the operator applied."""
    cols, after, seen = [F.col(c) for c in _names(k)], [F.col(f"y{i}") for i in range(k)], None

    def orthonormal(df: DataFrame, gram: np.ndarray) -> DataFrame:
        factor = np.linalg.cholesky(gram + 1e-14 * (np.trace(gram) + 1e-300) * np.eye(k))
        return _mixed(df, keys, np.linalg.inv(factor).T)

    start = written(start)
    now = written(orthonormal(start, _products(start, cols, cols)))
    while True:
        both = written(images(now))
        small = _products(both, [*cols, *after], after)
        gram, small = small[k:], small[:k]
        values = np.array(sorted(np.linalg.eigvals(small), key=lambda z: (-abs(z), -z.real, -z.imag)))
        rounds -= 1
        if rounds < 1 or seen is not None and np.abs(values - seen).max() < least:
            return now, values
        seen = values
        now = orthonormal(both.select(*keys, *(y.alias(f"x{i}") for i, y in enumerate(after))), gram)


def _start(df: DataFrame, keys: Sequence[str], k: int, *kept: str) -> DataFrame:
    """Hashed numbers from -1 to 1."""
    number = lambda i: F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(1 << 20)) / float(1 << 19) - 1.0
    return df.select(*keys, *kept, *(number(i).alias(f"x{i}") for i in range(k)))


_STATIC = "part long, low long, own array<long>, counts array<int>, at array<int>, targets array<long>, sizes array<int>, picked array<int>"


def _routed(graph: DataFrame) -> tuple[DataFrame, int]:
    """A row for each part: its nodes, their edges as places of their ends, and which of its nodes go to which part; and the number of parts."""
    # Parts hold nodes that follow each other, so their first nodes, one number a part, tell where a node is at home.
    firsts = sorted((r["low"], r["part"]) for r in graph.select("part", F.expr("ends[rows[0]]").alias("low")).collect())
    lows, names, n = np.array([x[0] for x in firsts]), [x[1] for x in firsts], len(firsts)
    numbers = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ends in zip(b.column("part").to_pylist(), b.column("ends"), strict=True):
                nodes = ends.values.to_numpy()
                home = np.searchsorted(lows, nodes, side="right") - 1
                at = np.flatnonzero(np.diff(home, prepend=-1))
                lists = pa.ListArray.from_arrays(np.append(at, len(nodes)).astype(np.int32), pa.array(nodes))
                yield pa.RecordBatch.from_arrays([pa.array([names[h] for h in home[at]]), pa.array([part] * len(at)), lists], ["part", "target", "nodes"])

    def picked(x: pa.Table, y: pa.Table) -> pa.Table:
        own = numbers(x, "ends")[numbers(x, "rows")]
        sizes = [len(v) for v in y.column("nodes").to_pylist()]
        at = np.searchsorted(own, numbers(y, "nodes")).astype(np.int32)
        one = {"part": x.column("part"), "low": [int(own[0])], "own": [own], "counts": x.column("counts"), "at": x.column("at"), "targets": [y.column("target").to_pylist()], "sizes": [np.array(sizes, np.int32)], "picked": [at]}
        return pa.table(one)

    requests = graph.select("part", "ends").mapInArrow(asked, "part long, target long, nodes array<long>")
    static = graph.select("part", "ends", "rows", "counts", "at").groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(picked, _STATIC)
    return written(static, "routed"), n


def _ritz(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the operator on the span of ``V, AV, ...`` but the last, and their vectors in that basis, from all inner products."""
    n = len(gram) - k
    inner, through = gram[:n, :n], gram[:n, k:]
    size, turn = np.linalg.eigh(inner)
    kept = size > 1e-13 * size[-1]
    basis = turn[:, kept] / np.sqrt(size[kept])
    values, vectors = np.linalg.eigh(basis.T @ ((through + through.T) / 2) @ basis)
    return values[::-1][:k], basis @ vectors[:, ::-1][:, :k]


def _ritz_rounds(graph: DataFrame, k: int, rounds: int, least: float, depth: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of ``D^-1/2 A D^-1/2`` for the largest eigenvalues: each round applies it ``depth`` times and takes the best vectors of all that came out."""
    static, n = _routed(graph)
    tasks = min(2000, 2 * n)
    nodes = static.select("part", F.posexplode("own").alias("i", "node"))
    rows = _start(nodes, ["node"], k, "part", "i").select("part", "i", F.array(*_names(k)).alias("x"))

    def first(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("i").to_numpy())))
        return pa.table({"part": t.column("part").slice(0, 1), "x": [t.column("x").combine_chunks().flatten().to_numpy().tobytes()]})

    def told(part: dict, x: np.ndarray, held: np.ndarray) -> pa.Table:
        """``x``, scaled, for all parts that have edges to this one's nodes, and what it keeps."""
        y = x / np.sqrt(part["counts"])[:, None]
        stop = np.cumsum(part["sizes"])
        out = [y[part["picked"][a:b]].tobytes() for a, b in zip(stop - part["sizes"], stop, strict=True)]
        return pa.table({"part": [*part["targets"].tolist(), part["part"]], "low": pa.array([part["low"]] * len(out) + [None], pa.int64()), "x": [*out, held.tobytes()]})

    def opened(t: pa.Table) -> dict:
        out = {c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("own", "counts", "at", "targets", "sizes", "picked")}
        return out | {"part": t.column("part")[0].as_py(), "low": t.column("low")[0].as_py()}

    matrix = lambda raw, width: np.frombuffer(raw, np.float64).reshape(-1, width)

    def met(state: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return static.repartition(tasks, "part").groupBy("part").cogroup(state.repartition(tasks, "part").groupBy("part")).applyInArrow(run, schema)

    def begun(mix: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x = matrix(right.column("x")[0].as_py(), len(mix)) @ mix
            return told(opened(left), x, x)

        return run

    def applied(i: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            part, sent = opened(left), {}
            for low, raw in zip(right.column("low").to_pylist(), right.column("x").to_pylist(), strict=True):
                sent[low] = raw
            held = matrix(sent.pop(None), k * i)
            ends = np.concatenate([matrix(sent[low], k) for low in sorted(sent)])
            starts, scale = np.cumsum(part["counts"]) - part["counts"], 1 / np.sqrt(part["counts"])
            y = np.stack([np.add.reduceat(np.ascontiguousarray(ends[:, j])[part["at"]], starts) * scale for j in range(k)], axis=1)
            held = np.concatenate([held, y], axis=1)
            if i < depth:
                return told(part, y, held)
            return pa.table({"part": [part["part"]], "x": [np.ascontiguousarray(held[:, :-k]).tobytes()], "gram": [(held.T @ held).reshape(-1)]})

        return run

    def ended(mix: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x = matrix(right.column("x")[0].as_py(), len(mix)) @ mix
            return pa.table({"node": opened(left)["own"]} | {f"x{i}": x[:, i] for i in range(k)})

        return run

    now, mix, seen = written(rows.groupBy("part").applyInArrow(first, "part long, x binary"), "vectors"), np.eye(k), None
    while True:
        now = met(now.select("part", "x"), begun(mix), "part long, low long, x binary")
        for i in range(1, depth + 1):
            now = met(now, applied(i), "part long, low long, x binary" if i < depth else "part long, x binary, gram array<double>")
        now = written(now, "vectors")
        sums = now.select(F.posexplode("gram").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        values, mix = _ritz(np.array([r["v"] for r in sums]).reshape(k * (depth + 1), -1), k)
        rounds -= 1
        # As parts of the operator's whole range, from -1 to 1.
        if rounds < 1 or seen is not None and np.abs(values - seen).max() / 2 < least:
            return met(now.select("part", "x"), ended(mix), ", ".join(["node long", *(f"{c} double" for c in _names(k))])), values
        seen = values


def eigenvectors(edges: DataFrame, k: int, how: str = "normalized", rounds: int = 200, least: float = 1e-7) -> tuple[DataFrame, np.ndarray]:
    """``node, x0, ..., x(k-1)`` and the ``k`` eigenvalues, of the graph without directions, loops and repeats.

    ``normalized``: largest eigenvalues of ``D^-1/2 A D^-1/2``. ``non_backtracking``: largest in absolute value of the operator that goes on
    from an edge to all edges at its end but the reverse; a node's numbers are sums over the edges that leave it, of ``k`` orthonormal columns
    that span the leading eigenvectors. ``k`` is at most the number of nodes.
    """
    from gneiss.operators.graphs import neighbours

    near = written(neighbours(edges))
    if how == "normalized":
        return _ritz_rounds(packed(near), k, rounds, least)
    if how != "non_backtracking":
        raise ValueError(f"unknown operator: {how}")

    def follow(x: DataFrame) -> DataFrame:
        """The sum over edges that leave an edge's end, less the reverse edge."""
        sums = x.groupBy(F.col("src").alias("dst")).agg(*(F.sum(c).alias(f"s{c[1:]}") for c in _names(k)))
        back = x.select(F.col("src").alias("dst"), F.col("dst").alias("src"), *(F.col(c).alias(f"r{c[1:]}") for c in _names(k)))
        return x.select("src", "dst").join(sums, "dst").join(back, ["src", "dst"]).select("src", "dst", *((F.col(f"s{i}") - F.col(f"r{i}")).alias(f"x{i}") for i in range(k)))

    def after(x: DataFrame) -> DataFrame:
        return x.join(follow(x).select("src", "dst", *(F.col(f"x{i}").alias(f"y{i}") for i in range(k))), ["src", "dst"])

    on_edges, values = _iterated(_start(near, ["src", "dst"], k), ["src", "dst"], k, after, rounds, least)
    return on_edges.groupBy(F.col("src").alias("node")).agg(*(F.sum(c).alias(c) for c in _names(k))), values


def clustered(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``node, block`` by k-means on the rows of ``vectors(node, x0, ...)`` scaled to length 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cols = [c for c in vectors.columns if c != "node"]
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    rows = written(vectors.select("node", F.array(*(F.coalesce(F.col(c) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) for c in cols)).alias("x")))
    held = rows.select("node", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=40, initSteps=5).fit(held).transform(held).select("node", F.col("prediction").alias("block"))
