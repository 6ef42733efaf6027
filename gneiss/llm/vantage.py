"""Nearest neighbours by inner product with a vantage-point tree in each shard.

With an extra coordinate ``sqrt(M**2 - |x|**2)`` (M: a shard's largest norm) every vector of a shard gets the same
length, and the order by inner product becomes the order by Euclidean distance to the query, where the triangle
inequality holds. Scaling a shard by M and a query by its own norm leaves a query's order as it is, so trees hold numbers
up to 1 whatever the vectors hold. Shards are drawn by a hash of the id; queries come in large blocks, as each block costs
a copy of all vectors, and go through a shard's tree piece by piece. A pair of a shard and a block is of bounded size.
A branch is passed over if ``factor`` times the lower bound of its distances exceeds the distance of the neighbours found
so far: factor 1 is exact, a larger one visits less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import table

SHARD, BLOCK, PIECE, LEAF = 8192, 16384, 2048, 512
FACTOR = 1.0
SPARE = 6  # further vectors that may round to a better score
SLACK = 1e-6


class Tree:
    """Nodes over the rows of ``x``, scaled: a vantage row, the ranges of distances of its two halves, or a leaf's rows."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        x = x / np.abs(x).max()
        self.x = x / np.sqrt((x * x).sum(axis=1).max())
        self.norms = (self.x * self.x).sum(axis=1)
        self.rest = np.sqrt(np.maximum(0.0, 1 - self.norms))
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        v = int(rows[self.rng.integers(len(rows))])
        far = np.sqrt(np.maximum(0.0, self.norms[rows] + self.norms[v] - 2 * (self.x[rows] @ self.x[v]) + (self.rest[rows] - self.rest[v]) ** 2))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        near, off = order[:half], order[half:]
        return v, (far[near[0]], far[near[-1]], self._node(rows[near])), (far[off[0]], far[off[-1]], self._node(rows[off]))

    def nearest(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and scaled scores of about the ``k`` best for each query, unsorted."""
        k = min(k, len(self.x))
        queries = queries / np.abs(queries).max(axis=1, keepdims=True)
        queries = queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        rows = np.full((len(queries), k), -1, np.int64)
        scores = np.full((len(queries), k), -np.inf)
        base = (queries * queries).sum(axis=1) + 1

        def visit(node, of: np.ndarray) -> None:
            if not len(of):
                return
            if isinstance(node, np.ndarray):
                s = np.concatenate([scores[of], queries[of] @ self.x[node].T], axis=1)
                r = np.concatenate([rows[of], np.broadcast_to(node, (len(of), len(node)))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                scores[of], rows[of] = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1)
                return
            v, near, off = node
            d = np.sqrt(np.maximum(0.0, base[of] - 2 * (queries[of] @ self.x[v])))
            bounds = [np.maximum(0.0, np.maximum(d - part[1], part[0] - d)) for part in (near, off)]
            first = bounds[0] <= bounds[1]
            for part, bound, turn in ((near, bounds[0], first), (off, bounds[1], ~first), (off, bounds[1], first), (near, bounds[0], ~first)):
                mine = of[turn]
                reach = np.sqrt(np.maximum(0.0, base[mine] - 2 * scores[mine].min(axis=1)))
                visit(part[2], mine[factor * bound[turn] <= reach + SLACK])

        visit(self.root, np.arange(len(queries)))
        return rows, scores


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in order, so that equal vectors get equal scores."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def _search(k: int, factor: float):
    schema = pa.schema([("query_id", pa.int64()), ("twin", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        q_ids, twins, q = queries.column("vec_id").to_numpy(), queries.column("twin").to_numpy(), _matrix(queries.column("embedding"), queries.num_rows)
        _, once = np.unique(np.stack([q_ids, twins]), axis=1, return_index=True)
        q_ids, twins, q = q_ids[once], twins[once], q[once]
        ids, every = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("embedding"), vectors.num_rows)
        order = np.argsort(ids, kind="stable")
        ids, every = ids[order], every[order] + 0.0
        # Equal vectors are one point of the tree; of its ids only the smallest can be among a query's neighbours.
        x, point = np.unique(every, axis=0, return_inverse=True)
        point = point.ravel()
        by = np.argsort(point, kind="stable")
        starts = np.searchsorted(point[by], np.arange(len(x) + 1))
        sizes = np.minimum(np.diff(starts), k + 1)
        tree, tables = Tree(x), []
        for start in range(0, len(q), PIECE):
            some, mine = q[start : start + PIECE], q_ids[start : start + PIECE]
            rows, _ = tree.nearest(some, k + 1 + SPARE, factor)
            who, slot = np.nonzero(rows >= 0)
            found = rows[who, slot]
            score = _dot(some[who], x[found])
            times = sizes[found]
            at = np.repeat(starts[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            who, score, found, near = np.repeat(who, times), np.repeat(score, times), np.repeat(found, times), ids[by[at]]
            # A query's own row is one of those with its id and vector; the others count.
            same = np.flatnonzero(near == mine[who])
            same = same[(x[found[same]] == some[who[same]]).all(axis=1)]
            other = np.ones(len(who), bool)
            other[same[np.unique(who[same], return_index=True)[1]]] = False
            who, score, near = who[other], score[other], near[other]
            order = np.lexsort((near, -score, who))
            who, score, near = who[order], score[order], near[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            who = who[keep] + start
            tables.append(pa.table([q_ids[who], twins[who], near[keep], score[keep]], schema=schema))
        return pa.concat_tables(tables)

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of ``vectors(vec_id, embedding, ...)`` with the largest inner product.

    Ties go to the smaller vec_id; a vector isn't its own neighbour. Vectors that are null, empty or zero, or hold
    null, infinite or NaN components, and rows without a vec_id take no part, as queries or as candidates; vectors of
    different lengths aren't compared. Of rows that repeat a vec_id, each counts: a query's own row alone is left out, and
    queries with one vec_id and different vectors each get their own ranks; those with equal vectors are one query. Where
    a product exceeds the doubles, neighbours are found by the scaled product, and equal infinite scores are ties. No
    vectors give no rows.
    """
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole & sound).withColumn("width", F.size("embedding"))
    vectors, queries = pick(vectors), pick(queries)
    queries = queries.withColumn("twin", F.xxhash64(F.transform("embedding", lambda x: x + F.lit(0.0))))
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", numbers(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", numbers(shards))
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, factor), "query_id long, twin long, vec_id long, score double")
    best = Window.partitionBy("query_id", "twin").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"))
