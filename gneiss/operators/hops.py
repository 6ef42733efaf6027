"""Hop distances of many small graphs at once: bitset fronts, packed graphs.

A graph of at most ``SMALL`` rows (nodes and bonds) is held in one row, so the bound is one of rows, not of tables. A task takes the graphs
of an Arrow batch in packs of similar size, numbers their nodes through, and lets every node hold the set of nodes that it reaches as
bits: a step is an OR over neighbours for all nodes of all graphs of the pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 512
PACK = 1 << 22  # bits of a pack's sets


def _packs(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of graphs, smallest first, in packs whose nodes times the largest size stay within ``PACK``."""
    order = np.argsort(sizes, kind="stable")
    start, total = 0, 0
    for at, size in enumerate(sizes[order].tolist()):
        if at > start and (total + size) * size > PACK:
            yield order[start:at]
            start, total = at, 0
        total += size
    if len(order):
        yield order[start:]


def _walked(graphs: pa.Array, items: pa.Array, most: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of one pack, a batch for each number of hops."""
    flat = items.flatten()
    sizes = np.diff(items.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    ids = pa.concat_arrays([flat.field("i"), flat.field("j")]).dictionary_encode()
    codes, n_codes = ids.indices.to_numpy(), len(ids.dictionary)
    nodes, place = np.unique(np.concatenate([row, row]) * n_codes + codes, return_inverse=True)
    src, dst = np.split(place, 2)
    graph, code = np.divmod(nodes, n_codes)
    local = np.arange(len(nodes)) - np.searchsorted(graph, graph)
    starts = np.zeros(len(nodes), bool)
    starts[src[flat.field("node").to_numpy(zero_copy_only=False)]] = True

    front = np.zeros((len(nodes), int(local.max()) // 64 + 1), np.uint64)
    front[np.arange(len(nodes)), local // 64] = np.uint64(1) << (local % 64).astype(np.uint64)
    reached = front.copy()
    other = src != dst
    edges = np.unique(np.concatenate([src[other], dst[other]]) * len(nodes) + np.concatenate([dst[other], src[other]]))
    tail, head = np.divmod(edges, len(nodes))
    own, first = np.unique(tail, return_index=True)
    origin = np.arange(len(nodes)) - local
    k = 0
    while True:
        at, bit = np.nonzero(np.unpackbits(front.view(np.uint8), axis=1, bitorder="little") & starts[:, None])
        if len(at):
            to = origin[at] + bit
            out = [graphs.take(pa.array(graph[at])), ids.dictionary.take(pa.array(code[at])), ids.dictionary.take(pa.array(code[to])), pa.array(np.full(len(at), k, np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["graph_id", "i", "j", "hops"])
        k += 1
        if not len(own) or not front.any() or (most is not None and k > most):
            return
        new = np.bitwise_or.reduceat(front[head], first, axis=0) & ~reached[own]
        front = np.zeros_like(front)
        front[own] = new
        reached[own] |= new


def _walk(most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graphs, items = batch.column("graph_id"), batch.column("items")
            sizes = np.diff(items.offsets.to_numpy())
            for pack in _packs(sizes):
                chosen = pa.array(pack)
                yield from _walked(graphs.take(chosen), items.take(chosen), most)

    return run


def small_graphs(items: DataFrame, most: int | None) -> DataFrame:
    """``graph_id, i, j, hops`` for ``items(graph_id, i, j, node)`` of graphs of at most ``SMALL`` rows: bonds, and nodes as ``i = j`` with ``node`` true."""
    kinds = dict(items.dtypes)
    held = items.groupBy("graph_id").agg(F.collect_list(F.struct("i", "j", "node")).alias("items"))
    return held.mapInArrow(_walk(most), f"graph_id {kinds['graph_id']}, i {kinds['i']}, j {kinds['j']}, hops int")
