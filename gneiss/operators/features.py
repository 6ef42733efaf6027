"""Atom and bond features, directed bonds, distances, fingerprints and scaffolds of many small graphs.

Nodes are ``(graph_id, node_id, ...)``, bonds ``(graph_id, src, dst, ...)`` with each bond once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import hops
from gneiss.plans.store import until_settled, written

#: Choices of the atom and bond encodings.
ATOM_CHOICES = {"atomic_num": list(range(1, 101)), "degree": [0, 1, 2, 3, 4, 5], "charge": [-1, -2, 1, 2, 0], "chirality": [0, 1, 2, 3], "num_h": [0, 1, 2, 3, 4], "hyb": ["SP", "SP2", "SP3", "SP3D", "SP3D2"]}
BOND_TYPES = ["SINGLE", "DOUBLE", "TRIPLE", "AROMATIC"]
STEREO = [0, 1, 2, 3, 4, 5]
SCALED_STEREO = ["ANY", "CIS", "E", "NONE", "TRANS", "Z"]


def onehot_unk(col: Column, choices: Sequence) -> Column:
    """One place for each choice and a last one for anything else."""
    return F.concat(F.transform(F.array(*(F.lit(c) for c in choices)), lambda c: F.coalesce((c == col).cast("int"), F.lit(0))), F.array((~F.coalesce(col.isin(*choices), F.lit(False))).cast("int")))


def onehot_label(col: Column, n: int) -> Column:
    """Place ``col`` of 1 to ``n``; 0 wraps to the last."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.when(col == 0, n).otherwise(col) == i).cast("int"))


def onehot_last(col: Column, choices: Sequence, zero: float = 0) -> Column:
    """As :func:`onehot_unk` without a place of its own for others: they take the last choice's. ``zero`` gives the places' type."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in choices)), col), F.lit(0)), F.lit(len(choices)))
    at = at.cast("int")
    return F.concat(F.array_repeat(F.lit(zero), at - 1), F.array(F.lit(type(zero)(1))), F.array_repeat(F.lit(zero), F.lit(len(choices)) - at))


def atom_features(atoms: DataFrame) -> DataFrame:
    """``graph_id, node_id, features``: 133 numbers."""
    parts = [onehot_unk(F.col(c), choices) for c, choices in ATOM_CHOICES.items()]
    numbers = F.array(F.col("aromatic").cast("double"), F.col("mass") * 0.01)
    return atoms.select("graph_id", "node_id", F.concat(F.concat(*parts).cast("array<double>"), numbers).alias("features"))


def bond_features(bonds: DataFrame) -> DataFrame:
    """``graph_id, src, dst, features``: 14 numbers; a bond without type is the null flag alone."""
    there = F.concat(F.array(F.lit(0)), F.transform(F.array(*(F.lit(t) for t in BOND_TYPES)), lambda t: (t == F.col("type")).cast("int")), F.array(F.col("conjugated").cast("int"), F.col("ring").cast("int")), onehot_unk(F.col("stereo"), STEREO))
    none = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), 13))
    return bonds.select("graph_id", "src", "dst", F.when(F.col("type").isNull(), none).otherwise(there).alias("features"))


def scaled_atom(col: Column, top: float) -> Column:
    """A fraction of ``top``; missing and infinite values are 0."""
    x = col.cast("double") / top
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def with_degree(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    ends = bonds.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, ["graph_id", "node_id"], "left").fillna(0, ["degree"])


def node_x(nodes: DataFrame, bonds: DataFrame, label: int = 0, attrs: Sequence[str] = (), degree: bool = False) -> DataFrame:
    """``graph_id, node_id, x``: any of a one-hot label, attributes and degree; a constant 1 if none."""
    parts = []
    if label:
        parts.append(onehot_label(F.col("label"), label).cast("array<double>"))
    if attrs:
        parts.append(F.array(*(F.col(a).cast("double") for a in attrs)))
    if degree:
        nodes = with_degree(nodes, bonds)
        parts.append(F.array(F.col("degree").cast("double")))
    return nodes.select("graph_id", "node_id", F.concat(*parts).alias("x") if parts else F.array(F.lit(1.0)).alias("x"))


def directed_bonds(bonds: DataFrame) -> DataFrame:
    """``graph_id, bond_id, src, dst, rev_id``: two rows a bond, numbered in a graph; the reverse differs in the last bit."""
    w = Window.partitionBy("graph_id").orderBy("src", "dst")
    numbered = bonds.withColumn("_n", F.row_number().over(w) - 1)
    pair = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = numbered.select("graph_id", "_n", F.posexplode(pair).alias("k", "x")).select("graph_id", (2 * F.col("_n") + F.col("k")).alias("bond_id"), "x.src", "x.dst")
    return out.withColumn("rev_id", F.col("bond_id").bitwiseXOR(F.lit(1)))


def batch_offsets(sizes: DataFrame, graph: str = "graph_id", size: str = "n") -> DataFrame:
    """``start``: first batch-wide number of each graph; 0 is the padding's."""
    from gneiss.plans.rank import running_sum

    return running_sum(sizes, graph, size, "_upto").withColumn("start", F.col("_upto") - F.col(size) + 1).drop("_upto")


def incoming_bonds(directed: DataFrame) -> DataFrame:
    """``graph_id, node_id, bonds``: ids of bonds that end in a node, in order."""
    return directed.groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sort_array(F.collect_list("bond_id")).alias("bonds"))


def bond_neighbors(directed: DataFrame) -> DataFrame:
    """``graph_id, bond_id, from_id``: bonds that end where a bond begins, less its reverse."""
    a, b = directed.select("graph_id", "bond_id", "rev_id", F.col("src").alias("node")), directed.select("graph_id", F.col("bond_id").alias("from_id"), F.col("dst").alias("node"))
    return a.join(b, ["graph_id", "node"]).where("from_id <> rev_id").select("graph_id", "bond_id", "from_id")


def atom_features_wide(atoms: DataFrame) -> DataFrame:
    """``graph_id, node_id, features``: 1014 numbers, of them one-hot 1000 atomic numbers, 6 degrees and 5 counts of hydrogens (others: the last place), charge, ring, aromatic."""
    # Doubles from the start: a cast would go over a thousand places one by one.
    parts = [onehot_last(F.col("atomic_num"), range(1000), 0.0), onehot_last(F.col("degree"), range(6), 0.0), onehot_last(F.col("num_h"), range(5), 0.0)]
    flags = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("charge", "ring", "aromatic")))
    return atoms.select("graph_id", "node_id", F.concat(*parts, flags).alias("features"))


def atom_features_scaled(atoms: DataFrame) -> DataFrame:
    """``graph_id, node_id, features``: 115 numbers and the atom's 1-based place. Fractions of 8 or 4; partial charges that aren't finite are 0."""
    parts = [onehot_unk(F.col("atomic_num"), range(1, 101)), onehot_unk(F.col("hyb"), ATOM_CHOICES["hyb"])]
    fractions = [("num_h", 8), ("degree", 4), ("charge", 8), ("valence", 8), ("partial", 1), ("partial_h", 1), ("aromatic", 1), ("ring", 1)]
    numbers = F.array(*(scaled_atom(F.col(c), top) for c, top in fractions), F.col("node_id").cast("double"))
    return atoms.select("graph_id", "node_id", F.concat(F.concat(*parts).cast("array<double>"), numbers).alias("features"))


def bond_features_scaled(bonds: DataFrame) -> DataFrame:
    """``graph_id, src, dst, features``: 13 numbers, of them one-hot 4 types and 6 kinds of stereo (others: the last place), conjugated, aromatic, ring."""
    flags = F.array(*(F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("conjugated", "aromatic", "ring")))
    return bonds.select("graph_id", "src", "dst", F.concat(onehot_last(F.col("type"), BOND_TYPES), onehot_last(F.col("stereo"), SCALED_STEREO), flags).alias("features"))


def degree_onehot(edges: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """``node, degree, place``: features for nodes that have none, as the place of the one in a vector of ``most + 1``; larger degrees share the last."""
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    out = nodes.select("node").join(ends, "node", "left").fillna(0, ["degree"])
    return out.withColumn("place", F.col("degree") if most is None else F.least("degree", F.lit(most).cast("long")))


def adjacency(nodes: DataFrame, bonds: DataFrame, dummy: bool = False) -> DataFrame:
    """``graph_id, i, j``: both directions and the diagonal; ``dummy``: and a node 0 in each graph, joined with itself alone."""
    if dummy:
        nodes = nodes.select("graph_id", "node_id").unionByName(nodes.select("graph_id", F.lit(0).cast("long").alias("node_id")).distinct())
    both = bonds.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j")))).alias("x")).select("graph_id", "x.*")
    return both.unionByName(nodes.select("graph_id", F.col("node_id").alias("i"), F.col("node_id").alias("j")))


def atom_distances(nodes: DataFrame, coordinates: Sequence[str]) -> DataFrame:
    """``graph_id, i, j, distance`` of nodes in one graph, i < j."""
    a = nodes.select("graph_id", F.col("node_id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in coordinates))
    b = nodes.select("graph_id", F.col("node_id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in coordinates))
    total = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in coordinates), F.lit(0.0))
    return a.join(b, "graph_id").where("i < j").select("graph_id", "i", "j", F.sqrt(total).alias("distance"))


def hop_distances(nodes: DataFrame, bonds: DataFrame, most: int | None = None) -> DataFrame:
    """``graph_id, i, j, hops`` of all pairs that ``most`` hops join, by default of all that any number joins, each pair once.

    ``i`` is one of ``nodes``, ``j`` also an end that only bonds name. Graphs of few rows walk by bitsets (:mod:`gneiss.operators.hops`), a row
    each; larger ones by joins, breadth first in all at once. Rows with a null id or end are left out.
    """
    ends = bonds.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(False).alias("node"))
    items = nodes.select("graph_id", F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.lit(True).alias("node")).unionByName(ends).dropna()
    items = written(items)
    large = written(items.groupBy("graph_id").count().where(F.col("count") > hops.SMALL).select("graph_id"))
    if large.isEmpty():
        return hops.small_graphs(items, most)
    own = items.join(large, "graph_id", "left_semi")
    return hops.small_graphs(items.join(large, "graph_id", "left_anti"), most).unionByName(_hops_by_joins(own, most))


def _hops_by_joins(items: DataFrame, most: int | None) -> DataFrame:
    """A step from the pairs at one distance leads to the next, the same or the one before, so only those two are taken out."""
    bonds = items.where("not node").select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    near = written(adjacency(items.limit(0).withColumnRenamed("i", "node_id"), bonds).distinct())
    reached = written(items.where("node").select("graph_id", "i", "j", F.lit(0).alias("hops")).distinct())
    front, last = reached, reached.limit(0)
    k = 1
    while most is None or k <= most:
        step = front.select("graph_id", "i", F.col("j").alias("m")).join(near.select("graph_id", F.col("i").alias("m"), "j"), ["graph_id", "m"]).select("graph_id", "i", "j").distinct()
        known = front.unionByName(last).select("graph_id", "i", "j")
        last, front = front, written(step.join(known, ["graph_id", "i", "j"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        reached, k = reached.unionByName(front), k + 1
    return reached


def pad_batch(cells: DataFrame, n: int | None = None, batch: str | None = None) -> DataFrame:
    """``[batch,] graph_id, i, j, v`` on the full n x n grid of each graph, 0 where there is no cell.

    ``n`` is the largest place by default: with ``batch``, that of each batch by itself, so that a large graph pads only those that it is
    batched with. A graph belongs to one batch.
    """
    by = [batch] if batch else []
    keyed = cells.select(*by, "graph_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v")
    graphs = keyed.select(*by, "graph_id").distinct()
    if n is not None:
        graphs = graphs.withColumn("_n", F.lit(n))
    else:
        top = keyed.groupBy(*by).agg(F.max(F.greatest("i", "j")).alias("_n"))
        graphs = graphs.join(top, batch) if batch else graphs.join(F.broadcast(top))
    # A row of a graph's grid holds its cells; only rows are shuffled, not the grid.
    axis = F.sequence(F.lit(1), F.col("_n"))
    lines = graphs.withColumn("i", F.explode(axis))
    kept = keyed.groupBy(*by, "graph_id", "i").agg(F.collect_list(F.struct("j", F.coalesce("v", F.lit(0.0)).alias("v"))).alias("_c"))
    held = F.filter(F.coalesce("_c", F.array().cast("array<struct<j:int,v:double>>")), lambda c: c["j"].between(1, F.col("_n")))
    met = lines.join(kept, [*by, "graph_id", "i"], "left").select(*by, "graph_id", "i", "_n", held.alias("_c"))
    free = F.transform(F.array_except(axis, F.transform("_c", lambda c: c["j"])), lambda j: F.struct(j.alias("j"), F.lit(0.0).alias("v")))
    return met.select(*by, "graph_id", "i", F.explode(F.concat("_c", free)).alias("_x")).select(*by, "graph_id", "i", "_x.j", "_x.v")


def to_dense_batch(nodes: DataFrame, value: str, n: int) -> DataFrame:
    """``graph_id, values, mask``: the first n nodes' values, padded."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id"))
    cut = nodes.withColumn("_r", rank).where(F.col("_r") <= n)
    held = cut.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("_v"))
    fill = F.array_repeat(F.lit(0.0), F.lit(n) - F.size("_v"))
    return held.select("graph_id", F.concat("_v", fill).alias("values"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i <= F.size("_v")).cast("int")).alias("mask"))


def _refined(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Each node's key hashed with its neighbours' sorted keys."""
    around = near.join(nodes.select("graph_id", F.col("node_id").alias("j"), "key"), ["graph_id", "j"]).groupBy("graph_id", F.col("i").alias("node_id")).agg(F.sort_array(F.collect_list("key")).alias("_k"))
    return nodes.join(around, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.md5(F.concat_ws("|", "key", F.array_join(F.coalesce("_k", F.array().cast("array<string>")), ","))).alias("key"))


def circular_fp(nodes: DataFrame, bonds: DataFrame, key: str, radius: int = 2, bits: int = 2048, counts: bool = False) -> DataFrame:
    """``graph_id, bit[, n]``: hashed neighbourhoods of every radius, as bits or counts."""
    near = adjacency(nodes.limit(0), bonds)
    now = nodes.select("graph_id", "node_id", F.md5(F.col(key).cast("string")).alias("key"))
    out = now
    for _ in range(radius):
        now = _refined(now, near)
        out = out.unionByName(now)
    bit = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % bits).alias("bit")
    return out.select("graph_id", bit).groupBy("graph_id", "bit").agg(F.count("*").alias("n")) if counts else out.select("graph_id", bit).distinct()


def wl_key(nodes: DataFrame, bonds: DataFrame, key: str, rounds: int = 3) -> DataFrame:
    """``graph_id, wl``: refined keys of all nodes, sorted and hashed with the numbers of nodes; equal graphs have equal keys."""
    near = adjacency(nodes.limit(0), bonds)
    now = nodes.select("graph_id", "node_id", F.md5(F.col(key).cast("string")).alias("key"))
    for _ in range(rounds):
        now = _refined(now, near)
    return now.groupBy("graph_id").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.array_join(F.sort_array(F.collect_list("key")), ","))).alias("wl"))


def scaffold_atoms(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """Nodes that stay when those with at most one bond are peeled off, in all graphs at once, until nothing changes."""
    all_ = written(bonds.select("graph_id", "src", "dst"))

    def step(now: DataFrame) -> DataFrame:
        ends = now.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count("*").alias("d")).where("d > 1").select("graph_id", "node_id")
        kept = now.join(ends.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(ends.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
        return kept.select("graph_id", "src", "dst")

    left = until_settled(all_, step, lambda df: df.count())
    return left.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


_generators: dict[str, Callable[[str], Column]] = {}


def register_features(name: str):
    """Adds a generator: a function of a column's name that gives an array of numbers."""

    def add(f: Callable[[str], Column]) -> Callable[[str], Column]:
        _generators[name] = f
        return f

    return add


@register_features("characters")
def _characters(col: str) -> Column:
    return F.transform(F.array(*(F.lit(c) for c in "CNOSPF")), lambda c: (F.length(col) - F.length(F.replace(F.col(col), c, F.lit("")))).cast("double"))


@register_features("size")
def _size(col: str) -> Column:
    return F.array(F.length(col).cast("double"))


def features(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """``df`` and ``features``: the named generators' numbers end to end."""
    missing = [n for n in names if n not in _generators]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    return df.withColumn("features", F.concat(*(_generators[n](col) for n in names)))


def clusters(bonds: DataFrame, rings: DataFrame) -> DataFrame:
    """``graph_id, node_id, cluster``: each bond outside rings and each ring of ``rings(graph_id, ring, node_id)`` is a cluster."""
    member = lambda c: rings.select("graph_id", "ring", F.col("node_id").alias(c))
    inside = bonds.join(member("src"), ["graph_id", "src"]).join(member("dst"), ["graph_id", "ring", "dst"]).select("graph_id", "src", "dst").distinct()
    single = bonds.select("graph_id", "src", "dst").distinct().join(inside, ["graph_id", "src", "dst"], "left_anti")
    keyed = single.select("graph_id", F.struct(F.lit(0).cast("long").alias("k"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("key"), F.explode(F.array("src", "dst")).alias("node_id"))
    keyed = keyed.unionByName(rings.select("graph_id", F.struct(F.lit(1).cast("long").alias("k"), F.col("ring").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("key"), "node_id"))
    return keyed.withColumn("cluster", F.dense_rank().over(Window.partitionBy("graph_id").orderBy("key")) - 1).select("graph_id", "node_id", "cluster")
