"""Many small graphs: one for each order, its lines as nodes, chained by number; packed forms of them; attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.catalog.base import ORDER_GRAPHS, Found, order_graphs, spread, table
from gneiss.operators import explain as X
from gneiss.operators import features as E
from gneiss.operators import messages as M
from gneiss.plans.rank import with_index
from gneiss.sources import sinks, tables

found = query = Found()
O = ORDER_GRAPHS  # noqa: E741
BOTH = "both_ways AS (SELECT graph_id, src AS i, dst AS j FROM bonds UNION ALL SELECT graph_id, dst, src FROM bonds)"


@query("WITH i AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS place, l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT l_orderkey AS graph_id, place, src, dst FROM i")
def src6_unpack_graphs(spark, d):
    """The flat lines and the number of lines of each order give the orders back."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    flat = with_index(items, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name="place").select("place", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return tables.unpack_graphs(flat, items.groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("n_edges")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_totalprice AS node_price FROM orders")
def src7_attach_positional(spark, d):
    base = with_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", name="place")
    return tables.attach_positional(base.select("place", "o_orderkey"), {"node_price": base.select("place", F.col("o_totalprice").alias("value"))}).select("o_orderkey", "place", "node_price")


@query("SELECT o_orderkey AS record_id, o_totalprice, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey")
def src4_join_properties(spark, d):
    mols = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), "o_totalprice", F.col("o_custkey").alias("key"))
    props = table(spark, d, "customer").select(F.concat(F.lit("x_"), "c_custkey").alias("mol_id"), "c_acctbal")
    return tables.join_properties(mols, props, "key", "mol_id").select("record_id", "o_totalprice", "c_acctbal")


@query("SELECT doc_id, 'train' AS role FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'valid' FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'test' FROM documents WHERE lang NOT IN ('en', 'de')")
def src10_union_splits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return tables.union_splits({"train": docs.where("lang = 'en'"), "valid": docs.where("lang = 'de'"), "test": docs.where("lang not in ('en', 'de')")}).select("doc_id", "role")


@query("WITH e AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings) SELECT vec_id, pred::BIGINT AS pred, label FROM e")
def snk3_oof_rows(spark, d):
    return sinks.oof_rows(table(spark, d, "embeddings"), "vec_id", "embedding", "label", True)


@query(f"WITH {O}, g AS (SELECT graph_id, node_id, row_number() OVER (ORDER BY graph_id, node_id) AS number FROM nodes), b AS (SELECT x.graph_id, a.number AS p, b.number AS q FROM bonds x JOIN g a ON a.graph_id = x.graph_id AND a.node_id = src JOIN g b ON b.graph_id = x.graph_id AND b.node_id = dst) SELECT graph_id, p AS a, q AS b FROM b UNION ALL SELECT graph_id, q, p FROM b")
def snk5_tu_edges(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return sinks.tu_tables(nodes, bonds)[1]


@query("SELECT NULL::BIGINT AS id WHERE false")
def snk6_vocab_gaps(spark, d):
    return sinks.vocab_gaps(with_index(table(spark, d, "part").select(F.col("p_name").alias("token")).distinct(), "token", name="id"))


@query("SELECT p_partkey, list_transform(range(5), lambda i: (i = CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#21' THEN 2 WHEN 'Brand#33' THEN 3 ELSE 4 END)::INT) AS v, list_transform(range(1, 8), lambda i: (i = CASE WHEN p_size % 8 = 0 THEN 7 ELSE p_size % 8 END)::INT) AS w, list_transform(range(3), lambda i: (i = CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END)::INT) AS u FROM part")
def fea1_fea2_fea3_onehot(spark, d):
    return table(spark, d, "part").select("p_partkey", E.onehot_unk(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#21", "Brand#33"]).alias("v"), E.onehot_label(F.col("p_size") % 8, 7).alias("w"), E.onehot_last(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#21"]).alias("u"))


def atoms(spark, d, *more):
    """Lines as atoms: numbers of the right kinds from their columns."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node_id"), F.col("l_quantity").cast("int").alias("atomic_num"), (F.col("l_linenumber") % 8).alias("degree"), (F.col("l_linenumber") - 3).alias("charge"),
        (F.col("l_suppkey") % 5).cast("int").alias("chirality"), (F.col("l_partkey") % 6).cast("int").alias("num_h"), F.concat(F.lit("SP"), F.col("l_linenumber")).alias("hyb"), (F.col("l_returnflag") == "A").alias("aromatic"), F.col("l_tax").alias("mass"), *more,
    )


def _at(value: str, choices: list) -> str:
    known = ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in choices)
    return f"coalesce(list_position([{known}], {value}), {len(choices) + 1})"


@query(f"""SELECT l_orderkey AS graph_id, l_linenumber AS node_id, round(list_sum(list_transform(range(1, 134), lambda i: i * CASE WHEN i IN (a, b + 101, c + 108, e + 114, f + 119, g + 125) THEN 1.0 WHEN i = 132 THEN h WHEN i = 133 THEN m ELSE 0.0 END)), 6) AS code FROM (
SELECT l_orderkey, l_linenumber, {_at('l_quantity::INT', list(range(1, 101)))} AS a, {_at('l_linenumber % 8', [0, 1, 2, 3, 4, 5])} AS b, {_at('l_linenumber - 3', [-1, -2, 1, 2, 0])} AS c, {_at('(l_suppkey % 5)::INT', [0, 1, 2, 3])} AS e, {_at('(l_partkey % 6)::INT', [0, 1, 2, 3, 4])} AS f, {_at("'SP' || l_linenumber", ["SP", "SP2", "SP3", "SP3D", "SP3D2"])} AS g, (l_returnflag = 'A')::INT AS h, l_tax * 0.01 AS m FROM lineitem)""")
def fea4_atom_features(spark, d):
    """The vectors' position-weighted sums, which tell all 133 places apart."""
    v = E.atom_features(atoms(spark, d))
    code = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("graph_id", "node_id", F.round(code, 6).alias("code"))


@query(f"""WITH {O}, e AS (SELECT graph_id, src AS node_id FROM bonds UNION ALL SELECT graph_id, dst FROM bonds), g AS (SELECT graph_id, node_id, count(*) AS degree FROM e GROUP BY ALL)
SELECT graph_id, node_id, [CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END] || list_transform(range(2, 19), lambda i: CASE WHEN i = CASE WHEN label = 0 THEN 18 ELSE label END THEN 1.0 ELSE 0.0 END) || [x, z, coalesce(degree, 0)::DOUBLE] AS x FROM nodes LEFT JOIN g USING (graph_id, node_id)""")
def fea9_node_x(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return E.node_x(nodes, bonds, 18, ["x", "z"], True)


DIRECTED = f"{O}, nb AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS n FROM bonds), dbonds AS (SELECT graph_id, 2 * n AS bond_id, src, dst, 2 * n + 1 AS rev_id FROM nb UNION ALL SELECT graph_id, 2 * n + 1, dst, src, 2 * n FROM nb)"


@query(f"WITH {DIRECTED} SELECT graph_id, bond_id::INT AS bond_id, src, dst, rev_id::INT AS rev_id FROM dbonds")
def fea10_fea11_directed_bonds(spark, d):
    return E.directed_bonds(order_graphs(spark, d)[1])


@query(f"WITH {O}, s AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL) SELECT graph_id, n, (sum(n) OVER (ORDER BY graph_id) - n + 1)::BIGINT AS start FROM s")
def fea12_batch_offsets(spark, d):
    return E.batch_offsets(order_graphs(spark, d)[0].groupBy("graph_id").agg(F.count("*").alias("n")))


@query(f"WITH {DIRECTED} SELECT graph_id, dst AS node_id, list(bond_id::INT ORDER BY bond_id) AS bonds FROM dbonds GROUP BY ALL")
def fea13_incoming_bonds(spark, d):
    return E.incoming_bonds(E.directed_bonds(order_graphs(spark, d)[1]))


@query(f"WITH {DIRECTED} SELECT a.graph_id, a.bond_id::INT AS bond_id, b.bond_id::INT AS from_id FROM dbonds a JOIN dbonds b ON a.graph_id = b.graph_id AND a.src = b.dst AND b.bond_id <> a.rev_id")
def fea14_bond_neighbors(spark, d):
    return E.bond_neighbors(E.directed_bonds(order_graphs(spark, d)[1]))


@query(f"WITH {O}, {BOTH} SELECT graph_id, i, j FROM both_ways UNION ALL SELECT graph_id, node_id, node_id FROM nodes")
def fea15_adjacency(spark, d):
    return E.adjacency(*order_graphs(spark, d))


@query(f"WITH {O} SELECT a.graph_id, a.node_id AS i, b.node_id AS j, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id")
def fea16_atom_distances(spark, d):
    return spread(E.atom_distances(order_graphs(spark, d)[0], ["x", "z"]))


@query(f"WITH {O} SELECT a.graph_id, a.node_id AS i, b.node_id AS j, abs(a.node_id - b.node_id)::INT AS hops FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id")
def fea17_hop_distances(spark, d):
    """Along the chain of an order's lines the number of hops is the difference of their numbers."""
    return E.hop_distances(*order_graphs(spark, d))


@query(f"WITH {O}, {BOTH}, g AS (SELECT graph_id, i::INT AS i, j::INT AS j FROM (SELECT DISTINCT graph_id FROM bonds), (SELECT unnest(range(1, m + 1)) AS i FROM (SELECT max(dst) AS m FROM bonds)) a, (SELECT unnest(range(1, m + 1)) AS j FROM (SELECT max(dst) AS m FROM bonds)) b) SELECT graph_id, i, j, CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM g LEFT JOIN both_ways b USING (graph_id, i, j)")
def fea18_pad_batch(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return E.pad_batch(E.adjacency(nodes.limit(0), bonds).withColumn("v", F.lit(1.0)))


@query(f"WITH {O}, {BOTH}, m AS (SELECT graph_id % 1000 AS batch, max(dst) AS m FROM bonds GROUP BY ALL), g AS (SELECT DISTINCT graph_id, graph_id % 1000 AS batch FROM bonds), c AS (SELECT batch, graph_id, unnest(range(1, m + 1)) AS i, m FROM g JOIN m USING (batch)), k AS (SELECT batch, graph_id, i, unnest(range(1, m + 1)) AS j FROM c) SELECT batch::BIGINT AS batch, graph_id, k.i::INT AS i, k.j::INT AS j, CASE WHEN b.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS v FROM k LEFT JOIN both_ways b USING (graph_id, i, j)")
def fea18_pad_by_batch(spark, d):
    """Each batch of graphs padded to its own largest."""
    nodes, bonds = order_graphs(spark, d)
    return E.pad_batch(E.adjacency(nodes.limit(0), bonds).withColumn("v", F.lit(1.0)).withColumn("batch", F.col("graph_id") % 1000), batch="batch")


@query(f"WITH {O}, r AS (SELECT graph_id, x, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) AS r FROM nodes), h AS (SELECT graph_id, list(x ORDER BY r) AS v FROM r WHERE r <= 4 GROUP BY graph_id) SELECT graph_id, v || list_transform(range(4 - len(v)), lambda i: 0.0::DOUBLE) AS values, list_transform(range(1, 5), lambda i: (i <= len(v))::INT) AS mask FROM h")
def fea19_dense_batch(spark, d):
    return E.to_dense_batch(order_graphs(spark, d)[0], "x", 4)


REFINED = f"""{O}, {BOTH}, k0 AS (SELECT graph_id, node_id, md5(label::VARCHAR) AS key FROM nodes),
a0 AS (SELECT b.graph_id, b.i AS node_id, array_to_string(list(k.key ORDER BY k.key), ',') AS s FROM both_ways b JOIN k0 k ON k.graph_id = b.graph_id AND k.node_id = b.j GROUP BY ALL),
k1 AS (SELECT graph_id, node_id, md5(key || '|' || coalesce(s, '')) AS key FROM k0 LEFT JOIN a0 USING (graph_id, node_id))"""


@query(f"WITH {REFINED}, every AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1) SELECT graph_id, ('0x' || substr(key, 1, 8))::BIGINT % 512 AS bit, count(*) AS n FROM every GROUP BY ALL")
def fea20_fea21_circular_fp(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return E.circular_fp(nodes, bonds, "label", 1, 512, True)


@query(f"WITH {REFINED} SELECT graph_id, md5(count(*) || ':' || array_to_string(list(key ORDER BY key), ',')) AS wl FROM k1 GROUP BY graph_id")
def fea25_wl_key(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return E.wl_key(nodes, bonds, "label", 1)


@query("SELECT p_partkey, list_transform(['C', 'N', 'O', 'S', 'P', 'F'], lambda c: (length(p_type) - length(replace(p_type, c, '')))::DOUBLE) || [length(p_type)::DOUBLE] AS features FROM part")
def fea22_udx2_registered_features(spark, d):
    return E.features(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["characters", "size"]).select("p_partkey", "features")


@query(f"""WITH {O}, closed AS (SELECT graph_id, src, dst FROM bonds UNION ALL SELECT graph_id, 1, max(node_id) FROM nodes WHERE graph_id % 2 = 0 GROUP BY graph_id HAVING max(node_id) > 2) SELECT graph_id, node_id FROM nodes WHERE graph_id IN (SELECT graph_id FROM nodes WHERE graph_id % 2 = 0 GROUP BY graph_id HAVING max(node_id) > 2)""")
def fea24_scaffold_atoms(spark, d):
    """Chains peel away; orders with even keys are closed to rings, which stay."""
    nodes, bonds = order_graphs(spark, d)
    ring = nodes.where("graph_id % 2 = 0").groupBy("graph_id").agg(F.max("node_id").alias("dst")).where("dst > 2").select("graph_id", F.lit(1).cast("long").alias("src"), "dst")
    return E.scaffold_atoms(nodes, bonds.unionByName(ring))


@query(f"WITH {O}, {BOTH} SELECT n.graph_id, n.node_id, [round(coalesce(sum(m.x), 0), 6), round(coalesce(sum(m.z), 0), 6)] AS x FROM nodes n LEFT JOIN both_ways b ON b.graph_id = n.graph_id AND b.i = n.node_id LEFT JOIN nodes m ON m.graph_id = b.graph_id AND m.node_id = b.j GROUP BY n.graph_id, n.node_id")
def msg1_propagate(spark, d):
    nodes, bonds = order_graphs(spark, d)
    out = M.propagate(E.node_x(nodes, bonds, 0, ["x", "z"]), bonds, "sum")
    return out.select("graph_id", "node_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query(f"WITH {O}, {BOTH}, a AS (SELECT graph_id, i, j FROM both_ways UNION ALL SELECT graph_id, node_id, node_id FROM nodes) SELECT a.graph_id, a.i AS node_id, [round(avg(n.x), 6)] AS x FROM a JOIN nodes n ON n.graph_id = a.graph_id AND n.node_id = a.j GROUP BY ALL")
def msg2_propagate_norm(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return M.propagate_norm(E.node_x(nodes, bonds, 0, ["x"]), bonds).select("graph_id", "node_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query(f"WITH {DIRECTED}, i AS (SELECT graph_id, dst AS src, sum(bond_id + 1.0) AS a FROM dbonds GROUP BY ALL) SELECT b.graph_id, b.bond_id::INT AS bond_id, (coalesce(a, 0) - (rev_id + 1))::DOUBLE AS m FROM dbonds b LEFT JOIN i ON i.graph_id = b.graph_id AND i.src = b.src")
def msg5_bond_message_step(spark, d):
    b = E.directed_bonds(order_graphs(spark, d)[1])
    return M.bond_message_step(b, b.select("graph_id", "bond_id", (F.col("bond_id") + 1.0).alias("m")))


@query(f"WITH {DIRECTED} SELECT graph_id, bond_id::INT AS bond_id, ((bond_id + rev_id) / 2)::DOUBLE AS m FROM dbonds")
def msg6_average_reverse(spark, d):
    b = E.directed_bonds(order_graphs(spark, d)[1])
    return M.average_reverse(b, b.select("graph_id", "bond_id", F.col("bond_id").cast("double").alias("m")))


@query("WITH " + O + " SELECT o_orderkey AS graph_id, CASE WHEN count(graph_id) = 0 THEN [0.0::DOUBLE] ELSE [round(avg(x), 6)] END AS x FROM orders LEFT JOIN nodes ON graph_id = o_orderkey GROUP BY ALL")
def msg7_msg8_readout(spark, d):
    nodes, bonds = order_graphs(spark, d)
    out = M.readout(table(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id")), E.node_x(nodes, bonds, 0, ["x"]), "mean")
    return out.select("graph_id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


@query(f"WITH {O}, r AS (SELECT graph_id, x, z, row_number() OVER (PARTITION BY graph_id ORDER BY z DESC, node_id) AS r FROM nodes), h AS (SELECT graph_id, flatten(list([x, z] ORDER BY r)) AS v FROM r WHERE r <= 3 GROUP BY graph_id) SELECT graph_id, v || list_transform(range(6 - len(v)), lambda i: 0.0::DOUBLE) AS x FROM h")
def msg9_sort_pool(spark, d):
    nodes, bonds = order_graphs(spark, d)
    return M.sort_pool(E.node_x(nodes, bonds, 0, ["x", "z"]), 3)


@query("SELECT vec_id, round(list_max(list_transform(embedding::DOUBLE[], lambda x: exp(x))) / list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x))), 6) AS top, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 2 * x)), 5) AS twice FROM embeddings")
def msg10_msg11_jump_softmax(spark, d):
    v = F.col("embedding").cast("array<double>")
    total = F.aggregate(M.jump([v, v], "sum"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(M.softmax(v)), 6).alias("top"), F.round(total, 5).alias("twice"))


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT i, avg(x) AS p FROM e WHERE label < 5 GROUP BY i), b AS (SELECT i, avg(x) AS q FROM e WHERE label >= 5 GROUP BY i) SELECT round(sqrt(avg((p - q) ** 2) + 1e-6), 6) AS gap FROM a JOIN b USING (i)")
def msg14_mean_gap(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return spread(M.mean_gap(v.where("label < 5"), v.where("label >= 5")))


ATTR = f"{O}, attr AS (SELECT graph_id, node_id, (label = 0)::INT AS truth, round(z * 9 + x / 500, 4) AS score FROM nodes)"


def attributions(spark, d):
    return order_graphs(spark, d)[0].select("graph_id", "node_id", (F.col("label") == 0).cast("int").alias("truth"), F.round(F.col("z") * 9 + F.col("x") / 500, 4).alias("score"))


@query(f"WITH {ATTR}, s AS (SELECT graph_id, node_id, score FROM attr UNION ALL SELECT graph_id, src, 0.5 * src FROM bonds UNION ALL SELECT graph_id, dst, 0.5 * src FROM bonds) SELECT graph_id, node_id, round(sum(score), 6) AS score FROM s GROUP BY ALL")
def xpl1_merge_bond_scores(spark, d):
    bonds = order_graphs(spark, d)[1].withColumn("score", F.col("src").cast("double"))
    return spread(X.merge_bond_scores(attributions(spark, d), bonds))


@query(f"""WITH {ATTR}, auc AS (SELECT a.graph_id, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM attr a JOIN attr b ON a.graph_id = b.graph_id AND a.truth = 1 AND b.truth = 0 GROUP BY ALL),
m AS (SELECT graph_id, avg((truth = (score > 0.5)::INT)::INT) AS acc, coalesce(2 * sum((truth = 1 AND score > 0.5)::INT) / nullif(sum(truth) + sum((score > 0.5)::INT), 0), 0) AS f1, coalesce(sum((truth = 1 AND score > 0.5)::INT) / nullif(sum((score > 0.5)::INT), 0), 0) AS prec FROM attr GROUP BY graph_id)
SELECT (SELECT round(avg(auc), 6) FROM auc) AS auc, round(avg(acc), 6) AS accuracy, round(avg(f1), 6) AS f1, round(avg(prec), 6) AS precision FROM m""")
def xpl2_attribution_metrics(spark, d):
    return spread(X.attribution_metrics(attributions(spark, d)))


@query(f"""WITH {ATTR}, t AS (SELECT k / 100 AS t FROM range(1, 100) r(k)), g AS (SELECT t, graph_id, avg((truth = (score > t)::INT)::INT) AS a FROM attr, t GROUP BY ALL), m AS (SELECT t, round(avg(a), 9) AS a FROM g GROUP BY t) SELECT round(median(t), 6) AS threshold, round(max(a), 6) AS accuracy FROM m WHERE a = (SELECT max(a) FROM m)""")
def xpl4_best_threshold(spark, d):
    return spread(X.best_threshold(attributions(spark, d)))


@query(f"WITH {ATTR}, k AS (SELECT graph_id, node_id, CASE WHEN score > 0.6 THEN 1 WHEN score < -0.6 THEN -1 ELSE 0 END AS mark FROM attr) SELECT b.graph_id, src, dst, CASE WHEN x.mark = y.mark THEN x.mark ELSE 0 END AS mark FROM bonds b JOIN k x ON x.graph_id = b.graph_id AND x.node_id = src JOIN k y ON y.graph_id = b.graph_id AND y.node_id = dst")
def xpl7_mark_bonds(spark, d):
    return X.mark_bonds(order_graphs(spark, d)[1], X.mark_atoms(attributions(spark, d), 0.6))


@query(f"WITH {O} SELECT graph_id, node_id, round(('0x' || substr(md5('4:' || graph_id || ':' || node_id), 1, 12))::BIGINT / {16**12}.0::DOUBLE, 9) AS score FROM nodes")
def xpl8_random_scores(spark, d):
    return spread(X.random_scores(order_graphs(spark, d)[0], 4), 9)


WL = "".join(
    f"""a{k} AS (SELECT e.f, e.i, array_to_string(list(w.key ORDER BY w.key), ',') AS s FROM near e JOIN w{k} w ON w.f = e.f AND w.i = e.j GROUP BY ALL),
w{k + 1} AS (SELECT f, i, md5(key || '|' || coalesce(s, '')) AS key FROM w{k} LEFT JOIN a{k} USING (f, i)), """
    for k in range(3)
)


@query(f"""WITH {O}, hit AS (SELECT graph_id, node_id, label FROM nodes WHERE abs(z) > 0.05),
runs AS (SELECT *, graph_id || ':' || (node_id - row_number() OVER (PARTITION BY graph_id ORDER BY node_id)) AS f FROM hit),
big AS (SELECT f, node_id AS i, label FROM runs WHERE f IN (SELECT f FROM runs GROUP BY f HAVING count(*) > 1)),
near AS (SELECT a.f, a.i, b.i AS j FROM big a JOIN big b ON a.f = b.f AND abs(a.i - b.i) = 1), w0 AS (SELECT f, i, md5(label::VARCHAR) AS key FROM big),
{WL}k AS (SELECT f, md5(count(*) || ':' || array_to_string(list(key ORDER BY key), ',')) AS wl FROM w3 GROUP BY f)
SELECT wl, count(*) AS n FROM k GROUP BY wl ORDER BY n DESC, wl LIMIT 10""")
def xpl5_top_fragments(spark, d):
    """Runs of discounted lines, by the flags along them: lines of an order are a chain, so its parts are runs."""
    nodes, bonds = order_graphs(spark, d)
    return X.top_fragments(nodes.select("graph_id", "node_id", "label", F.col("z").alias("score")), bonds, "label", 0.05, 10)


@query(f"WITH {ATTR}, k AS (SELECT DISTINCT graph_id FROM attr), p AS (SELECT graph_id FROM k UNION SELECT graph_id + 1 FROM k), s AS (SELECT * FROM attr WHERE graph_id IN (SELECT graph_id FROM p)), m AS (SELECT graph_id, avg((truth = (score > 0.5)::INT)::INT) AS acc FROM s GROUP BY graph_id) SELECT round(avg(acc), 6) AS accuracy FROM m")
def xpl6_evaluate_cliffs(spark, d):
    """Neighbouring orders as pairs of similar structures."""
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_1")).distinct()
    pairs = keys.withColumn("graph_2", F.col("graph_1") + 1)
    return spread(X.evaluate_cliffs(pairs, attributions(spark, d)).select("accuracy"))


@query("WITH r AS (SELECT l_orderkey AS graph_id, l_linenumber AS candidate, l_quantity AS size, l_discount AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_discount DESC, l_linenumber) AS rank FROM lineitem WHERE l_quantity <= 30 AND l_discount >= 0.02) SELECT graph_id, candidate, size, score, rank::INT AS rank FROM r WHERE rank <= 2")
def xpl11_pick_rationales(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("candidate"), F.col("l_quantity").alias("size"), F.col("l_discount").alias("score"))
    return X.pick_rationales(df, 30, 0.02, 2)


@query("WITH b AS (SELECT l_orderkey AS graph_id, l_partkey % 7 AS src, l_suppkey % 7 AS dst, l_linenumber AS block, avg(l_tax) AS w FROM lineitem GROUP BY ALL) SELECT graph_id, src, dst, round(avg(w), 6) AS weight FROM b GROUP BY ALL")
def xpl12_reduce_attention(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), (F.col("l_partkey") % 7).alias("src"), (F.col("l_suppkey") % 7).alias("dst"), F.col("l_linenumber").alias("block"), F.col("l_tax").alias("weight"))
    return spread(X.reduce_attention(df))


@query("WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem WHERE l_discount > 0) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE r = 1")
def xpl13_unique_rationales(spark, d):
    df = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return X.unique_rationales(df, "l_partkey", "l_discount", "o").select("l_partkey", "l_orderkey", "l_linenumber")


@query(f"""WITH {O}, big AS (SELECT graph_id FROM nodes GROUP BY graph_id HAVING max(node_id) > 3), rings AS (SELECT graph_id, 1 AS ring, node_id FROM nodes JOIN big USING (graph_id) WHERE node_id <= 3),
k AS (SELECT b.graph_id, 0 AS k, src AS a, dst AS b, unnest([src, dst]) AS node_id FROM bonds b WHERE NOT (graph_id IN (SELECT graph_id FROM big) AND dst <= 3) UNION ALL SELECT graph_id, 1, ring, 0, node_id FROM rings)
SELECT graph_id, node_id, (dense_rank() OVER (PARTITION BY graph_id ORDER BY k, a, b) - 1)::INT AS cluster FROM k""")
def fea26_clusters(spark, d):
    """The first three lines of longer orders as a ring."""
    nodes, bonds = order_graphs(spark, d)
    big = nodes.groupBy("graph_id").agg(F.max("node_id").alias("m")).where("m > 3").select("graph_id")
    rings = nodes.where("node_id <= 3").join(big, "graph_id", "left_semi").select("graph_id", F.lit(1).alias("ring"), "node_id")
    return E.clusters(bonds, rings)


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM e GROUP BY i)) SELECT p_partkey AS node, round(list_sum(coalesce(x.embedding::DOUBLE[], m.v)), 5) AS total FROM part LEFT JOIN embeddings x ON vec_id = p_partkey, m")
def msg13_fill_unseen(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    out = M.fill_unseen(table(spark, d, "part").select(F.col("p_partkey").alias("node")), v)
    return out.select("node", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
