"""Big graphs, link prediction and block models over edges that Spark derives from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.catalog.base import PART_EDGES, SUPPLY_EDGES, Found, part_edges, spread, supply_edges, table
from gneiss.operators import blocks as B
from gneiss.operators import graphs as G
from gneiss.operators import likelihoods as L
from gneiss.operators import nearest as N
from gneiss.operators import sampling, splits
from gneiss.plans.store import written

found = query = Found()
NEAR = "near AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"
P, S = f"{PART_EDGES}, {NEAR}", f"{SUPPLY_EDGES}, {NEAR}"


def nation_part(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("block"))


NATION = "part AS (SELECT s_suppkey AS node, s_nationkey AS block FROM supplier)"


@query(f"""WITH {PART_EDGES}, pairs AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst), r AS (SELECT *, row_number() OVER (ORDER BY md5('4:' || src || ':' || dst), src, dst) - 1 AS i, count(*) OVER () AS n FROM pairs)
SELECT src, dst, CASE WHEN i < floor(n * 0.05) THEN 'valid' WHEN i < floor(n * 0.05) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS role FROM r""")
def spl14_split_edges(spark, d):
    return splits.split_edges(part_edges(spark, d), 0.05, 0.1, 4)


@query(f"WITH {PART_EDGES} SELECT src, dst, k, (('0x' || substr(md5('1:' || src || ':' || dst || ':' || k), 1, 12))::BIGINT % 2000)::BIGINT AS neg FROM edges, (SELECT unnest([1, 2])::INT AS k)")
def smp6_neg_local(spark, d):
    return sampling.neg_local(part_edges(spark, d).select("src", "dst"), 2000, 2, 1)


@query(f"""WITH {SUPPLY_EDGES}, n AS (SELECT src, dst FROM edges) SELECT 0 AS copy, row_number() OVER (ORDER BY src, dst) - 1 AS place, src, dst FROM n
UNION ALL SELECT 1, row_number() OVER (ORDER BY md5('3:1:' || src || ':' || dst), src, dst) - 1, src, dst FROM n""")
def smp5_neg_permuted(spark, d):
    return sampling.neg_permuted(supply_edges(spark, d), 2, 3)


@query("""SELECT l_orderkey AS src, l_partkey AS dst, 1 AS label FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_partkey, 0 FROM lineitem WHERE l_linenumber > 1""")
def smp7_pos_neg_pairs(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pos = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    stored = items.where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("src")).agg(F.collect_list("l_partkey").alias("target_node_neg"))
    return sampling.pos_neg_pairs(pos, stored)


@query(f"""WITH {PART_EDGES}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node), s AS (SELECT *, pow(degree, 0.75) / (SELECT sum(pow(degree, 0.75)) FROM g) AS share FROM g)
SELECT node, degree, round(share, 9) AS share, round(sum(share) OVER (ORDER BY node), 6) AS upto FROM s""")
def smp8_neg_distribution(spark, d):
    return sampling.neg_distribution(part_edges(spark, d)).select("node", "degree", F.round("share", 9).alias("share"), F.round("upto", 6).alias("upto"))


@query()
def smp8_draw_nodes(spark, d):
    """Checked by properties: drawn nodes follow their shares."""
    return sampling.draw_nodes(part_edges(spark, d), 5000)


@query(f"WITH {PART_EDGES}, i AS (SELECT src, dst, w, row_number() OVER (ORDER BY src, dst) - 1 AS o FROM edges) SELECT 2 * o AS place, src, dst, w FROM i UNION ALL SELECT 2 * o + 1, dst, src, w FROM i")
def grf1_add_inverse(spark, d):
    from gneiss.plans.rank import with_index

    return G.add_inverse(with_index(part_edges(spark, d).select("src", "dst", "w"), "src", "dst", name="o"), "o").select("place", "src", "dst", "w")


@query(f"WITH {PART_EDGES} SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst) GROUP BY ALL")
def grf2_grf3_undirected(spark, d):
    return G.to_undirected(part_edges(spark, d))


@query(f"WITH {PART_EDGES}, g AS (SELECT src, sum(w) AS d FROM edges GROUP BY src) SELECT e.src, e.dst, round(coalesce(w / sqrt(a.d * b.d), 0), 6) AS w FROM edges e LEFT JOIN g a ON a.src = e.src LEFT JOIN g b ON b.src = e.dst")
def grf5_normalize_weights(spark, d):
    return spread(G.normalize_weights(part_edges(spark, d)))


@query(f"WITH {PART_EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT src, dst, w::DOUBLE AS w FROM edges WHERE src <> dst UNION ALL SELECT node, node, 1.0::DOUBLE FROM n")
def grf6_set_loops(spark, d):
    e = part_edges(spark, d)
    return G.set_loops(e, G.nodes_of(e))


@query(f"WITH {P}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) // 2 FROM near)::BIGINT AS n_edges, round((SELECT count(*) FROM near) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 6) AS density")
def grf7_graph_stats(spark, d):
    return spread(G.graph_stats(part_edges(spark, d)))


@query(f"WITH {PART_EDGES}, f AS (SELECT src AS node, 1 AS o, 0 AS i, w FROM edges UNION ALL SELECT dst, 0, 1, w FROM edges) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree, sum(w)::BIGINT AS strength FROM f GROUP BY node")
def grf8_degrees(spark, d):
    return G.degrees(part_edges(spark, d))


@query(f"""WITH {S}, hub AS (SELECT src AS node FROM near GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), one AS (SELECT DISTINCT dst AS node FROM near JOIN hub ON src = node)
SELECT node, 0 AS dist FROM hub UNION ALL SELECT node, 1 FROM one WHERE node NOT IN (SELECT node FROM hub)""")
def grf10_anchor_ball(spark, d):
    return G.anchor_ball(supply_edges(spark, d), 1)


@query(f"WITH {P} SELECT a.src AS a, b.src AS b, count(*) AS common FROM near a JOIN near b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 3")
def grf11_common_neighbors(spark, d):
    return G.wedge_counts(part_edges(spark, d), 3)


@query(f"""WITH {S}, g AS (SELECT src AS node, count(*) AS d FROM near GROUP BY src), c AS (SELECT a.src AS a, b.src AS b, count(*) AS k FROM near a JOIN near b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL),
s AS (SELECT a, b, k / (x.d + y.d - k) AS similarity FROM c JOIN g x ON x.node = a JOIN g y ON y.node = b) SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= (SELECT quantile_cont(similarity, 0.5) FROM s)""")
def grf12_jaccard(spark, d):
    return spread(G.jaccard(supply_edges(spark, d), 0.5))


@query(f"""WITH {P}, g AS (SELECT src AS node, count(*) AS d FROM near GROUP BY src), c AS (SELECT a.src AS a, b.src AS b, count(*) AS k FROM near a JOIN near b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL)
SELECT a, b, round(k / (x.d + y.d - k), 6) AS similarity FROM c JOIN g x ON x.node = a JOIN g y ON y.node = b WHERE k >= 0.1 * (x.d + y.d - k)""")
def grf12_jaccard_join(spark, d):
    return spread(G.jaccard_join(part_edges(spark, d), 0.1))


@query(f"""WITH {S}, a2 AS (SELECT a.src, b.dst, count(*) AS n FROM near a JOIN near b ON a.dst = b.src GROUP BY ALL), a3 AS (SELECT a.src, b.dst, sum(n) AS n FROM a2 a JOIN near b ON a.dst = b.src GROUP BY ALL)
SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, 0.001::DOUBLE AS w FROM near UNION ALL SELECT src, dst, n * 0.001::DOUBLE ** 2 FROM a2 UNION ALL SELECT src, dst, n * 0.001::DOUBLE ** 3 FROM a3) GROUP BY ALL""")
def grf13_katz(spark, d):
    return spread(G.katz(supply_edges(spark, d), 0.001, 3))


def _lp(rounds: int) -> str:
    parts = [P, "l0 AS (SELECT DISTINCT src AS node, src AS block FROM near)"]
    for k in range(1, rounds + 1):
        parts.append(f"v{k} AS (SELECT src AS node, block, count(*) AS n FROM near JOIN l{k - 1} ON node = dst GROUP BY src, block), l{k} AS (SELECT node, arg_max(block, (n, -block)) AS block FROM v{k} GROUP BY node)")
    return "WITH " + ", ".join(parts) + f" SELECT node, block FROM l{rounds}"


@query(_lp(3))
def grf14_label_propagation(spark, d):
    return G.label_propagation(part_edges(spark, d), 3)


@query()
def grf15_louvain(spark, d):
    """Checked by modularity in the tests."""
    return G.louvain(part_edges(spark, d))


@query()
def grf16_sbm28_spectral(spark, d):
    return G.spectral(part_edges(spark, d), 4)


@query(f"WITH {NATION} SELECT a.node AS a, b.node AS b FROM part a JOIN part b ON a.block = b.block AND a.node < b.node")
def grf17_same_group_pairs(spark, d):
    return G.same_group_pairs(nation_part(spark, d))


@query(f"WITH {P} SELECT a.src AS a, b.src AS b FROM near a JOIN near b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 4")
def grf18_treatment(spark, d):
    return G.treatment(part_edges(spark, d), "common_neighbors", 4)


EMB = "v AS (SELECT vec_id AS node, label AS block, embedding::DOUBLE[] AS v FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("block"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {EMB}, p AS (SELECT a.node AS a, b.node AS b, list_distance(a.v, b.v) AS distance FROM v a JOIN v b ON a.node <> b.node), r AS (SELECT a, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank, b, distance FROM p) SELECT a, rank::INT AS rank, b, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def grf20_grf22_knn(spark, d):
    return spread(N.knn(vectors(spark, d), 5))


@query(f"WITH {EMB}, p AS (SELECT list_distance(a.v, b.v) AS x FROM v a JOIN v b ON a.node < b.node) SELECT round(quantile_cont(x, 0.1), 5) AS threshold FROM p")
def grf21_distance_threshold(spark, d):
    return spark.range(1).select(F.round(F.lit(N.distance_threshold(vectors(spark, d), 0.1)), 5).alias("threshold"))


@query(f"WITH {EMB} SELECT a.node AS a, b.node AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON b.node = a.node + 1")
def msg12_score_links(spark, d):
    v = vectors(spark, d)
    return spread(G.score_links(v.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")), v))


@query("""WITH h AS (SELECT s_suppkey AS node, md5('6:' || s_suppkey) AS h FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY h, node) - 1 AS i FROM h) SELECT node, (CASE WHEN i < 5 THEN i ELSE ('0x' || substr(h, 1, 8))::BIGINT % 5 END)::INT AS block FROM r""")
def sbm1_random_partition(spark, d):
    return B.random_partition(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), 5, 6)


CELLS = f"""{SUPPLY_EDGES}, {NATION}, m AS (SELECT a.block AS r, b.block AS s, w FROM edges JOIN part a ON a.node = src JOIN part b ON b.node = dst), c AS (SELECT r, s, sum(w) AS e FROM m GROUP BY ALL),
u AS (SELECT r, s, sum(e) AS e FROM (SELECT r, s, e FROM c UNION ALL SELECT s, r, e FROM c) GROUP BY ALL), z AS (SELECT block, count(*) AS size FROM part GROUP BY block),
st AS (SELECT block, size, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree, (coalesce(o, 0) + coalesce(i, 0))::BIGINT AS degree FROM z LEFT JOIN (SELECT r AS block, sum(w) AS o FROM m GROUP BY r) USING (block) LEFT JOIN (SELECT s AS block, sum(w) AS i FROM m GROUP BY s) USING (block))"""


@query(f"WITH {CELLS} SELECT r, s, e::BIGINT AS e FROM u")
def sbm2_block_edges(spark, d):
    return B.block_edges(supply_edges(spark, d), nation_part(spark, d))


@query(f"WITH {CELLS} SELECT * FROM st")
def sbm3_block_stats(spark, d):
    return B.block_stats(supply_edges(spark, d), nation_part(spark, d))


@query(f"WITH {SUPPLY_EDGES}, {NATION}, g AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node), c AS (SELECT block, coalesce(d, 0) AS degree, count(*) AS n FROM part LEFT JOIN g USING (node) GROUP BY ALL) SELECT block, degree, n, round(n / sum(n) OVER (PARTITION BY block), 6) AS share FROM c")
def sbm4_block_degree_dist(spark, d):
    return spread(B.block_degree_dist(supply_edges(spark, d), nation_part(spark, d)))


@query(f"WITH {SUPPLY_EDGES}, {NATION}, i AS (SELECT dst AS node, count(*) AS i FROM edges GROUP BY dst), o AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY src), c AS (SELECT block, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, count(*) AS n FROM part LEFT JOIN i USING (node) LEFT JOIN o USING (node) GROUP BY ALL) SELECT block, in_degree, out_degree, n, round(n / sum(n) OVER (PARTITION BY block), 6) AS share FROM c")
def sbm4_block_joint_degrees(spark, d):
    return spread(B.block_joint_degrees(supply_edges(spark, d), nation_part(spark, d)))


@query(f"WITH {SUPPLY_EDGES}, {NATION}, b AS (SELECT src AS node, dst AS o, w FROM edges WHERE src <> dst UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst) SELECT b.node, block, sum(w)::BIGINT AS k FROM b JOIN part p ON p.node = o GROUP BY ALL")
def sbm5_node_block_edges(spark, d):
    return B.node_block_edges(supply_edges(spark, d), nation_part(spark, d))


@query("SELECT s_suppkey AS node, n_regionkey AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sbm6_merge_blocks(spark, d):
    return B.merge_blocks(nation_part(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("block"), F.col("n_regionkey").alias("into")))


def levels(spark, d):
    return [nation_part(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("block"))]


@query(f"WITH {CELLS} SELECT 0 AS level, r, s, e::BIGINT AS e FROM c UNION ALL SELECT 1, a.n_regionkey, b.n_regionkey, sum(e)::BIGINT FROM c JOIN nation a ON a.n_nationkey = r JOIN nation b ON b.n_nationkey = s GROUP BY ALL")
def sbm8_block_rollup(spark, d):
    return B.block_rollup(supply_edges(spark, d), levels(spark, d))


@query("SELECT s_suppkey AS node, n_regionkey AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sbm29_compose_levels(spark, d):
    return B.compose_levels(*levels(spark, d))


@query(f"""WITH {CELLS}, x AS (SELECT u.r, u.s, e::DOUBLE AS e, a.size AS nr, b.size AS ns, a.degree AS kr, b.degree AS ks FROM u JOIN st a ON a.block = u.r JOIN st b ON b.block = u.s),
y AS (SELECT e::DOUBLE AS e, a.size AS nr, b.size AS ns, a.out_degree AS o, b.in_degree AS i FROM c JOIN st a ON a.block = c.r JOIN st b ON b.block = c.s)
SELECT 'SKN' AS name, round(sum(e * ln(e / (nr * ns))), 3) AS score FROM x UNION ALL SELECT 'DCKN', round(sum(e * ln(e / (kr::DOUBLE * ks))), 3) FROM x
UNION ALL SELECT 'SPS', round(-((SELECT sum(w) FROM edges) + (SELECT sum(degree * ln(size)) FROM st) - 0.5 * sum(e * ln(e))), 3) FROM x
UNION ALL SELECT 'DCP', round(-(-(SELECT sum(w) FROM edges) - (SELECT sum(lgamma(k + 1)) FROM (SELECT sum(w) AS k FROM (SELECT src AS n, w FROM edges UNION ALL SELECT dst, w FROM edges) GROUP BY n)) - 0.5 * sum(e * ln(e / (kr::DOUBLE * ks)))), 3) FROM x
UNION ALL SELECT 'SKN_directed', round(sum(e * ln(e / (nr * ns))), 3) FROM y UNION ALL SELECT 'DCKN_directed', round(sum(e * ln(e / (o::DOUBLE * i))), 3) FROM y
UNION ALL SELECT 'SPS_directed', round(-((SELECT sum(w) FROM edges) + (SELECT sum(degree * ln(size)) FROM st) - sum(e * ln(e))), 3) FROM y""")
def sbm9_to_sbm13_scores(spark, d):
    e, p = written(supply_edges(spark, d), "edges"), nation_part(spark, d)
    out = None
    for name, directed in (("SKN", False), ("DCKN", False), ("SPS", False), ("DCP", False), ("SKN", True), ("DCKN", True), ("SPS", True)):
        one = B.score(e, p, name, directed).select(F.lit(name + "_directed" * directed).alias("name"), F.round("score", 3).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


_ICL = [(f"{kind}_{'directed' if directed else 'undirected'}", prior, directed) for kind, prior in (("jeffreys", 0.5), ("uniform", 1.0)) for directed in (False, True)]


def _icl_sql(name, prior, directed):
    return f"SELECT '{name}' AS name, round((SELECT sum(lgamma(e + {prior}) + lgamma(p - e + {prior}) - lgamma(p + 2 * {prior}) + lgamma(2 * {prior}) - 2 * lgamma({prior})) FROM {'xd' if directed else 'xu'}) + (SELECT sum(lgamma(n + {prior})) FROM z) + lgamma(b * {prior}) - b * lgamma({prior}) - lgamma(n + b * {prior}), 2) AS score FROM t"


@query(f"""WITH {PART_EDGES}, pt AS (SELECT p_partkey AS node, p_brand AS block FROM part), z AS (SELECT block, count(*)::DOUBLE AS n FROM pt GROUP BY block),
ed AS (SELECT a.block AS r, b.block AS s, count(*)::DOUBLE AS e FROM edges JOIN pt a ON a.node = src JOIN pt b ON b.node = dst GROUP BY ALL), one AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges),
eu AS (SELECT least(a.block, b.block) AS r, greatest(a.block, b.block) AS s, count(*)::DOUBLE AS e FROM one JOIN pt a ON a.node = src JOIN pt b ON b.node = dst GROUP BY ALL), t AS (SELECT sum(n) AS n, count(*) AS b FROM z),
xu AS (SELECT CASE WHEN a.block = b.block THEN a.n * (a.n + 1) / 2 ELSE a.n * b.n END AS p, coalesce(e, 0) AS e FROM z a JOIN z b ON a.block <= b.block LEFT JOIN eu ON r = a.block AND s = b.block), xd AS (SELECT a.n * b.n AS p, coalesce(e, 0) AS e FROM z a CROSS JOIN z b LEFT JOIN ed ON r = a.block AND s = b.block)
{" UNION ALL ".join(_icl_sql(*v) for v in _ICL)}""")
def sbm14_icl(spark, d):
    e, p = part_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("block"))
    out = None
    for name, prior, directed in _ICL:
        one = L.icl(e, p, prior, directed).select(F.lit(name).alias("name"), F.round("score", 2).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT s_nationkey AS x, s_suppkey % 7 AS y FROM supplier), j AS (SELECT x, y, count(*) AS c FROM a GROUP BY ALL), n AS (SELECT sum(c) AS n FROM j),
h AS (SELECT (SELECT -sum(c / n * ln(c / n)) FROM (SELECT sum(c) AS c FROM j GROUP BY x), n) AS h1, (SELECT -sum(c / n * ln(c / n)) FROM (SELECT sum(c) AS c FROM j GROUP BY y), n) AS h2, (SELECT -sum(c / n * ln(c / n)) FROM j, n) AS h12)
SELECT round(h1, 6) AS h1, round(h2, 6) AS h2, round(h1 + h2 - h12, 6) AS mi, round((h1 + h2 - h12) / sqrt(h1 * h2), 6) AS nmi FROM h""")
def sbm24_nmi(spark, d):
    a = nation_part(spark, d)
    return spread(B.nmi(a, a.select("node", (F.col("node") % 7).alias("block"))))


@query()
def sbm20_em_partition(spark, d):
    return B.em_partition(supply_edges(spark, d), nation_part(spark, d), 3)


@query(f"""WITH {S}, s2 AS (SELECT DISTINCT a.src, b.dst FROM near a JOIN near b ON a.dst = b.src), reach AS (SELECT * FROM near UNION SELECT * FROM s2)
SELECT a.src AS a, b.src AS b, count(*) AS common FROM reach a JOIN reach b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 2""")
def grf11_common_within_two(spark, d):
    return G.common_neighbors(supply_edges(spark, d), 2, 2)


@query(f"WITH {SUPPLY_EDGES}, l AS (SELECT src, dst, w::DOUBLE AS w FROM edges WHERE src <> dst UNION ALL SELECT n, n, 1.0 FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges)), g AS (SELECT src, sum(w) AS d FROM l GROUP BY src) SELECT l.src, l.dst, round(w / sqrt(a.d * b.d), 6) AS w FROM l JOIN g a ON a.src = l.src JOIN g b ON b.src = l.dst")
def msg3_gcn_norm(spark, d):
    e = supply_edges(spark, d)
    return spread(G.gcn_norm(e, G.nodes_of(e)))


@query(f"WITH {SUPPLY_EDGES} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM edges")
def msg4_row_norm(spark, d):
    return spread(G.row_norm(supply_edges(spark, d)))


@query(f"WITH {P}, g AS (SELECT src, count(*) AS d FROM near GROUP BY src) SELECT n.src, n.dst, round(-1 / sqrt(a.d * b.d), 6) AS w FROM near n JOIN g a ON a.src = n.src JOIN g b ON b.src = n.dst UNION ALL SELECT src, src, 1.0 FROM g")
def fea23_laplacian(spark, d):
    return spread(G.laplacian(G.neighbours(part_edges(spark, d)).withColumn("w", F.lit(1.0))))


@query("""WITH a AS (SELECT s_nationkey AS x, s_suppkey % 7 AS y FROM supplier), j AS (SELECT x, y, count(*) AS c FROM a GROUP BY ALL), n AS (SELECT sum(c)::DOUBLE AS n FROM j), ax AS (SELECT sum(c)::BIGINT AS x FROM j GROUP BY x), ay AS (SELECT sum(c)::BIGINT AS y FROM j GROUP BY y),
h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM ax, n) AS h1, (SELECT -sum(y / n * ln(y / n)) FROM ay, n) AS h2, (SELECT -sum(c / n * ln(c / n)) FROM j, n) AS h12),
t AS (SELECT x, y, n, unnest(range(greatest(1, (x + y - n)::BIGINT), least(x, y) + 1)) AS c FROM ax, ay, n), e AS (SELECT sum(c / n * ln(n * c / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(c + 1) - lgamma(x - c + 1) - lgamma(y - c + 1) - lgamma(n - x - y + c + 1))) AS ex FROM t)
SELECT round(h1 + h2 - h12, 6) AS mi, round(ex, 6) AS expected, round((h1 + h2 - h12 - ex) / ((h1 + h2) / 2 - ex), 5) AS ami FROM h, e""")
def sbm25_ami(spark, d):
    a = nation_part(spark, d)
    return B.ami(a, a.select("node", (F.col("node") % 7).alias("block"))).select(F.round("mi", 6).alias("mi"), F.round("expected", 6).alias("expected"), F.round("ami", 5).alias("ami"))


@query("""WITH r AS (SELECT o_orderstatus AS test, o_orderpriority AS inference, o_orderkey AS run, o_totalprice AS value FROM orders) SELECT test, inference, arg_max(run, (value, -run)) AS best_run, max(value) AS best, round(avg(value), 4) AS mean, count(*) AS n FROM r GROUP BY ROLLUP (test, inference)""")
def sbm27_agg2_summarize_runs(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderstatus").alias("test"), F.col("o_orderpriority").alias("inference"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("value"))
    return B.summarize_runs(runs).withColumn("mean", F.round("mean", 4))


_F = "CASE WHEN {0} > 0 THEN {0} * ln({0}) ELSE 0 END"


@query(f"""WITH {SUPPLY_EDGES}, {NATION}, x AS (SELECT src, dst, w::DOUBLE AS w FROM edges WHERE src <> dst UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst), k AS MATERIALIZED (SELECT x.src AS node, p.block AS t, sum(w) AS k FROM x JOIN part p ON p.node = x.dst GROUP BY ALL),
e AS MATERIALIZED (SELECT p.block AS r, t AS s, sum(k) AS e FROM k JOIN part p USING (node) GROUP BY ALL), z AS (SELECT r, sum(e) AS z FROM e GROUP BY r), m AS MATERIALIZED (SELECT k.node, p.block AS o, k.t AS b FROM k JOIN part p USING (node) WHERE k.t <> p.block),
d AS (SELECT node, b, r, s, sum(v) AS v FROM (SELECT m.node, b, unnest([{{'r': o, 's': t, 'v': -k}}, {{'r': t, 's': o, 'v': -k}}, {{'r': b, 's': t, 'v': k}}, {{'r': t, 's': b, 'v': k}}], recursive := true) FROM m JOIN k ON k.node = m.node) GROUP BY ALL),
cells AS (SELECT node, b, sum({_F.format("(coalesce(e, 0) + v)")} - {_F.format("coalesce(e, 0)")}) AS g FROM d LEFT JOIN e USING (r, s) GROUP BY ALL), n AS (SELECT node, sum(k) AS n FROM k GROUP BY node),
ends AS (SELECT m.node, m.b, -2 * ({_F.format("(zo.z - n)")} - {_F.format("zo.z")} + {_F.format("(zb.z + n)")} - {_F.format("zb.z")}) AS g FROM m JOIN n USING (node) JOIN z zo ON zo.r = m.o JOIN z zb ON zb.r = m.b)
SELECT node, b AS block, round(cells.g + ends.g, 5) AS gain FROM cells JOIN ends USING (node, b)""")
def sbm19_move_gains(spark, d):
    """The change of every cell of every move, summed in SQL; checked against score differences in the tests."""
    return spread(B.move_gains(supply_edges(spark, d).where("src <> dst"), nation_part(spark, d)), 5)


def _multisets(n, k):
    """SQL for the logarithm of the ways to deal k like things to n places."""
    n, k = f"({n})::DOUBLE", f"({k})::DOUBLE"
    return f"(CASE WHEN {k} >= {n} + {k} - 1 THEN 0 ELSE lgamma({n} + {k}) - lgamma({k} + 1) - lgamma({n}) END)"


_OVERALL = "t AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS n, (SELECT count(*) FROM z)::DOUBLE AS b, (SELECT sum(w) FROM edges)::DOUBLE AS m)"
_VARIANTS = (("plain", False, False), ("corrected", False, True), ("directed", True, False), ("directed_corrected", True, True))


def _of_variants(one):
    """``name, score`` of a likelihood in both directions, with and without degree correction."""
    out = None
    for name, directed, corrected in _VARIANTS:
        row = one(directed, corrected).select(F.lit(name).alias("name"), F.round("score", 2).alias("score"))
        out = row if out is None else out.unionByName(row)
    return out


def _newman_reinert_sql(name, directed, corrected):
    p, cells, half = ("m / (n * n)", "gd", "1") if directed else ("2 * m / (n * n)", "gu", "CASE WHEN r = s THEN 0.5 ELSE 1 END")
    more = " + (SELECT sum(degree * ln(size) + lgamma(size) - lgamma(size + degree)) FROM st)" if corrected else ""
    return f"SELECT '{name}' AS name, round((SELECT sum(lgamma(e + 1) - (e + 1) * ln({half} * {p} * a * b2 + 1)) FROM {cells}, t) + (SELECT sum(lgamma(size + 1)) FROM z) - ln(n) + lgamma(b) - lgamma(b + n){more}, 2) AS score FROM t"


@query(f"""WITH {CELLS}, {_OVERALL}, gu AS (SELECT x.block AS r, y.block AS s, x.size AS a, y.size AS b2, coalesce(e, 0)::DOUBLE AS e FROM z x JOIN z y ON x.block <= y.block LEFT JOIN u ON u.r = x.block AND u.s = y.block),
gd AS (SELECT x.block AS r, y.block AS s, x.size AS a, y.size AS b2, coalesce(e, 0)::DOUBLE AS e FROM z x CROSS JOIN z y LEFT JOIN c ON c.r = x.block AND c.s = y.block)
{" UNION ALL ".join(_newman_reinert_sql(*v) for v in _VARIANTS)}""")
def sbm15_newman_reinert(spark, d):
    e, p = written(supply_edges(spark, d), "edges"), nation_part(spark, d)
    return _of_variants(lambda directed, corrected: L.newman_reinert(e, p, directed, corrected))


_GRAPH = f"""{CELLS}, {_OVERALL}, pairs AS (SELECT least(src, dst) AS i, greatest(src, dst) AS j, sum(w)::DOUBLE AS a FROM edges GROUP BY ALL), k AS (SELECT n, sum(o)::DOUBLE AS o, sum(i)::DOUBLE AS i FROM (SELECT src AS n, w AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, w FROM edges) GROUP BY n)"""


def _graph_sql(directed, corrected):
    """The graph given blocks (and degrees), the degrees given uniform ways, and the sizes of blocks."""
    if directed:
        graph = "(SELECT sum(lgamma(e + 1)) FROM c) - (SELECT sum(lgamma(w + 1)) FROM edges)"
        ends = " + (SELECT sum(lgamma(o + 1) + lgamma(i + 1)) FROM k) - (SELECT sum(lgamma(out_degree + 1) + lgamma(in_degree + 1)) FROM st)"
        ways = f" - (SELECT sum({_multisets('size', 'out_degree')} + {_multisets('size', 'in_degree')}) FROM st)"
    else:
        graph = "(SELECT sum(CASE WHEN r = s THEN e / 2 * ln(2) + lgamma(e / 2 + 1) ELSE lgamma(e + 1) END) FROM u WHERE r <= s) - (SELECT sum(CASE WHEN i = j THEN a * ln(2) ELSE 0 END + lgamma(a + 1)) FROM pairs)"
        ends = " + (SELECT sum(lgamma(o + i + 1)) FROM k) - (SELECT sum(lgamma(degree + 1)) FROM st)"
        ways = f" - (SELECT sum({_multisets('size', 'degree')}) FROM st)"
    return graph + (ends + ways if corrected else " - (SELECT sum(degree * ln(size)) FROM st)")


def _partition_sql(below, blocks):
    return f"(- lgamma({below} + 1) - {_multisets(f'{below} - {blocks} + 1', f'{blocks} - 1')} - ln({below}))"


def _counts_sql(blocks, directed):
    return f"(- {_multisets(f'{blocks} * {blocks}' if directed else f'{blocks} * ({blocks} + 1) / 2', 'm')})"


def _flat_sql(name, directed, corrected):
    return f"SELECT '{name}' AS name, round({_graph_sql(directed, corrected)} + (SELECT sum(lgamma(size + 1)) FROM z) + {_counts_sql('b', directed)} + {_partition_sql('n', 'b')}, 2) AS score FROM t"


@query(f"WITH {_GRAPH} {' UNION ALL '.join(_flat_sql(*v) for v in _VARIANTS)}")
def sbm16_flat_likelihood(spark, d):
    e, p = written(supply_edges(spark, d), "edges"), nation_part(spark, d)
    return _of_variants(lambda directed, corrected: L.flat_likelihood(e, p, "uniform" if corrected else None, directed))


@query()
def sbm16_sbm18_flat_hyperprior(spark, d):
    """Degree distributions alike: checked against a direct sum in the tests."""
    e, p = written(supply_edges(spark, d), "edges"), nation_part(spark, d)
    one = lambda name, directed: L.flat_likelihood(e, p, "hyperprior", directed).select(F.lit(name).alias("name"), F.round("score", 2).alias("score"))
    return one("undirected", False).unionByName(one("directed", True))


_UPPER = """p1 AS (SELECT n_nationkey AS node, n_regionkey AS block FROM nation), z1 AS (SELECT block, count(*) AS size FROM p1 GROUP BY block), c1 AS (SELECT a.block AS r, b.block AS s, sum(e) AS e FROM c JOIN p1 a ON a.node = r JOIN p1 b ON b.node = s GROUP BY ALL),
t1 AS (SELECT (SELECT count(*) FROM p1)::DOUBLE AS n1, (SELECT count(*) FROM z1)::DOUBLE AS b1)"""


def _level_sql(cells, sizes, directed):
    raw = f"SELECT r, s, e FROM {cells}" if directed else f"SELECT least(r, s) AS r, greatest(r, s) AS s, sum(e) AS e FROM {cells} GROUP BY ALL"
    places = "a.size * b.size" if directed else "CASE WHEN r = s THEN a.size * (a.size + 1) / 2 ELSE a.size * b.size END"
    return f"(- (SELECT sum({_multisets(places, 'e')}) FROM ({raw}) JOIN {sizes} a ON a.block = r JOIN {sizes} b ON b.block = s) + (SELECT sum(lgamma(size + 1)) FROM {sizes}))"


def _hierarchy_sql(name, directed, corrected):
    low, high = _level_sql("c", "z", directed), _level_sql("c1", "z1", directed)
    return f"SELECT '{name}' AS name, round({_graph_sql(directed, corrected)} + {low} + {high} + {_partition_sql('n', 'b')} + {_partition_sql('n1', 'b1')} + {_counts_sql('b1', directed)} - ln(b1), 2) AS score FROM t, t1"


@query(f"WITH {_GRAPH}, {_UPPER} {' UNION ALL '.join(_hierarchy_sql(*v) for v in _VARIANTS)}")
def sbm17_hierarchy_likelihood(spark, d):
    e, parts = written(supply_edges(spark, d), "edges"), levels(spark, d)
    return _of_variants(lambda directed, corrected: L.hierarchy_likelihood(e, parts, "uniform" if corrected else None, directed))


def _mdl_sql(name, directed, corrected):
    sums = ("o", "i") if directed else ("o + i",)
    more = "".join(f" - (SELECT sum(c * ln(c / size)) FROM (SELECT block, coalesce({k}, 0) AS k, count(*)::DOUBLE AS c FROM part LEFT JOIN k ON n = node GROUP BY ALL) JOIN z USING (block))" for k in sums) if corrected else ""
    return f"SELECT '{name}' AS name, round(- (SELECT sum(lgamma(size + 1)) FROM z) + {_multisets('b', 'n')} - {_counts_sql('b', directed)}{more}, 2) AS score FROM t"


@query(f"WITH {_GRAPH} {' UNION ALL '.join(_mdl_sql(*v) for v in _VARIANTS)}")
def sbm21_description_length(spark, d):
    e, p = written(supply_edges(spark, d), "edges"), nation_part(spark, d)
    return _of_variants(lambda directed, corrected: L.description_length(e, p, directed, corrected))
