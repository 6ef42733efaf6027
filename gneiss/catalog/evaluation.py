"""Labelled tables, splits, sampling, scaling, metrics, losses and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.catalog.base import LABELLED, Found, labelled, spread, table
from gneiss.functions import losses, metrics
from gneiss.operators import rows, sampling, scaling, selection, splits
from gneiss.plans.rank import with_index

found = query = Found()
SCORES = f"{LABELLED}, scored AS (SELECT doc_id, source, lang, quality AS y, ln(1 + n_chars) / 10 AS score, toxic FROM labelled WHERE quality IS NOT NULL)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).where("quality is not null").select("doc_id", "source", "lang", F.col("quality").alias("y"), (F.log(1 + F.col("n_chars")) / 10).alias("score"), "toxic")


@query(f"""WITH {LABELLED}, known AS (SELECT * FROM labelled WHERE quality IS NOT NULL),
folds AS (SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id), doc_id) - 1) % 5 AS fold FROM known),
fitted AS (SELECT k.fold, avg(f.n_chars) AS m, stddev_pop(f.n_chars) AS s FROM (SELECT DISTINCT fold FROM folds) k JOIN folds f ON f.fold <> k.fold GROUP BY k.fold),
scored AS (SELECT f.fold, quality AS y, 1 / (1 + exp(-(n_chars - m) / s)) AS p FROM folds f JOIN fitted USING (fold))
SELECT fold::INT AS fold, round(avg((y = round_even(p, 0))::INT), 6) AS accuracy, round(avg(y), 6) AS positive, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, count(*)::DOUBLE AS count FROM scored GROUP BY fold""")
def entry_fold_metrics(spark, d):
    """Stratified folds; a score scaled by the other folds' parameters; metrics of each fold."""
    known = labelled(spark, d).where("quality is not null")
    folds = splits.kfold_stratified(known, "doc_id", "quality", 5, 5)
    # Parameters of all folds but one come from the folds' sums: one pass, whatever k.
    sums = folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("n_chars").alias("t"), F.sum(F.col("n_chars") * F.col("n_chars")).alias("q"))
    all_ = sums.agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"), F.sum("q").alias("all_q"))
    less = lambda c: F.col(f"all_{c}") - F.col(c)
    fitted = sums.join(F.broadcast(all_)).select("fold", (less("t") / less("n")).alias("m"), (less("q") / less("n")).alias("q"))
    met = folds.join(F.broadcast(fitted), "fold").select("fold", F.col("quality").alias("y"), (1 / (1 + F.exp(-(F.col("n_chars") - F.col("m")) / F.sqrt(F.col("q") - F.col("m") * F.col("m"))))).alias("score"))
    return spread(metrics.metrics(met, ["fold"], ["accuracy", "positive", "rmse", "count"]))


@query(f"WITH {LABELLED}, good AS (SELECT text FROM (SELECT DISTINCT text FROM documents) WHERE length(text) >= 200) SELECT doc_id, lang FROM documents WHERE text IN (SELECT text FROM good)")
def dq1_filter_valid(spark, d):
    return rows.filter_valid(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", F.length("text") >= 200).select("doc_id", "lang")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_idx FROM orders")
def dq2_row_index(spark, d):
    return with_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_idx")


@query(f"WITH {LABELLED} SELECT doc_id, (quality IS NOT NULL)::INT AS quality_mask, (toxic IS NOT NULL)::INT AS toxic_mask, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM labelled")
def dq3_mask_targets(spark, d):
    return rows.mask_targets(labelled(spark, d), ["quality", "toxic"]).select("doc_id", "quality_mask", "toxic_mask", "quality", "toxic")


@query(f"WITH {LABELLED} SELECT doc_id, 'quality' AS task, quality AS y, n_chars::DOUBLE AS pred FROM labelled WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic, n_chars::DOUBLE FROM labelled WHERE toxic IS NOT NULL")
def dq4_melt_tasks(spark, d):
    return rows.melt_tasks(labelled(spark, d), ["doc_id"], ["quality", "toxic"], ["n_chars", "n_chars"])


@query("SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0.0::DOUBLE ELSE x::DOUBLE END) AS filled FROM embeddings")
def dq5_fill_nan_array(spark, d):
    given = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(x.cast("double"))).alias("a"))
    return given.select("vec_id", rows.fill_nan_array(F.col("a"), 0.0).alias("filled"))


@query("SELECT (max(label) + CASE WHEN min(label) = 0 THEN 1 ELSE 0 END)::BIGINT AS n_labels FROM embeddings")
def dq6_label_cardinality(spark, d):
    return rows.label_cardinality(table(spark, d, "embeddings"), "label")


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_graphs, max(n) AS max_nodes, 2::BIGINT AS n_tasks, 2::BIGINT AS dim_target FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def dq7_describe_dataset(spark, d):
    return rows.describe_dataset(table(spark, d, "lineitem"), ["a", "b"], "l_orderkey")


@query("SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS w FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL")
def dq8_edges_since(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp '1998-01-01'").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("w"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def dq9_check_roles(spark, d):
    role = F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train")
    return rows.check_roles(table(spark, d, "orders").withColumn("split", role)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.k, b.k) AS l_orderkey, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT l_orderkey AS k, count(*) AS n_left FROM lineitem GROUP BY ALL) a
FULL JOIN (SELECT l_orderkey AS k, count(*) AS n_right FROM lineitem WHERE l_quantity > 5 GROUP BY ALL) b ON a.k = b.k WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)""")
def dq10_check_aligned(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return rows.check_aligned(items, items.where("l_quantity > 5"), "l_orderkey")


@query("SELECT doc_id, coalesce(quality, 0)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def dq11_realign_scores(spark, d):
    return rows.realign_scores(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").withColumn("score", F.col("quality").cast("double")), "doc_id", "score")


RANKED = "row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1"


@query(f"SELECT doc_id, CASE WHEN {RANKED} < floor((SELECT count(*) FROM documents) * 0.2) THEN 'test' ELSE 'train' END AS role FROM documents")
def spl1_random(spark, d):
    return splits.split_random(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query("SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) - 1 < round(count(*) OVER (PARTITION BY lang) * 0.2) THEN 'test' ELSE 'train' END AS role FROM documents")
def spl2_stratified(spark, d):
    return splits.split_stratified(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.2, 7)


def _walk(order: str) -> str:
    return f"""WITH RECURSIVE sizes AS (SELECT p_brand AS g, count(*) AS n FROM part GROUP BY ALL), total AS (SELECT count(*) AS all_, count(*) - floor(count(*) * 0.2) AS train, floor(count(*) * 0.2) AS test FROM part),
walk AS (SELECT g, n, train, row_number() OVER (ORDER BY {order}) AS i FROM sizes, total),
fold(i, used, fits, g) AS (SELECT 0, 0::DOUBLE, true, NULL::VARCHAR UNION ALL SELECT w.i, CASE WHEN f.used + w.n <= w.train THEN f.used + w.n ELSE f.used END, f.used + w.n <= w.train, w.g FROM fold f JOIN walk w ON w.i = f.i + 1)
SELECT p_partkey, p_brand, CASE WHEN fits THEN 'train' ELSE 'test' END AS role FROM part JOIN fold ON p_brand = g"""


def _walks(k: int, seed: int) -> str:
    """Balanced walks with a third of the rows as test, and seeds of their own."""
    one = lambda i: _walk(f"CASE WHEN n > test / 2 THEN 0 ELSE 1 END, md5('{seed + i}:' || g), g").replace("* 0.2", f"* (1.0::DOUBLE / {k})")
    return " UNION ALL ".join(f"SELECT {i} AS fold, * FROM ({one(i)})" for i in range(k))


@query(_walk("CASE WHEN n > test / 2 THEN 0 ELSE 1 END, md5('3:' || g), g"))
def spl3_group_balanced(spark, d):
    return splits.split_group(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.2, True, 3)


@query(_walk("n DESC, g"))
def spl4_group_largest(spark, d):
    return splits.split_group(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 0.2, False)


@query("SELECT source, list_sort(list(DISTINCT doc_id)) AS members FROM documents GROUP BY source")
def spl5_group_members(spark, d):
    return splits.group_members(table(spark, d, "documents"), "source", "doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'test' WHEN lang = 'es' THEN 'valid' ELSE 'train' END AS role FROM documents")
def spl6_defined(spark, d):
    return splits.split_defined(table(spark, d, "documents"), "lang", "de", "es").select("doc_id", "role")


@query(f"SELECT doc_id, (({RANKED}) % 5)::INT AS fold FROM documents")
def spl7_kfold(spark, d):
    return splits.kfold(table(spark, d, "documents").select("doc_id"), "doc_id", 5, 7)


@query("SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM documents")
def spl8_kfold_stratified(spark, d):
    return splits.kfold_stratified(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 5, 7)


@query(_walks(3, 1))
def spl9_kfold_group(spark, d):
    return splits.kfold_group(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 3, 1).select("fold", "p_partkey", "p_brand", "role")


NESTED = """o AS (SELECT doc_id, ((row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1) % 3)::INT AS own, ((row_number() OVER (ORDER BY md5('8:' || doc_id), doc_id) - 1) % 2)::INT AS own_inner FROM documents),
nested AS (SELECT k::INT AS outer_k, NULL::INT AS inner_k, doc_id, 'test' AS role FROM o, range(3) t(k) WHERE k = own
UNION ALL SELECT k::INT, i::INT, doc_id, CASE WHEN i = own_inner THEN 'valid' ELSE 'train' END FROM o, range(3) t(k), range(2) s(i) WHERE k <> own)"""


@query(f"WITH {NESTED} SELECT * FROM nested")
def spl10_nested_cv(spark, d):
    return splits.nested_cv(table(spark, d, "documents"), "doc_id", 3, 2, 7)


@query(f"WITH {NESTED} SELECT DISTINCT outer_k, doc_id, CASE WHEN role = 'test' THEN 'test' ELSE 'train' END AS role FROM nested WHERE outer_k = 1")
def spl11_fold(spark, d):
    return splits.fold(splits.nested_cv(table(spark, d, "documents"), "doc_id", 3, 2, 7), 1)


@query("SELECT doc_id, source, 'train' AS role FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, source, 'test' FROM documents WHERE lang NOT IN ('en', 'de')")
def spl13_prebuilt(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    parts = [docs.where("lang = 'en'"), docs.where("lang = 'de'"), docs.where("lang not in ('en', 'de')")]
    train = parts[0].unionByName(parts[1]).withColumn("role", F.lit("train"))
    return train.unionByName(parts[2].withColumn("role", F.lit("test"))).drop("lang")


@query("SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS n_roles WHERE false")
def spl17_disjoint(spark, d):
    return splits.check_disjoint(splits.split_random(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 7), ["doc_id"])


POS = "pos AS (SELECT doc_id, greatest(coalesce((quality = 1)::INT, 0), coalesce((toxic = 1)::INT, 0)) AS p FROM labelled)"


@query(f"""WITH {LABELLED}, {POS}, r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY p ORDER BY md5('2:' || doc_id), doc_id) - 1 AS i FROM pos)
SELECT doc_id, (2 * i + 1 - p)::BIGINT AS place FROM r WHERE i < (SELECT least(sum(p), count(*) - sum(p)) FROM pos)""")
def smp1_balance_classes(spark, d):
    return sampling.balance_classes(labelled(spark, d), "doc_id", ["quality", "toxic"], 2).select("doc_id", "place")


@query(f"SELECT doc_id, {RANKED} AS place, (({RANKED}) // 32)::BIGINT AS batch FROM documents")
def smp2_smp3_shuffled_batches(spark, d):
    return sampling.batch_ids(sampling.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", 7), "place", 32)


@query("SELECT o_orderkey FROM orders ORDER BY md5('9:' || o_orderkey), o_orderkey LIMIT 100")
def smp9_hash_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "orders").select("o_orderkey"), 100, 9, "o_orderkey")


@query(f"WITH {LABELLED} SELECT round(avg(n_chars), 4) AS n_chars_mean, round(stddev_pop(n_chars), 4) AS n_chars_std, round(avg(quality), 6) AS quality_mean, round(stddev_pop(quality), 6) AS quality_std FROM labelled")
def scl1_fit(spark, d):
    p = scaling.fit_scaler(labelled(spark, d), ["n_chars", "quality"])
    return p.select(*(F.round(c, 4 if c.startswith("n") else 6).alias(c) for c in p.columns))


@query(f"WITH {LABELLED}, p AS (SELECT avg(quality) AS m, stddev_pop(quality) AS s, avg(n_chars) AS nm, stddev_pop(n_chars) AS ns FROM labelled) SELECT doc_id, round(coalesce((quality - m) / s, 0), 6) AS quality, round((n_chars - nm) / ns, 6) AS n_chars FROM labelled, p")
def scl2_apply(spark, d):
    df = labelled(spark, d)
    return spread(scaling.apply_scaler(df, scaling.fit_scaler(df, ["quality", "n_chars"]), ["quality", "n_chars"], 0.0).select("doc_id", "quality", "n_chars"))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def scl3_invert(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = scaling.fit_scaler(df, ["o_totalprice"])
    return spread(scaling.invert_scaler(scaling.apply_scaler(df, p, ["o_totalprice"]), p, ["o_totalprice"]), 4)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice AS y, o_custkey::DOUBLE AS x, CASE WHEN o_orderstatus = 'O' THEN 'test' ELSE 'train' END AS role FROM orders),
p AS (SELECT avg(x) AS xm, stddev_pop(x) AS xs, avg(y) AS ym, stddev_pop(y) AS ys FROM r WHERE role = 'train')
SELECT o_orderkey, role, round((x - xm) / xs, 6) AS x, round(CASE WHEN role = 'train' THEN (y - ym) / ys ELSE y END, 6) AS y FROM r, p""")
def scl4_scale_splits(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"), F.when(F.col("o_orderstatus") == "O", "test").otherwise("train").alias("role"))
    return spread(scaling.scale_splits(df, ["x"], ["y"]))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i)
SELECT vec_id, round(sum(((x - m) / s) ** 2), 5) AS norm FROM e JOIN p USING (i) GROUP BY vec_id""")
def scl5_scale_arrays(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = scaling.scale_arrays(df, "embedding", scaling.array_params(df, "embedding"))
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS value FROM events")
def scl7_minmax(spark, d):
    return spread(scaling.normalize_scores(table(spark, d, "events").select("event_id", "value"), "value"))


@query("SELECT event_id, round(count(*) OVER (ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (), 6) AS value FROM events")
def scl7_quantile(spark, d):
    return spread(scaling.normalize_scores(table(spark, d, "events").select("event_id", "value"), "value", "quantile"))


AUC = "SELECT a.{0} AS g, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM scored a JOIN scored b ON a.{0} = b.{0} AND a.y = 1 AND b.y = 0 GROUP BY ALL"


@query(f"WITH {SCORES}, r AS ({AUC.format('lang')}) SELECT l.lang, round(auc, 6) AS auc FROM (SELECT DISTINCT lang FROM scored) l LEFT JOIN r ON l.lang = r.g")
def met1_roc_auc(spark, d):
    return spread(metrics.roc_auc(scored(spark, d), ["lang"]))


ONE = f"""WITH {SCORES}, p AS (SELECT *, round_even(score, 0) AS c FROM scored) SELECT lang, round(avg((y = c)::INT), 6) AS accuracy,
round(coalesce(sum((c = 1 AND y = 1)::INT) / nullif(sum((c = 1)::INT), 0), 0), 6) AS precision, round(coalesce(sum((c = 1 AND y = 1)::INT) / nullif(sum((y = 1)::INT), 0), 0), 6) AS recall,
round(coalesce(2 * sum((c = 1 AND y = 1)::INT) / nullif(sum((c = 1)::INT) + sum((y = 1)::INT), 0), 0), 6) AS f1, round(avg(y), 6) AS positive, round(avg((y - score) ** 2), 6) AS mse,
round(sqrt(avg((y - score) ** 2)), 6) AS rmse, round(avg(abs(y - score)), 6) AS mae, round(CASE WHEN min(y) < max(y) THEN 1 - sum((y - score) ** 2) / (var_pop(y) * count(*)) END, 6) AS r2,
round(CASE WHEN min(y) < max(y) THEN corr(y, score) END, 6) AS pearson, count(*)::DOUBLE AS count FROM p GROUP BY lang"""


@query(ONE)
def met4_to_met15_simple(spark, d):
    """Accuracy, precision, recall, F1, positive share, MSE, RMSE, MAE, R2, Pearson and count in one pass."""
    names = ["accuracy", "precision", "recall", "f1", "positive", "mse", "rmse", "mae", "r2", "pearson", "count"]
    return spread(metrics.metrics(scored(spark, d), ["lang"], names))


@query(f"""WITH {SCORES}, s AS (SELECT lang, score, sum(y) AS p, count(*) - sum(y) AS n FROM scored GROUP BY ALL),
c AS (SELECT lang, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS pos FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
q AS (SELECT lang, score, tp / (tp + fp) AS prec, tp / nullif(pos, 0) AS rec FROM c),
t AS (SELECT lang, prec, rec - coalesce(lag(rec) OVER w, 0) AS d, coalesce(lag(prec) OVER w, 1) AS b FROM q WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(d * (prec + b) / 2), 6) AS pr_auc, round(sum(d * prec), 6) AS average_precision FROM t GROUP BY lang""")
def met5_met6_pr_auc(spark, d):
    return spread(metrics.pr_auc(scored(spark, d), ["lang"]))


@query("""WITH e AS (SELECT lang, source, CASE WHEN n_chars > 2000 THEN 'en' ELSE lang END AS pred FROM documents), c AS (SELECT source, lang AS c FROM e UNION SELECT source, pred FROM e),
k AS (SELECT c.source, c.c, sum((e.lang = c.c AND e.pred = c.c)::INT) AS h, sum((e.lang = c.c)::INT) AS t, sum((e.pred = c.c)::INT) AS p FROM c JOIN e ON e.source = c.source GROUP BY ALL)
SELECT source, round(avg(CASE WHEN p > 0 THEN h / p ELSE 0 END), 6) AS precision, round(avg(CASE WHEN t > 0 THEN h / t ELSE 0 END), 6) AS recall, round(avg(2 * h / (t + p)), 6) AS f1 FROM k GROUP BY source""")
def met8_macro(spark, d):
    df = table(spark, d, "documents").select("source", F.col("lang").alias("y"), F.when(F.col("n_chars") > 2000, "en").otherwise(F.col("lang")).alias("pred"))
    return spread(metrics.macro(df, ["source"]))


@query("""WITH r AS (SELECT o_orderstatus AS g, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2 AS a,
rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2 AS b FROM orders) SELECT g, round(corr(a, b), 6) AS spearman FROM r GROUP BY g""")
def met13_spearman(spark, d):
    return spread(metrics.spearman(table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("y"), F.col("o_custkey").alias("score")), ["g"]))


@query(f"""WITH {SCORES}, m AS (SELECT 'quality' AS task, y, score AS pred FROM scored UNION ALL SELECT 'toxic', toxic, score FROM scored),
a AS (SELECT a.task, sum(CASE WHEN a.pred > b.pred THEN 1.0 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END) / count(*) AS auc FROM m a JOIN m b ON a.task = b.task AND a.y = 1 AND b.y = 0 GROUP BY ALL)
SELECT task, round(auc, 6) AS value FROM a""")
def met16_multitask(spark, d):
    df = scored(spark, d).withColumnRenamed("y", "quality")
    return spread(metrics.multitask(rows.melt_tasks(df, ["doc_id"], ["quality", "toxic"], ["score", "score"])))


@query(f"""WITH {SCORES}, n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM scored WHERE y = 0), k AS (SELECT unnest([20, 50, 100])::INT AS k)
SELECT k, round(coalesce((SELECT avg((p.score > n.score)::INT) FROM scored p, n WHERE p.y = 1 AND n.r = k.k), 1.0), 6) AS hits FROM k""")
def met17_hits(spark, d):
    s = scored(spark, d)
    return spread(metrics.hits_at(s.where("y = 1"), s.where("y = 0")))


@query("""WITH p AS (SELECT l_orderkey, l_quantity AS s FROM lineitem WHERE l_linenumber = 1), n AS (SELECT l_orderkey, l_quantity AS s FROM lineitem WHERE l_linenumber > 1),
r AS (SELECT p.l_orderkey, 1 + coalesce(sum(CASE WHEN n.s > p.s THEN 1.0 WHEN n.s = p.s THEN 0.5 ELSE 0 END), 0) AS r FROM p LEFT JOIN n USING (l_orderkey) GROUP BY p.l_orderkey) SELECT round(avg(1 / r), 6) AS mrr FROM r""")
def met18_mrr(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"))
    return spread(metrics.mrr(items.where("l_linenumber = 1"), items.where("l_linenumber > 1"), "l_orderkey"))


@query("""WITH a AS (SELECT l_orderkey AS g, l_linenumber AS i, l_quantity AS y, l_discount AS s FROM lineitem), p AS (SELECT a.g, sign(a.y - b.y) AS dy, sign(a.s - b.s) AS ds FROM a JOIN a b ON a.g = b.g AND a.i < b.i)
SELECT g, round(sum(dy * ds) / nullif(sqrt(sum(abs(dy)) * sum(abs(ds))), 0), 6) AS kendall FROM p GROUP BY g""")
def met19_kendall(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("score"))
    return spread(metrics.kendall(df, ["g"], "i"))


@query("""WITH c AS (SELECT l_returnflag AS g, l_suppkey AS i, l_quantity AS y, l_discount AS s, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT g, y, s, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT a.g, a.n * b.n AS n, sign(a.y - b.y)::INT AS dy, sign(a.s - b.s)::INT AS ds FROM k a JOIN k b ON a.g = b.g UNION ALL SELECT a.g, -a.n::HUGEINT * b.n, sign(a.y - b.y)::INT, sign(a.s - b.s)::INT FROM c a JOIN c b ON a.g = b.g AND a.i = b.i)
SELECT g, round(sum(n * dy * ds)::DOUBLE / nullif(sqrt(sum(n * abs(dy))::DOUBLE * sum(n * abs(ds))::DOUBLE), 0), 6) AS kendall FROM p GROUP BY g""")
def met19_kendall_large_groups(spark, d):
    """All pairs of lines of different suppliers in the few groups that hold all lines."""
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("score"))
    return spread(metrics.kendall(df, ["g"], "i"))


@query(f"WITH {SCORES}, r AS (SELECT source, lang, avg(score) AS v FROM scored GROUP BY ALL) SELECT lang, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM r GROUP BY lang")
def met20_over_folds(spark, d):
    per = scored(spark, d).groupBy("source", "lang").agg(F.avg("score").alias("v"))
    return spread(metrics.over_folds(per, ["lang"], "v"))


@query(f"WITH {SCORES} SELECT lang, round(avg(2 * y * (greatest(-score, 0) + ln(1 + exp(-abs(score)))) + (1 - y) * (greatest(score, 0) + ln(1 + exp(-abs(score))))), 6) AS bce, round(avg((y - score) ** 2), 6) AS mse FROM scored GROUP BY lang")
def los1_los2_masked(spark, d):
    return spread(scored(spark, d).groupBy("lang").agg(losses.bce(F.col("y"), F.col("score"), 2.0).alias("bce"), losses.mse(F.col("y"), F.col("score")).alias("mse")))


@query("WITH l AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT label, round(avg(ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[label + 1]), 6) AS ce FROM l GROUP BY label")
def los3_cross_entropy(spark, d):
    return spread(table(spark, d, "embeddings").groupBy("label").agg(losses.cross_entropy(F.col("label"), F.col("embedding").cast("array<double>")).alias("ce")))


PAIR = """WITH p AS (SELECT l_orderkey AS k, l_discount * 10 AS s, l_quantity / 10 AS w FROM lineitem WHERE l_linenumber = 1), n AS (SELECT l_orderkey AS k, l_tax * 10 AS s FROM lineitem WHERE l_linenumber > 1), m AS (SELECT p.s - n.s AS x, w FROM p JOIN n USING (k))
SELECT 'auc' AS name, round(sum((1 - x) ** 2), 3) AS loss FROM m UNION ALL SELECT 'hinge_auc', round(sum(greatest(1 - x, 0) ** 2), 3) FROM m UNION ALL SELECT 'weighted_auc', round(sum(w * (1 - x) ** 2), 3) FROM m
UNION ALL SELECT 'adaptive_auc', round(sum((w - x) ** 2), 3) FROM m UNION ALL SELECT 'weighted_hinge_auc', round(sum(w * greatest(w - x, 0) ** 2), 3) FROM m UNION ALL SELECT 'adaptive_hinge_auc', round(sum(greatest(w - x, 0) ** 2), 3) FROM m
UNION ALL SELECT 'log_rank', round(-avg(ln(1 / (1 + exp(-x)) + 1e-15)), 6) FROM m"""


@query(PAIR)
def los4_los6_pair_losses(spark, d):
    items = table(spark, d, "lineitem")
    pos = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("score"), (F.col("l_quantity") / 10).alias("w"))
    neg = items.where("l_linenumber > 1").select(F.col("l_orderkey").alias("k"), (F.col("l_tax") * 10).alias("score"))
    met = pos.withColumnRenamed("score", "_p").join(neg.withColumnRenamed("score", "_n"), "k")
    out = met.agg(*(f(F.col("_p"), F.col("_n"), F.col("w")).alias(n) for n, f in losses.PAIR_LOSSES.items()))  # all in one pass
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.round(F.col(n), 6 if n == "log_rank" else 3).alias("loss")) for n in losses.PAIR_LOSSES)))
    return out.select(pairs.alias("x")).select("x.*")


@query("""WITH p AS (SELECT l_orderkey AS k, l_discount * 10 AS s FROM lineitem WHERE l_linenumber = 1), n AS (SELECT l_orderkey AS k, l_tax * 10 AS s FROM lineitem WHERE l_linenumber > 1), z AS (SELECT k, sum(exp(s)) AS z FROM n GROUP BY k)
SELECT 'ce' AS name, round((SELECT -avg(ln(1 / (1 + exp(-s)) + 1e-15)) FROM p) + (SELECT -avg(ln(1 - 1 / (1 + exp(-s)) + 1e-15)) FROM n), 6) AS loss UNION ALL SELECT 'info_nce', round(-avg(ln(exp(s) / (exp(s) + z) + 1e-15)), 6) FROM p JOIN z USING (k)""")
def los5_ce_info_nce(spark, d):
    items = table(spark, d, "lineitem")
    pos = items.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("score"))
    neg = items.where("l_linenumber > 1").select(F.col("l_orderkey").alias("k"), (F.col("l_tax") * 10).alias("score"))
    return spread(losses.ce_loss(pos, neg).select(F.lit("ce").alias("name"), "loss").unionByName(losses.info_nce(pos, neg, "k").select(F.lit("info_nce").alias("name"), "loss")))


@query("SELECT round((count(*) - sum(quality)) / sum(quality), 6) AS weight FROM labels")
def los7_class_weight(spark, d):
    return spread(losses.class_weight(table(spark, d, "labels"), "quality"))


# Each source stands for a configuration and each language for a fold of it.
RESULTS = "results AS (SELECT dense_rank() OVER (ORDER BY source) - 1 AS config_id, lang AS fold, avg(n_chars) AS value FROM documents GROUP BY source, lang)"


def results(spark, d):
    per = table(spark, d, "documents").groupBy("source", F.col("lang").alias("fold")).agg(F.avg("n_chars").alias("value"))
    return per.join(F.broadcast(with_index(per.select("source").distinct(), "source", name="config_id")), "source").select("config_id", "fold", "value")


@query(f"WITH {RESULTS}, c AS (SELECT config_id, avg(value) AS mean, stddev_pop(value) AS std FROM results GROUP BY ALL) SELECT config_id, round(mean, 4) AS mean, round(std, 4) AS std FROM c ORDER BY c.mean, c.std, config_id LIMIT 1")
def sel3_select_winner(spark, d):
    return spread(selection.select_winner(results(spark, d), "rmse"), 4)


@query(f"WITH {RESULTS}, c AS (SELECT config_id, avg(value) AS mean, stddev_pop(value) AS std FROM results GROUP BY ALL) SELECT config_id, round(mean, 4) AS mean, round(std, 4) AS std FROM c ORDER BY c.mean DESC, config_id DESC LIMIT 1")
def sel4_select_last(spark, d):
    return spread(selection.select_winner(results(spark, d), "auc", last=True), 4)


@query(f"WITH {RESULTS}, r AS (SELECT fold, avg(value) AS m FROM results GROUP BY fold) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std FROM r")
def sel5_assess(spark, d):
    return spread(selection.assess(results(spark, d).withColumnRenamed("fold", "outer_k")), 4)


@query(f"""WITH {RESULTS}, g AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS config_id, a, b FROM (SELECT unnest(['1', '2', '3']) AS a), (SELECT unnest(['x', 'y']) AS b))
SELECT g.config_id::INT AS config_id, f.fold, a, b FROM g, (SELECT DISTINCT lang AS fold FROM documents) f WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.config_id = g.config_id AND r.fold = f.fold AND r.value > 3000)""")
def sel1_sel2_pending(spark, d):
    configs = selection.grid(spark, {"a": [1, 2, 3], "b": ["x", "y"]})
    folds = table(spark, d, "documents").select(F.col("lang").alias("fold")).distinct()
    return selection.pending(configs, folds, results(spark, d).where("value > 3000")).select("config_id", "fold", F.col("config")["a"].alias("a"), F.col("config")["b"].alias("b"))


LOG = "log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events)"


def log_of(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), F.col("value").alias("loss"))


@query(f"""WITH {LOG}, b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
s AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR loss < before THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM b) SELECT run, min(CASE WHEN since >= 5 THEN epoch END)::INT AS stop_epoch FROM s GROUP BY run""")
def sel6_stop_patience(spark, d):
    return selection.stop_patience(log_of(spark, d), "run", "epoch", "loss", 5)


@query(f"""WITH {LOG}, s AS (SELECT *, 100 * (loss / nullif(min(loss) OVER (PARTITION BY run ORDER BY epoch), 0) - 1) AS gl FROM log) SELECT run, min(CASE WHEN epoch > 3 AND gl > 50 THEN epoch END)::INT AS stop_epoch FROM s GROUP BY run""")
def sel7_stop_gl(spark, d):
    return selection.stop_gl(log_of(spark, d), "run", "epoch", "loss", 50, 3)


@query(f"WITH {LOG} SELECT run, arg_max(epoch, (loss, epoch))::INT AS best_epoch, max(loss) AS best FROM log GROUP BY run")
def sel8_best_epoch(spark, d):
    return selection.best_epoch(log_of(spark, d), "run", "epoch", "loss")


@query("SELECT arg_min(p_size, (m, p_size)) AS p_size, round(min(m), 4) AS m FROM (SELECT p_size, avg(p_retailprice) AS m FROM part GROUP BY p_size)")
def sel9_argmin(spark, d):
    return spread(selection.argmin_blocks(table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m")), "p_size", "m"), 4)


@query()
def sel10_forest(spark, d):
    df = scored(spark, d).select("doc_id", "score", "y", F.length("source").cast("double").alias("b"))
    return selection.fit_trees(df, ["score", "b"], "y").transform(df).select("doc_id", "y", "prediction")


@query()
def sel11_boosted(spark, d):
    df = scored(spark, d).select("doc_id", "score", "y", F.length("source").cast("double").alias("b"))
    return selection.fit_trees(df, ["score", "b"], "y", "boosted").transform(df).select("doc_id", "y", "prediction")


@query("""WITH f AS (SELECT label AS y, unnest(range(64)) AS c, unnest(embedding)::DOUBLE AS s FROM embeddings), g AS (SELECT c, s, (c = y)::INT AS y FROM f),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2 AS k, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS m FROM g),
p AS (SELECT c, (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY c HAVING sum(y) > 0)
SELECT round((SELECT (sum(m * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) FROM r), 6) AS micro, round((SELECT avg(auc) FROM p), 6) AS macro""")
def met2_met3_multiclass_auc(spark, d):
    return spread(metrics.multiclass_auc(table(spark, d, "embeddings"), "label", "embedding"))


@query()
def sel12_run_grid(spark, d):
    """Predictions of the forest that cross-validation over given folds chooses."""
    df = splits.kfold(scored(spark, d).select("doc_id", "score", "y", F.length("source").cast("double").alias("b")), "doc_id", 3, 2)
    return selection.run_grid(df, ["score", "b"], "y", "fold", (2, 3), 3).transform(df).select("doc_id", "y", "prediction")


@query(f"WITH {SCORES} SELECT doc_id, depth::INT AS depth, y, true AS known FROM scored, (SELECT unnest([2, 3]) AS depth)")
def sel10_out_of_fold(spark, d):
    """A prediction for each row and depth, from the forest of the other folds; ``known`` where it is a class with a chance between 0 and 1."""
    df = splits.kfold(scored(spark, d).select("doc_id", "score", "y", F.length("source").cast("double").alias("b")), "doc_id", 3, 2)
    held = selection.out_of_fold(df.withColumnRenamed("score", "a"), ["a", "b"], "y", "fold", depths=(2, 3))
    return held.select("doc_id", "depth", "y", (F.col("prediction").isin(0.0, 1.0) & F.col("score").between(0, 1)).alias("known"))


@query()
def sel12_grid_winner(spark, d):
    """The depth whose held-out AUC is best over the folds; checked in the tests."""
    df = splits.kfold(scored(spark, d).select("doc_id", "score", "y", F.length("source").cast("double").alias("b")), "doc_id", 3, 2)
    held = selection.out_of_fold(df.withColumnRenamed("score", "a"), ["a", "b"], "y", "fold", depths=(2, 3))
    return selection.select_winner(selection.grid_scores(held, "y", "fold"), "auc")
