"""Readers: labelled tables, structure records, graph bundles, packed graphs, edge splits, results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.plans.rank import in_intervals, numbered_lines, running_sum, with_index
from gneiss.plans.store import written

#: Published data sets, their task, split and metric.
REGISTRY = [
    ("QM7", "Regression", "stratified", "mae"), ("QM8", "Regression", "random", "mae"), ("QM9", "Regression", "random", "mae"), ("ESOL", "Regression", "random", "rmse"), ("FreeSolv", "Regression", "random", "rmse"),
    ("Lipophilicity", "Regression", "random", "rmse"), ("BBBP", "Classification", "scaffold", "auc"), ("Tox21", "Classification", "random", "auc"), ("SIDER", "Classification", "random", "auc"),
    ("ClinTox", "Classification", "random", "auc"), ("Liver injury", "Classification", "random", "auc"), ("Mutagenesis", "Classification", "random", "auc"), ("hERG", "Classification", "random", "auc"),
    ("MUV", "Classification", "random", "prc"), ("HIV", "Classification", "random", "auc"), ("BACE", "Classification", "random", "auc"),
]


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV (gzip too) or Parquet by its suffix; rows that don't parse have nulls and are whole in ``_corrupt_record`` if the schema has it."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_mapping(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/*.csv.gz")


def read_sdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms, bonds and properties of the records of a structure file, by fixed columns; ids are 1-based positions, empty records leave a gap."""
    lines = numbered_lines(spark, path, "_i", lineSep="$$$$\n").select((F.col("_i") + 1).alias("record_id"), F.split("value", "\n").alias("l")).where(F.size("l") > 4)
    count = lambda a: F.trim(F.substring(F.get("l", F.lit(3)), a, 3)).cast("int")
    base = lines.select("record_id", "l", count(1).alias("na"), count(4).alias("nb")).where("na > 0")
    number = lambda c, a, n: F.trim(F.substring(c, a, n))
    atoms = base.select("record_id", F.posexplode(F.slice("l", 5, F.col("na"))).alias("k", "t")).select(
        "record_id", (F.col("k") + 1).alias("atom_idx"), number("t", 32, 3).alias("symbol"), *(number("t", 1 + 10 * i, 10).cast("double").alias(c) for i, c in enumerate("xyz"))
    )
    bonds = base.where("nb > 0").select("record_id", F.explode(F.slice("l", F.col("na") + 5, F.col("nb"))).alias("t")).select("record_id", *(number("t", 1 + 3 * i, 3).cast("int").alias(c) for i, c in enumerate(("src", "dst", "type"))))
    properties = base.select("record_id", F.posexplode("l").alias("k", "t"), "l").where(F.col("t").startswith(">")).select("record_id", F.regexp_extract("t", "<([^>]*)>", 1).alias("name"), F.get("l", F.col("k") + 1).alias("value"))
    return atoms, bonds, properties


def join_properties(mols: DataFrame, props: DataFrame, key: str, fallback: str | None = None) -> DataFrame:
    """Inner join on the record's position; ``fallback``: on what follows the first ``_`` of that column."""
    if fallback:
        props = props.withColumn(key, F.element_at(F.split(fallback, "_", 2), 2).cast("long"))
    return mols.join(props, key)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, "_i").select((F.col("_i") + 1).alias("line"), "value")


def read_tu(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and graph labels of a text bundle keyed by line numbers; an edge is in its source's graph, and ``None`` labels are null."""
    nodes = _numbered(spark, f"{prefix}_graph_indicator.txt").select(F.col("line").alias("node_id"), F.col("value").cast("long").alias("graph_id"))
    labels = _numbered(spark, f"{prefix}_node_labels.txt").select(F.col("line").alias("node_id"), F.trim("value").cast("int").alias("label"))
    pair = F.split("value", r"\s*,\s*")
    edges = _numbered(spark, f"{prefix}_A.txt").select(F.trim(pair[0]).cast("long").alias("src"), F.trim(pair[1]).cast("long").alias("dst"))
    marked = edges.join(nodes.withColumnRenamed("node_id", "src"), "src").select("graph_id", "src", "dst")
    ys = _numbered(spark, f"{prefix}_graph_labels.txt").select(F.col("line").alias("graph_id"), F.transform(F.split("value", ","), lambda x: F.when(F.trim(x) != "None", F.trim(x).cast("double"))).alias("y"))
    return nodes.join(labels, "node_id", "left"), marked, ys


def unpack_graphs(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """``graph_id, place, src, dst`` from flat ``edges(place, src, dst)`` and ``sizes(graph_id, n_edges)``: running offsets and an interval join."""
    bounds = running_sum(sizes, "graph_id", "n_edges", "high").select("graph_id", (F.col("high") - F.col("n_edges")).alias("low"), "high")
    return in_intervals(edges, "place", bounds, "low", "high").select("graph_id", "place", "src", "dst")


def attach_positional(df: DataFrame, attributes: dict[str, DataFrame], place: str = "place") -> DataFrame:
    """Columns of files aligned by position; their names must begin with ``node_`` or ``edge_``."""
    for name, values in attributes.items():
        if not name.startswith(("node_", "edge_")):
            raise ValueError(f"an attribute's name begins with node_ or edge_: {name}")
        df = df.join(values.select(place, F.col("value").alias(name)), place, "left")
    return df


def read_hetero(spark: SparkSession, folder: str) -> DataFrame:
    """``head_type, rel, tail_type, src, dst`` of a folder ``relations/<head>___<rel>___<tail>/edge.csv.gz``."""
    edges = spark.read.schema("src long, dst long").option("recursiveFileLookup", True).option("pathGlobFilter", "edge.csv*").csv(f"{folder}/relations")
    parts = F.split(F.element_at(F.split(F.input_file_name(), "/"), -2), "___")
    return edges.select(parts[0].alias("head_type"), parts[1].alias("rel"), parts[2].alias("tail_type"), "src", "dst")


def read_hetero_nodes(spark: SparkSession, folder: str, file: str, schema: str) -> DataFrame:
    """``node_type``, ``place`` (0-based row in its type) and the columns of ``schema``, from each ``<type>/<file>`` of a folder."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(f"{folder}/*/{file}").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    placed = with_index(lines, "_file", "_block", "_line", name="_at")
    first = placed.groupBy("_file").agg(F.min("_at").alias("_first"))
    row = F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "))
    return placed.join(first, "_file").select(F.element_at(F.split("_file", "/"), -2).alias("node_type"), (F.col("_at") - F.col("_first")).alias("place"), row.alias("_row")).select("node_type", "place", "_row.*")


def labels_of_types(labels: DataFrame, has_label: DataFrame) -> DataFrame:
    """``labels(node_type, ...)`` of the types that ``has_label(node_type, has_label)`` flags."""
    return labels.join(has_label.where("has_label").select("node_type"), "node_type", "left_semi")


def type_offsets(sizes: DataFrame) -> DataFrame:
    """``node_type, n, start``: first number of each type where types are numbered together, in order of their names."""
    return running_sum(sizes.select("node_type", "n"), "node_type", "n", "_upto").select("node_type", "n", (F.col("_upto") - F.col("n")).alias("start"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """``key, values`` of a JSON object of lists, or of a text with ``key: [a, b]`` or ``key:`` and ``- item`` lines; values are strings."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    asked = F.from_json("value", "map<string,string>")
    listed = F.coalesce(F.from_json("values", "array<string>"), F.array("values"))
    as_json = text.where(F.col("value").startswith("{")).select(F.explode(asked).alias("key", "values")).select("key", listed.alias("values"))
    block = F.regexp_extract_all("value", F.lit(r"(?m)(^[A-Za-z_][^:\n]*:[^\n]*(?:\n[ ]*-[^\n]*)*)"), 1)
    lines = text.where(~F.col("value").startswith("{")).select(F.explode(block).alias("b")).select(F.trim(F.regexp_extract("b", r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract("b", r"^[^:]*:([^\n]*)", 1)).alias("inline"), "b")
    items = F.when(F.col("inline") != "", F.split(F.regexp_replace("inline", r"^\[|\]$", ""), r"\s*,\s*")).otherwise(F.regexp_extract_all("b", F.lit(r"(?m)^[ ]*-[ ]*(.*?)[ ]*$"), 1))
    return as_json.unionByName(lines.select("key", F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")).alias("values")))


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables by role as one table with ``role``."""
    out = None
    for role, df in parts.items():
        tagged = df.withColumn("role", F.lit(role))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """``outer_k, inner_k, row_id, role`` of a JSON list of folds, in the form of ``nested_cv``.

    Each fold is ``{"test": [...], "model_selection": [{"train": [...], "validation": [...]}, ...]}``; its test rows have a null inner_k. A missing or
    null list has no rows. The format is one JSON value, so one task parses it; :func:`gneiss.sources.sinks.save_splits` keeps splits of any size.
    """
    shape = "array<struct<test: array<bigint>, model_selection: array<struct<train: array<bigint>, validation: array<bigint>>>>>"
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.posexplode(F.from_json("value", shape, {"mode": "FAILFAST"})).alias("outer_k", "o"))
    inner = outer.select("outer_k", F.posexplode("o.model_selection").alias("inner_k", "i"))
    test = outer.select("outer_k", F.lit(None).cast("int").alias("inner_k"), F.explode("o.test").alias("row_id"), F.lit("test").alias("role"))
    parts = [inner.select("outer_k", "inner_k", F.explode(f"i.{of}").alias("row_id"), F.lit(role).alias("role")) for of, role in (("train", "train"), ("validation", "valid"))]
    return test.unionByName(parts[0]).unionByName(parts[1])


def read_edge_split(spark: SparkSession, path: str) -> DataFrame:
    """``role, src, dst, label`` of the folders ``train``, ``valid`` and ``test`` with pairs ``edge`` and ``edge_neg``, or with ``source_node``, ``target_node`` and lists ``target_node_neg``."""
    out = None
    for role in ("train", "valid", "test"):
        df = spark.read.parquet(f"{path}/{role}")
        if "edge" in df.columns:
            parts = [df.select(F.col(c)[0].alias("src"), F.col(c)[1].alias("dst"), F.lit(y).alias("label")).where("src is not null") for c, y in (("edge", 1), ("edge_neg", 0)) if c in df.columns]
        else:
            parts = [df.select(F.col("source_node").alias("src"), F.col("target_node").alias("dst"), F.lit(1).alias("label"))]
            if "target_node_neg" in df.columns:
                parts.append(df.select(F.col("source_node").alias("src"), F.explode("target_node_neg").alias("dst"), F.lit(0).alias("label")))
        for part in parts:
            part = part.select(F.lit(role).alias("role"), "src", "dst", "label")
            out = part if out is None else out.unionByName(part)
    return out


def parsed_structures(df: DataFrame, id_: str, structure: str, parser: Callable[[str], tuple[list[dict], list[dict]] | None]) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds by a user's parser, a function from a structure string to rows of each, or None where it is invalid.

    It runs in tasks, on batches; rows need ``atom_idx, atomic_num`` and ``src, dst, type``.
    """
    shape = "atoms array<struct<atom_idx:long,atomic_num:int>>, bonds array<struct<src:long,dst:long,type:string>>"
    key = dict(df.dtypes)[id_]

    def run(batches):
        for batch in batches:
            found = [parser(s) if s is not None else None for s in batch.column(1).to_pylist()]
            good = [i for i, x in enumerate(found) if x is not None]
            atoms = [[{k: a.get(k) for k in ("atom_idx", "atomic_num")} for a in found[i][0]] for i in good]
            bonds = [[{k: b.get(k) for k in ("src", "dst", "type")} for b in found[i][1]] for i in good]
            types = [pa.list_(pa.struct([("atom_idx", pa.int64()), ("atomic_num", pa.int32())])), pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64()), ("type", pa.string())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array(atoms, types[0]), pa.array(bonds, types[1])], ["graph_id", "atoms", "bonds"])

    both = written(df.select(id_, structure).mapInArrow(run, f"graph_id {key}, {shape}"), "structures")
    return both.select("graph_id", F.explode("atoms").alias("x")).select("graph_id", "x.*"), both.select("graph_id", F.explode("bonds").alias("x")).select("graph_id", "x.*")


def read_network_community(spark: SparkSession, network: str, community: str) -> tuple[DataFrame, DataFrame]:
    """0-based unordered edges and blocks of a tab-separated pair of 1-based files."""
    pairs = spark.read.schema("a long, b long").option("sep", "\t").csv(network).select((F.least("a", "b") - 1).alias("src"), (F.greatest("a", "b") - 1).alias("dst")).distinct()
    return pairs, spark.read.schema("node long, block long").option("sep", "\t").csv(community).select((F.col("node") - 1).alias("node"), (F.col("block") - 1).alias("block"))


def dataset_config(spark: SparkSession, name: str, override: dict[str, str] | None = None) -> DataFrame:
    """The registry's row of a data set, with the user's values in place of its own."""
    df = spark.createDataFrame(REGISTRY, "name string, task_type string, split_type string, metric string").where(F.lower("name") == name.lower())
    return df.withColumns({k: F.lit(v) for k, v in (override or {}).items()})


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``config_id, outer_k, inner_k, metric, role, value`` from collected JSON files."""
    return spark.read.schema("config_id long, outer_k int, inner_k int, metric string, role string, value double").json(path)


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)
