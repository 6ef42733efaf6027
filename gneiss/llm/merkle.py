"""A Merkle manifest by time-forward processing: digests rise in the order of node labels, proofs come back in the reversed order.

A node's label is its time: the last leaf under it, then its level. So children come before their parents. A sweep reads
rows in the order of labels; a priority queue on labels holds each digest until its parent's time. Between sweeps the queue is
a written table, dealt and sorted by label by Spark. A sweep lifts blocks of 512 leaves by three levels, so ten thousand million documents
take four sweeps, and a task's queue holds a few digests a level. The way back reads the same nodes with labels descending: a
node gets its proof's upper part from the queue and sends each child its siblings in front of that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import table, written
from gneiss.plans.rank import with_index

FAN = 3  # bits of a child's place: runs of 8
LIFT = 3  # levels of a sweep
BLOCK = FAN * LIFT  # bits of a leaf's place in its block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "tree long, n long, level int, at long, digest binary, children array<binary>"
_WAY = "tree long, n long, level int, at long, sub binary, way array<binary>"
_PROOF = "doc_id long, leaf string, subroot string, folded binary, proof_sha256 string"


def _levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    up = 0
    while n > 1:
        n, up = -(-n >> FAN), up + 1
    return up


def _last(n: int, level: int, at: int) -> int:
    return min((at + 1) << (FAN * level), n) - 1


def _hash(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256))


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes above the rows ``tree, n, at, digest``, which come in order, up to ``LIFT`` levels."""
    queue: list[tuple[int, int, int, int, int, bytes]] = []  # tree, last leaf, level, place, number of leaves, digest
    out: list[tuple] = []

    def send(tree: int, n: int, level: int, at: int, digest: bytes) -> None:
        if level < min(LIFT, _levels(n)):
            heapq.heappush(queue, (tree, _last(n, level + 1, at >> FAN), level + 1, at, n, digest))

    def settle(tree: float, last: int) -> None:
        """Nodes whose time is before that of leaf ``last`` of ``tree``."""
        while queue and queue[0][:2] < (tree, last):
            label, children = queue[0][:3], []
            while queue and queue[0][:3] == label:
                *_, at, n, digest = heapq.heappop(queue)
                children.append(digest)
            made = (label[0], n, label[2], at >> FAN, _hash(children), children)
            out.append(made)
            send(*made[:5])

    def told() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tree", "n", "level", "at", "digest", "children"])

    for batch in batches:
        for tree, n, at, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "at", "digest")), strict=True):
            settle(tree, at)
            send(tree, n, 0, at, digest)
        yield told()
    settle(float("inf"), 0)
    yield told()


def _lift(n: Column) -> Column:
    """Levels that a sweep climbs in a tree of ``n`` leaves."""
    return sum((F.when(n > (1 << (FAN * k)), 1).otherwise(0) for k in range(LIFT)), F.lit(0))


def _climbed(leaves: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """``(leaves, nodes)`` of each sweep over ``leaves(tree, n, at, digest)``; the leaves of the last are alone in their trees."""
    sweeps = []
    while True:
        many = leaves.where("n > 1")
        if many.isEmpty():
            return [*sweeps, (leaves, None)]
        dealt = many.select("tree", "n", "at", "digest", F.shiftright("at", BLOCK).alias("block")).repartition("tree", "block").sortWithinPartitions("tree", "at")
        nodes = written(dealt.mapInArrow(_rise, _NODE), "merkle-nodes")
        sweeps.append((leaves, nodes))
        lift = _lift(F.col("n"))
        tops = nodes.where(F.col("level") == lift).select("tree", F.ceil(F.col("n") / F.call_function("shiftleft", F.lit(1).cast("long"), FAN * lift)).alias("n"), "at", "digest")
        leaves = written(tops, "merkle-tops")


def _back(batches: Iterator[pa.RecordBatch], leaves: bool) -> Iterator[pa.RecordBatch]:
    """The reversed sweep: rows come with labels descending, a block's way to the root before its nodes, nodes before leaves.

    ``leaves``: what arrives at a leaf meets the document there; otherwise it is returned as the way of the sweep below.
    """
    queue: list[tuple] = []  # negated tree, last leaf, level, place; then the way, of which nodes share their upper parts

    def arrived(tree: int, last: int, level: int, at: int) -> tuple:
        label = (-tree, -last, -level, -at)
        while queue[0][:4] < label:  # tops of blocks without rows of their own don't occur, so nothing is passed over
            heapq.heappop(queue)
        return heapq.heappop(queue)

    def flat(way: tuple | None) -> list[bytes]:
        out = []
        while way is not None:
            out += way[:2]
            way = way[2]
        return out

    for batch in batches:
        out: list[tuple] = []
        rows = batch.to_pydict()
        for k, (tree, n, level, at, kind) in enumerate(zip(*(rows[c] for c in ("tree", "n", "level", "at", "kind")), strict=True)):
            last = _last(n, level, at)
            if kind == 0:
                parts, way = rows["way"][k], None
                for p in range(len(parts) - 2, -1, -2):
                    way = (parts[p], parts[p + 1], way)
                heapq.heappush(queue, (-tree, -last, -level, -at, k, n, rows["sub"][k], way))
            elif level:
                *_, sub, way = arrived(tree, last, level, at)
                children = [c.hex().encode() for c in rows["children"][k]]
                for p in range(len(children)):
                    own, low = (b"".join(children[:p]), b"".join(children[p + 1 :]), way), (at << FAN) + p
                    if level > 1 or leaves:
                        heapq.heappush(queue, (-tree, -_last(n, level - 1, low), 1 - level, -low, 0, n, sub, own))
                    else:
                        out.append((tree, n, 0, low, sub, flat(own)))
            else:
                *_, sub, way = arrived(tree, last, 0, at)
                digest, parts = rows["tampered"][k] or rows["digest"][k], flat(way)
                for p in range(0, len(parts), 2):
                    digest = sha256(parts[p] + digest.hex().encode() + parts[p + 1]).digest()
                out.append((rows["doc_id"][k], rows["digest"][k].hex(), sub.hex(), digest, sha256(b"".join(parts)).hexdigest()))
        if leaves:
            names, kinds = ["doc_id", "leaf", "subroot", "folded", "proof_sha256"], (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
        else:
            names, kinds = ["tree", "n", "level", "at", "sub", "way"], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        cols = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _returned(ways: DataFrame, nodes: DataFrame | None, documents: DataFrame | None) -> DataFrame:
    """One reversed sweep: ``ways`` of the tops, the sweep's nodes, and documents where its leaves are documents."""
    none = lambda kind: F.lit(None).cast(kind)
    cols = {"sub": "binary", "way": "array<binary>", "children": "array<binary>", "doc_id": "long", "digest": "binary", "tampered": "binary"}

    def like(df: DataFrame, kind: int) -> DataFrame:
        return df.select("tree", "n", "level", "at", F.lit(kind).alias("kind"), *(F.col(c).alias(c) if c in df.columns else none(t).alias(c) for c, t in cols.items()))

    rows = like(ways, 0)
    if nodes is not None:
        rows = rows.unionByName(like(nodes.drop("digest"), 1))
    if documents is not None:
        rows = rows.unionByName(like(documents.withColumn("level", F.lit(0)), 1))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), FAN * F.col("level"))
    rows = rows.withColumn("block", F.shiftright(F.col("at") * wide, BLOCK)).withColumn("last", F.least((F.col("at") + 1) * wide, F.col("n")) - 1)
    dealt = rows.repartition("tree", "block").sortWithinPartitions(F.desc("tree"), F.desc("block"), F.desc("last"), F.desc("level"), "kind")
    leaves = documents is not None
    return dealt.drop("block", "last").mapInArrow(lambda batches: _back(batches, leaves), _PROOF if leaves else _WAY)


def _descended(sweeps: list[tuple[DataFrame, DataFrame]], ways: DataFrame, documents: DataFrame | None) -> DataFrame:
    """``ways(tree, sub, way)`` of the trees' roots brought down all sweeps: ways of the leaves, or proofs of ``documents``."""
    sent = None
    for k in range(len(sweeps) - 1, -1, -1):
        leaves, nodes = sweeps[k]
        lift = _lift(F.col("n"))
        alone = leaves.where("n = 1").select("tree", "n", "at").join(ways, "tree")  # trees that end here get the way of their root
        if nodes is None:
            got = alone.select("tree", "n", F.lit(0).alias("level"), "at", "sub", "way")
        else:
            tops = nodes.where(F.col("level") == lift).select("tree", "n", "level", "at")
            above = sent.select("tree", "at", "sub", "way")  # what the sweep above sent to its leaves: this sweep's tops
            got = tops.join(above, ["tree", "at"]).select("tree", "n", "level", "at", "sub", "way")
            got = got.unionByName(alone.select("tree", "n", F.lit(0).alias("level"), "at", "sub", "way"))
        if k == 0 and documents is not None:
            return _returned(got, nodes, documents)
        if nodes is None:
            sent = written(got, "merkle-ways")
        else:
            down = _returned(got.where("level > 0"), nodes, None)
            sent = written(down.unionByName(got.where("level = 0")), "merkle-ways")
    return sent


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs(doc_id, source, lang, n_chars, text)``.

    Nulls have a mark of their own in a leaf. Languages ascend with null first; in a language documents ascend by doc_id, null
    first, and rows that repeat a doc_id by their digests, so equal rows are equal leaves side by side. A null doc_id is never
    tampered with. Other columns are ignored. An empty table gives no rows; a single document is its own subroot and root, with
    an empty proof.
    """
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = written(rows.select("doc_id", "lang", leaf_digest(F.col("text")).alias("digest"), F.when(touched, leaf_digest(F.translate("text", UPPER, LOWER))).alias("tampered")), "merkle-leaves")
    placed = with_index(leaves, "lang", "doc_id", "digest", name="place")
    langs = with_index(placed.groupBy(F.col("lang").alias("own")).agg(F.min("place").alias("first"), F.count("*").alias("n")), "own", name="tree")
    documents = placed.join(langs, F.col("lang").eqNullSafe(F.col("own"))).select("tree", "n", (F.col("place") - F.col("first")).alias("at"), "doc_id", "digest", "tampered")
    documents = written(documents, "merkle-documents")
    if documents.isEmpty():
        return documents.select("doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    sweeps = _climbed(documents.select("tree", "n", "at", "digest"))
    subroots = sweeps[0][0].where("n = 1").select("tree", "digest")
    for leaves, _ in sweeps[1:]:
        subroots = subroots.unionByName(leaves.where("n = 1").select("tree", "digest"))
    subroots = written(subroots, "merkle-subroots")
    count = subroots.count()
    above = _climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("at"), "digest"))
    root = bytes(above[-1][0].first()["digest"])
    top = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(root).alias("sub"), F.array().cast("array<binary>").alias("way"))
    to_languages = _descended(above, top, None).select(F.col("at").alias("tree"), "way").join(subroots.withColumnRenamed("digest", "sub"), "tree")
    proofs = _descended(sweeps, written(to_languages, "merkle-ways"), documents)
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"))

OP11_SQL = r"""
with recursive crc_table as (
    select list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t from range(256) r(i)
), tampered as (
    select d.*, coalesce(xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 3 = 0, false) touched
    from documents d, crc_table
), fields as (
    select doc_id, lang, touched, [doc_id::varchar, source, lang, n_chars::varchar] parts, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from tampered
), heads as (
    select *, array_to_string(list_transform(parts, lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')), '') head from fields
), leaf as (
    select doc_id, lang, sha256(head || coalesce(strlen(text)::varchar || ':' || text, '-')) digest, case when touched then sha256(head || coalesce(strlen(low)::varchar || ':' || low, '-')) end other from heads
), placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, digest) - 1 spot, count(*) over (partition by lang) n from leaf
), up(level, lang, spot, n, digest) as (
    select 0, lang, spot, n, digest from placed
    union all
    select level + 1, lang, spot // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by spot)) from up where n > 1 group by level, lang, spot // 8
), subroots as (
    select lang, digest subroot, row_number() over (order by lang nulls first) - 1 spot, count(*) over () n from up where n = 1
), top(level, spot, n, digest) as (
    select 0, spot, n, subroot from subroots
    union all
    select level + 1, spot // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by spot)) from top where n > 1 group by level, spot // 8
), sides as (
    select level, lang, spot, string_agg(digest, '') over (partition by level, lang, spot // 8 order by spot rows between unbounded preceding and 1 preceding) b, string_agg(digest, '') over (partition by level, lang, spot // 8 order by spot rows between 1 following and unbounded following) a from up where n > 1
), top_sides as (
    select level, spot, string_agg(digest, '') over (partition by level, spot // 8 order by spot rows between unbounded preceding and 1 preceding) b, string_agg(digest, '') over (partition by level, spot // 8 order by spot rows between 1 following and unbounded following) a from top where n > 1
), steps as (
    select p.lang, p.spot, s.level, coalesce(s.b, '') b, coalesce(s.a, '') a from placed p join sides s on s.lang is not distinct from p.lang and s.spot = p.spot >> (3 * s.level)
    union all
    select p.lang, p.spot, 1000 + s.level, coalesce(s.b, ''), coalesce(s.a, '') from placed p join subroots r on r.lang is not distinct from p.lang join top_sides s on s.spot = r.spot >> (3 * s.level)
), ways as (
    select lang, spot, sha256(string_agg(b || a, '' order by level)) proof_sha256, list(b || '|' || a order by level) way from steps group by lang, spot
), folded as (
    select p.doc_id, p.digest leaf, r.subroot, t.digest root, coalesce(w.proof_sha256, sha256('')) proof_sha256, list_reduce([coalesce(p.other, p.digest)] || coalesce(w.way, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) folded_root
    from placed p join subroots r on r.lang is not distinct from p.lang cross join (select digest from top where n = 1) t left join ways w on w.lang is not distinct from p.lang and w.spot = p.spot
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from folded
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
