"""Token sequences over documents, turns and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.catalog.base import Found, table
from gneiss.functions import sequences as S

found = query = Found()
WORD = "([A-Za-z]+|[0-9])"
WORDS = f"words AS (SELECT doc_id, regexp_extract_all(text, '{WORD}', 1) AS tokens FROM documents)"
VOCAB = f"vocab AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}', 1)) AS token FROM benchmark))"


def words(spark, d, name="documents", key="doc_id"):
    return table(spark, d, name).select(key, S.tokenize(F.col("text"), WORD).alias("tokens"))


def vocab(spark, d):
    return S.build_vocab(words(spark, d, "benchmark", "item_id"), "tokens")


@query(f"WITH {WORDS} SELECT doc_id, tokens FROM words")
def seq1_tokenize(spark, d):
    return words(spark, d)


@query("SELECT p_partkey, regexp_extract_all(p_type, '(\\[[^\\[\\]]+\\]|Br|Cl|N|O|S|P|F|I|B|C|b|c|n|o|s|p|\\(|\\)|\\.|=|#|-|\\+|\\\\|\\/|:|~|@|\\?|>|\\*|\\$|%[0-9]{2}|[0-9])', 1) AS tokens FROM part")
def seq1_structure_pattern(spark, d):
    return table(spark, d, "part").select("p_partkey", S.tokenize(F.col("p_type")).alias("tokens"))


@query(f"WITH {VOCAB} SELECT * FROM vocab")
def seq2_seq11_vocab(spark, d):
    return vocab(spark, d)


@query(f"WITH {WORDS}, {VOCAB}, e AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM words) SELECT w.doc_id, coalesce(ids, []) AS ids, coalesce(n, 0) AS n_unknown FROM words w LEFT JOIN (SELECT doc_id, list(coalesce(id, -1) ORDER BY i) AS ids, sum((id IS NULL)::INT)::BIGINT AS n FROM e LEFT JOIN vocab USING (token) GROUP BY doc_id) USING (doc_id)")
def seq3_encode(spark, d):
    return S.encode(words(spark, d), "doc_id", "tokens", vocab(spark, d))


@query(f"WITH {VOCAB}, w AS (SELECT item_id, regexp_extract_all(text, '{WORD}', 1) AS tokens FROM benchmark) SELECT item_id, trim(replace(array_to_string(tokens, ' '), ' ##', '')) AS text FROM w")
def seq4_decode(spark, d):
    v = vocab(spark, d)
    ids = S.encode(words(spark, d, "benchmark", "item_id"), "item_id", "tokens", v)
    return S.decode(ids, "item_id", "ids", v)


@query(f"WITH w AS (SELECT item_id, regexp_extract_all(text, '{WORD}', 1) AS t FROM benchmark) SELECT item_id, ['[CLS]'] || t || ['[SEP]'] AS one, ['[CLS]'] || t || ['[SEP]'] || t || ['[SEP]'] AS two FROM w")
def seq5_specials(spark, d):
    t = words(spark, d, "benchmark", "item_id")
    return t.select("item_id", S.add_specials(F.col("tokens")).alias("one"), S.add_specials(F.col("tokens"), F.col("tokens")).alias("two"))


@query(f"WITH {WORDS} SELECT doc_id, list_transform(range(1, 65), lambda i: CASE WHEN i <= len(tokens) THEN tokens[i] ELSE '[PAD]' END) AS tokens, list_transform(range(1, 65), lambda i: (i <= len(tokens))::INT) AS mask, list_transform(range(1, 9), lambda i: CASE WHEN i > 8 - len(tokens[1:4]) THEN tokens[1:4][(i - 8 + len(tokens[1:4]))::INT] ELSE '[PAD]' END) AS left_padded FROM words")
def seq6_seq7_pad_batch(spark, d):
    cut, mask = S.encode_batch(F.col("tokens"), 64, S.PAD)
    return words(spark, d).select("doc_id", cut.alias("tokens"), mask.alias("mask"), S.pad(F.slice("tokens", 1, 4), 8, S.PAD, right=False).alias("left_padded"))


@query(f"WITH {WORDS} SELECT max(len(tokens))::INT AS max_length FROM words")
def seq8_max_length(spark, d):
    return S.max_length(words(spark, d), "tokens")


@query("SELECT p_partkey, replace(replace(p_type, 'Br', 'R'), 'Cl', 'L') AS collapsed FROM part")
def seq9_collapse(spark, d):
    return table(spark, d, "part").select("p_partkey", S.collapse_halogen(F.col("p_type")).alias("collapsed"))


@query("SELECT p_partkey, regexp_extract_all(p_name, '(\\[[^\\[\\]]{1,10}\\]|.)', 1) AS units FROM part")
def seq10_units(spark, d):
    return table(spark, d, "part").select("p_partkey", S.split_units(F.col("p_name")).alias("units"))


@query("""WITH u AS (SELECT p_partkey, regexp_extract_all(p_name, '(\\[[^\\[\\]]{1,10}\\]|.)', 1) AS t FROM part), v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(t) AS token FROM u)),
e AS (SELECT p_partkey, list(id ORDER BY i) AS ids FROM (SELECT p_partkey, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM u) JOIN v USING (token) GROUP BY ALL), m AS (SELECT max(len(ids)) AS n FROM e)
SELECT p_partkey, len(ids)::INT AS length, list_transform(range(1, n + 1), lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE -1 END) AS ids, list_transform(range(1, n + 1), lambda i: (i <= len(ids))::INT) AS mask FROM e, m""")
def seq12_seq13_units_padded(spark, d):
    units = table(spark, d, "part").select("p_partkey", S.split_units(F.col("p_name")).alias("tokens"))
    ids = S.encode(units, "p_partkey", "tokens", S.build_vocab(units, "tokens"))
    return S.pad_sorted(ids, "ids", -1, ["p_partkey"])


@query(f"WITH {WORDS}, {VOCAB}, c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM words) GROUP BY token) SELECT token, n, v.id IS NOT NULL AS known FROM c LEFT JOIN vocab v USING (token)")
def seq14_token_profile(spark, d):
    return S.token_profile(words(spark, d), "tokens", vocab(spark, d))
