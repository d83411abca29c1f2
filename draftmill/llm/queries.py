"""The registered queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .exact import exact_dedup
from .languages import languages
from .lines import dedup_lines
from .maxent import language_scores
from .mixing import mix
from .negatives import hard_negatives
from .packing import pack
from .pii import digest, personal_data
from .rules import quality_rules
from .simhash import near_duplicates
from .token_counts import token_counts
from .trees import quality_scores
from .trie import prefix_trie


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), n AS (
  SELECT doc_id, pos, CASE WHEN regexp_full_match(line, '[\x20\x09-\x0D]*') THEN '' ELSE line END AS line FROM l
), w AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS LAST, pos) AS place FROM w WHERE c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '')
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r, range(3) AS s(k) WHERE place > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
  FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(kept.text, '') AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, step
), turns AS (
  SELECT conv.conv_id, own.pos, 0 AS later, role, text FROM conv JOIN own ON own.conv_id = base AND own.pos <= h
  UNION ALL SELECT conv.conv_id, own.pos, 1, role, text FROM conv JOIN own ON own.conv_id = conv.conv_id AND own.pos > h
), paths AS (
  SELECT conv_id, row_number() OVER o AS depth, strlen(text) AS bytes, string_agg(md5(role) || md5(text), '' ) OVER o AS path
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY later, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS at_end FROM paths
), node AS (
  SELECT path, depth, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM ended GROUP BY ALL
), child AS (
  SELECT a.*, b.conv_id AS parent_conv_id, b.path AS parent FROM node a LEFT JOIN node b ON b.depth = a.depth - 1 AND b.path = left(a.path, 64 * b.depth::INT)
), kids AS (
  SELECT parent, count(*) AS n FROM child WHERE parent IS NOT NULL GROUP BY 1
), full_node AS (
  SELECT child.*, coalesce(n, 0) AS n_children FROM child LEFT JOIN kids ON kids.parent = child.path
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.bytes) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_node a JOIN full_node b ON b.depth >= a.depth AND left(b.path, 64 * a.depth::INT) = a.path
GROUP BY ALL
"""

def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW o AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER o <= 10
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op6_line_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
