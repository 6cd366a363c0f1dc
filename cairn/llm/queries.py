"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import cube, hnsw, huffman, licenses, odd_sketch, packing, prefix_counts, quality, secret_net, topk
from cairn.llm.common import table
from cairn.llm.tokens import tokenizer_path

WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents"))


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.new_path(spark)
    huffman.write(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_TOKENIZER))
    return huffman.read(spark, path)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_net.scan(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op4, which SQL can express."""
    return cube.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of op7, which SQL can express."""
    return secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of op8, which SQL can express."""
    return token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts end for budgets of 128 and 1,024 tokens, looked up among the counts of all prefixes."""
    return prefix_counts.budgets(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns of op9, which SQL can express."""
    return license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_classifier,
    "op2_exact_top_k": exact_top_k,
    "op3_embedding_near_dedup": embedding_near_dedup,
    "op4_source_mixing": source_mixing,
    "op5_sequence_packing": sequence_packing,
    "op6_token_id_output": token_id_output,
    "op7_secret_scan": secret_scan,
    "op8_token_counts": token_counts,
    "op9_license_scan": license_scan,
    "op10_minhash_near_dedup": minhash_near_dedup,
    "mixing_targets": mixing_targets,
    "secret_counts": secret_counts,
    "token_bytes": token_bytes,
    "token_budgets": token_budgets,
    "license_base": license_base,
}

_VECTORS = """
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": f"""
WITH w AS ({_VECTORS}),
v AS (SELECT vec_id, list_transform(v, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM w),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
""",
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
w AS ({_VECTORS.replace("SELECT vec_id", "SELECT r, vec_id").replace("FROM embeddings", "FROM every")}),
v AS (SELECT r, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM w WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.n * b.n) >= 0.9
), reach AS (
  SELECT r, vec_id AS low FROM every
  UNION SELECT links.b, reach.low FROM reach JOIN links ON reach.r = links.a
), low AS (SELECT r, min(low) AS component_id FROM reach GROUP BY r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.component_id, coalesce(e.vec_id = low.component_id, e.vec_id IS NULL AND low.component_id IS NULL) AS kept
FROM every e JOIN low USING (r) LEFT JOIN n ON n.a = e.r
""",
    "op10_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), one AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL),
links AS (
  SELECT DISTINCT a, b FROM (
    SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.r, a.doc_id, b.r, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
  )
), reach AS (
  SELECT doc_id, doc_id AS low FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT links.b, reach.low FROM reach JOIN links ON reach.doc_id = links.a
), low AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, low.component_id, coalesce(s.doc_id = low.component_id, true) AS kept
FROM s LEFT JOIN low USING (doc_id)
""",
    "mixing_targets": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s),
c AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM w),
o AS (
  SELECT *, cap / weight AS capped_at,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM c WINDOW before AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, capped_at) FILTER (WHERE level <= capped_at) AS level FROM o)
SELECT d.doc_id, d.size, o.source_size, round(coalesce(least(o.cap, l.level * o.weight), o.cap), 3) AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source CROSS JOIN l
""",
    "secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
""",
    "token_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "license_base": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c
  FROM t
), q AS (SELECT *, list_concat(list_concat(a, b), c) AS every FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels
FROM q
""",
}
