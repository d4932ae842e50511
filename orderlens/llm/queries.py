"""Registered queries of the corpus operators and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import bpe, centroids, context_tree, conversation_repair, exact_dedup, kd_shards, language_id, licenses, line_dedup, mixing, near_dedup, quality, vector_search
from orderlens.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_documents(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_table(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.memberships(exact_dedup.build_index(documents(spark, sf_dir).select("doc_id", "text")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_table(documents(spark, sf_dir), near_dedup.Rule(words=3, percent=85))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_table(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_license_scan, op2_bpe, op3_sharding, op4_language_id, op5_quality, op6_line_dedup, op7_mixing, op8_nearest_neighbours, op9_exact_dedup,
    op10_near_dedup, op11_conversation_repair, op12_centroids, op13_context_tree)}

ORACLE: dict[str, str] = {
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_centroids": centroids.oracle(),
    "op6_line_dedup": r"""
WITH whole_lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM whole_lines),
classes AS (SELECT line, length(line) AS n, min({'no_id': doc_id IS NULL, 'doc_id': doc_id, 'line_no': line_no}) AS ord
            FROM places WHERE line <> '' GROUP BY line),
variants AS (SELECT line, ord, n, unnest(range(1, n + 1)) AS i FROM classes),
cut AS (SELECT line, ord, n, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM variants),
replaced AS (SELECT line, ord, min(ord) OVER (PARTITION BY v, i, n) AS other FROM cut),
put_in AS (SELECT c.line AS long_line, c.ord AS long_ord, s.line AS short_line, s.ord AS short_ord
           FROM cut c JOIN classes s ON c.v = s.line),
near AS (
  SELECT line, min(other) AS earlier FROM (
    SELECT line, other FROM replaced WHERE other < ord
    UNION ALL SELECT long_line, short_ord FROM put_in WHERE short_ord < long_ord
    UNION ALL SELECT short_line, long_ord FROM put_in WHERE long_ord < short_ord) GROUP BY line)
SELECT p.doc_id, p.line_no, coalesce(n.earlier, c.ord).doc_id AS keep_doc_id,
       coalesce(n.earlier, c.ord).line_no AS keep_line_no, CASE WHEN n.earlier IS NULL THEN 0 ELSE 1 END AS distance
FROM places p JOIN classes c ON c.line = p.line LEFT JOIN near n ON n.line = p.line
WHERE n.earlier IS NOT NULL OR NOT (p.doc_id IS NOT DISTINCT FROM c.ord.doc_id AND p.line_no = c.ord.line_no)""",
    "op7_mixing": r"""
WITH measured AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ((('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
shares AS (
  SELECT *, CASE WHEN length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) > 0
                 THEN length(regexp_replace(t, '\P{L}+', '', 'g'))::DOUBLE
                      / length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) ELSE 0.0 END AS letters
  FROM measured),
keyed AS (
  SELECT doc_id, source, size,
         floor(-ln(u) / (0.05::DOUBLE + 0.95::DOUBLE * letters * letters) * 17179869184.0)::BIGINT AS k FROM shares),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM keyed GROUP BY source),
ranked AS (
  SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS r,
         lead(cap / w) OVER (ORDER BY cap / w, source NULLS LAST) AS next_ratio
  FROM sources WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
total AS (SELECT 1.5::DOUBLE * sum(source_size) AS wanted, sum(w) AS w FROM sources),
levels AS (
  SELECT 0 AS r, wanted / w AS level, (SELECT min(cap / w) FROM sources) AS next_ratio FROM total
  UNION ALL SELECT r, (wanted - caps) / (total.w - ws), next_ratio FROM ranked, total WHERE total.w > ws),
level AS (SELECT min_by(level, r) AS level FROM levels WHERE next_ratio > level),
targets AS (
  SELECT source, source_size, least(cap, level * w) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, level * w) / source_size) ELSE 0 END AS epochs
  FROM sources, level),
summed AS (
  SELECT k.doc_id, k.source, k.size, k.k, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS want,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k)::DOUBLE AS through,
         sum(k.size) OVER (PARTITION BY k.source, k.k)::DOUBLE AS here
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
crossing AS (
  SELECT source, min_by(k, k) AS cut, min_by(through, k) AS through, min_by(through - here, k) AS below
  FROM summed WHERE want > 0 AND through >= want GROUP BY source)
SELECT s.doc_id, s.source, s.size::BIGINT AS size, s.source_size::BIGINT AS source_size, s.target,
       (s.size * (s.epochs + CASE WHEN s.want > 0 AND s.k <= c.cut
         AND (s.k < c.cut OR c.through - s.want <= s.want - c.below) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed s LEFT JOIN crossing c ON s.source IS NOT DISTINCT FROM c.source""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id
           GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
          WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
          UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c ON c.doc_id = d.doc_id""",
}
