"""Queries of the operators on vectors and web archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm.embedding_dedup import near_dedup
from meshwork.llm.warc import archive


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT h, min(page_id) AS m FROM p GROUP BY h),
q AS (SELECT p.*, m, [('0x' || s[1 + 10 * i : 10 + 10 * i])::BIGINT FOR i IN range(4)] AS w FROM p JOIN g USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w[1 + k // 8] >> (35 - 5 * (k % 8))) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM q
"""
OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
n AS (SELECT u, count(*) AS k FROM links GROUP BY u),
reach(u, w) USING KEY (u) AS (SELECT vec_id, vec_id FROM v UNION
  SELECT l.u, min(p.w) AS m FROM links l JOIN reach p ON p.u = l.w JOIN recurring.reach q ON q.u = l.u WHERE p.w < q.w GROUP BY l.u)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, reach.w AS component_id, v.vec_id = reach.w AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id JOIN reach ON reach.u = v.vec_id
"""
QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op9_warc)}
ORACLE: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op9_warc": OP9_SQL}
