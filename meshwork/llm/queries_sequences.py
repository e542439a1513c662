"""Queries of the operators on turns, windows of words and cuts of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm.fim import fill_in_middle
from meshwork.llm.prefix_trie import prefix_trie
from meshwork.llm.substring_dedup import substring_dedup


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


OP11_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS w FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT DISTINCT c, [ascii(substr(CAST(c AS VARCHAR), k, 1)) FOR k IN range(1, length(CAST(c AS VARCHAR)) + 1)] AS b FROM t),
k AS (SELECT c, xor(list_reduce(b, lambda a, x: list_reduce(range(8), lambda y, s: xor(y >> 1, 3988292384 * (y & 1)), xor(a, x::BIGINT)), 4294967295), 4294967295) % 9 AS h FROM bits),
r AS (SELECT t.c, 1 AS own, i, w FROM t JOIN k USING (c) WHERE i >= h
  UNION ALL SELECT k.c, 0, i, w FROM k JOIN t ON t.c = k.c - k.c % 5 AND i < h),
o AS (SELECT c, row_number() OVER u AS d, list(w) OVER u AS p FROM r WINDOW u AS (PARTITION BY c ORDER BY own, i)),
a AS (SELECT c, d, p FROM o UNION ALL SELECT c, 0, [] FROM k),
e AS (SELECT c, max(d) AS d FROM a GROUP BY c),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(strlen(p[-1].text)), 0) AS bytes FROM a GROUP BY p, d),
x AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM a JOIN e USING (c, d) GROUP BY p),
kids AS (SELECT p[:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
under AS (SELECT m.p[:j] AS p, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (kids.p IS NULL) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS j FROM n) m LEFT JOIN kids ON kids.p = m.p GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN under ON under.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN x ON x.p = n.p LEFT JOIN n up ON n.d > 0 AND up.p = n.p[:n.d - 1]
"""
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest([array_to_string(w[j:j + 19], ' ') FOR j IN range(1, len(w) - 18)]) AS v FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) > 1 AS again FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM k WHERE again),
y AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM d),
z AS (SELECT doc_id, count(x.i) AS gone, string_agg(v, ' ' ORDER BY i) FILTER (x.i IS NULL) AS kept FROM y LEFT JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM documents),
u AS (SELECT doc_id, t, k, len(k)::BIGINT AS n, [('0x' || h[1 + 8 * i : 8 + 8 * i])::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, k, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
       WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(k[1:a], ''), '') AS pre, coalesce(array_to_string(k[a + 1:b], ''), '') AS mid, coalesce(array_to_string(k[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
QUERIES = {f.__name__: f for f in (op11_prefix_trie, op12_substring_dedup, op13_fill_in_middle)}
ORACLE: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
