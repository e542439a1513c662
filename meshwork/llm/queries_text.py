"""Queries of the operators that work on texts in Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import bpe
from meshwork.llm.jaccard_join import jaccard_join
from meshwork.llm.license_scan import SPREAD, TEMPLATES, THRESHOLD, license_scan, words
from meshwork.llm.quality import quality
from meshwork.llm.toxicity import toxicity


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = bpe.encode(docs, vocabulary()).drop("text")
    back = bpe.decode(ids, vocabulary())
    return back.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own, places = F.col("phrases.label"), F.col("blocks.label"), F.col("phrases.word")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _templates() -> str:
    """(label, template, token, distinct tokens, tokens needed, most words of a window), by template and token."""
    rows = []
    for k, (label, text) in enumerate(TEMPLATES):
        tokens = sorted({t.decode() for t in words(text)})
        need, span = max(1, math.ceil(THRESHOLD * len(tokens) - 1e-9)), math.ceil(SPREAD * len(words(text)))
        rows += [f"('{label}', {k}, '{t}', {len(tokens)}, {need}, {span})" for t in tokens]
    return ", ".join(rows)


_WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license')) AS i, 'mit' AS label FROM d
  UNION ALL SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license')), 'apache' FROM d
  UNION ALL SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')), 'gpl' FROM d),
b AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
tpl(label, k, word, size, need, span) AS (VALUES {_templates()}),
m AS (SELECT doc_id, label, k, word, size, need, span, i FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) JOIN tpl USING (word)),
win AS (SELECT doc_id, label, size, need,
  count(DISTINCT word) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN span - 1 PRECEDING AND CURRENT ROW) AS n FROM m),
hit AS (SELECT doc_id, label, n::DOUBLE / size AS c FROM win WHERE n >= need),
every AS (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM hit),
a AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
s AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, b.f AS first_word, b.l AS last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.c, 0.0) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""
QUERIES = {f.__name__: f for f in (op2_bpe, op3_toxicity, op5_license_scan, op10_quality)}
ORACLE: dict[str, str] = {"op5_license_scan": OP5_SQL}


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


QUERIES["op7_jaccard_join"] = op7_jaccard_join
