"""The corpus pipeline: five stages over ``documents``, each a function (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from meshwork.llm.queries_text import vocabulary
from meshwork.plans.durable import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.3 stay. The labels are the given ones; texts come from the stage's input."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "__score"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.3).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3, repeating, none beyond 3 times its size."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to the row's text."""
    ids = bpe.encode(docs, vocabulary())
    back = bpe.decode(ids, vocabulary())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return back.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A learnt score, a random key and merges can't be told in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
