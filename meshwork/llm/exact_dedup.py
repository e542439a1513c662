"""Exact dedup by skew-safe combining, with DataFrame functions only.

1. local: Spark's partial aggregate collapses equal texts inside each scan task before anything moves;
2. salted: groups of (digest, salt, text) merge, the salt being a hash of the id, so a hot text is spread over all salts;
3. global: the salt winners, at most ``salts`` rows per distinct text, merge by (digest, text).

Every stage groups by the full normalised text as well as by its digest, so a digest collision never merges texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.plans.durable import written

#: A text held by at least this share of all rows is hot; so there are at most 1 / HOT_SHARE of them to broadcast.
HOT_SHARE = 1 / 1000
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=_sha256) -> DataFrame:
    """Label every row with the group of rows whose normalised text equals its own.

    Returns one row per input row: id, keep_id (smallest id of the group), group_size, kept (id = keep_id), text_sha256.
    Null texts count as empty. Null ids never win over other ids; a group of null ids only has keep_id null and its rows
    are kept. Rows that repeat an id within a group carry the same labels. An empty table gives an empty result.
    Other columns, whatever their names, are ignored. ``digest`` may be any function of the text, even one that collides.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), norm.alias("__text")).select(
        "__id", "__text", digest(F.col("__text")).alias("__digest"), F.pmod(F.xxhash64("__id"), F.lit(salts)).alias("__salt")
    )
    salted = rows.groupBy("__digest", "__salt", "__text").agg(F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n"))
    merged = salted.groupBy("__digest", "__text").agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    groups = written(merged.select("__digest", "keep_id", "group_size"), "groups")
    total, texts, digests = groups.agg(F.sum("group_size"), F.count(F.lit(1)), F.countDistinct("__digest")).first()
    if texts != digests:  # texts that share a digest: their rows are told apart by the text itself
        keep = rows.join(merged, ["__digest", "__text"], "left")
    else:
        hot = groups.where(F.col("group_size") >= max(2, int((total or 0) * HOT_SHARE)))
        hot = hot.select(F.col("__digest").alias("__hot"), F.col("keep_id").alias("__hk"), F.col("group_size").alias("__hn"))
        if total and hot.limit(int(1 / HOT_SHARE) + 1).count() <= 1 / HOT_SHARE:
            rows = rows.join(F.broadcast(hot), rows["__digest"] == hot["__hot"], "left")
        else:
            rows = rows.withColumns({"__hot": F.lit(None).cast("string"), "__hk": F.lit(None).cast(rows.schema["__id"].dataType), "__hn": F.lit(None).cast("long")})
        # rows of hot texts are settled already: a key of their own spreads them over the shuffle, where they match nothing
        own = F.when(F.col("__hot").isNull(), F.col("__digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("__id").cast("string")))
        cold = groups.withColumnRenamed("__digest", "__key")
        keep = rows.withColumn("__key", own).join(cold, "__key", "left").select(
            "__id", "__text", "__digest", F.when(F.col("__hot").isNull(), F.col("keep_id")).otherwise(F.col("__hk")).alias("keep_id"),
            F.coalesce("__hn", "group_size").alias("group_size"),
        )
    sha = F.col("__digest") if digest is _sha256 else _sha256(F.col("__text"))
    return keep.select(
        F.col("__id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns; of rows that repeat an id and text, one stays.

    Null ids cannot be told apart by an id, so of a group that has null ids only, one row stays.
    """
    labels = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col(id_col).alias("__kid"), F.col("text_sha256").alias("__ksha")
    ).dropDuplicates(["__kid", "__ksha"])
    # in a struct, own columns can have any names
    rows = docs.select(docs[id_col].alias("__id"), _sha256(normalised(docs[text_col])).alias("__sha"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    found = rows.join(labels, F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__sha") == F.col("__ksha")), "inner")
    return found.dropDuplicates(["__kid", "__ksha"]).select("__row.*")
