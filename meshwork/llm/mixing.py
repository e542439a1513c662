"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys; equal ranges of the key space within a source are buckets of about ``bucket_rows`` rows,
so that a source with a third of all rows is only a source with more buckets. Rows are sorted inside their bucket,
token counts are summed per bucket, and the prefix sums of bucket totals plus the running sum inside a bucket place
each row on its source's line of words, which is cut at the source's exact budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.plans.durable import written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Share the words of all sources by weight; no source gets more than ``cap`` times its size.

    ``sizes`` has source, source_size, n_rows (one row per source). Sources take the weights in code-point order, null
    last. What capped sources leave is shared again by weight; sorted by cap / weight, the capped ones come first.
    Adds rank, target (double) and budget (the target to the nearest word).
    """
    line = Window.orderBy(F.col("source").isNull(), "source")
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    ws = F.array(*[F.lit(w) for w in weights])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    s = sizes.withColumn("rank", F.row_number().over(line)).withColumn("weight", F.element_at(ws, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * cap).withColumns({
        "total": F.sum("source_size").over(every), "spent": F.coalesce(F.sum("cap").over(before), F.lit(0)), "left": F.sum("weight").over(rest),
    })
    s = s.withColumn("full", wide("cap") * wide("left") <= wide("weight") * (wide("total") - wide("spent")))
    s = s.withColumns({
        "gone": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
        "shared": F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
    })
    share = (F.col("weight") * (F.col("total") - F.col("gone"))).cast("double") / F.col("shared").cast("double")
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    return s.select("source", "source_size", "n_rows", "rank", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (1, 2, 3),
    cap: int = 3, seed: int = 17, bucket_rows: int = 4096, carry: bool = False,
) -> DataFrame:
    """Words that the mix takes of each row.

    Returns one row per input row: id, size, source_size, target, taken; with ``carry`` the row's own columns come along
    in a struct ``row``. The random key is a hash of id and text, so rows without an id or with one id are spread too. Null texts have size 0, null is a source of its own. Ties of the random key are broken by id,
    size and a hash of the text; rows equal in all of these are interchangeable, so reruns agree. A source whose texts
    are all empty has target 0. Empty tables give an empty result. Clashing column names of ``docs`` do no harm; texts of any length are counted whole.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)), 2).alias("key"), F.xxhash64(text_col).alias("tie"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    thin = written(base.select("id", "source", "size", "key", "tie"), "sizes")
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = written(source_targets(sizes, weights, cap).withColumnRenamed("source", "__source"), "targets")
    # keys have 62 bits: a bucket is key div width, the same number of buckets for every row of a source
    width = F.expr(f"(4611686018427387903 div (1 + n_rows div {int(bucket_rows)})) + 1")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(targets, rows["source"].eqNullSafe(targets["__source"])).withColumn("width", width).withColumn("bucket", F.expr("key div width"))

    bucket = placed(thin).groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket.select("rank", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed(base if carry else thin).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, ["rank", "bucket"]).withColumn("before", F.col("start") + F.col("within"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *(["row"] if carry else [])
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, the row at a source's budget cut after its last taken word.

    A row taken 0 times goes; rows of size 0 hold no words to take, so they go too. Columns are those of ``docs``.
    """
    mixed = mix(docs, id_col, source_col, text_col, carry=True, **options).where("taken > 0")
    copies = F.expr("sequence(1, cast((taken + size - 1) div size as int))")
    each = mixed.select("row", "size", "taken", F.explode(copies).alias("nth"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size"))
    text = F.col(f"row.`{text_col}`")
    cut = F.when(words == F.col("size"), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), 1, words.cast("int")), " "))
    return each.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
