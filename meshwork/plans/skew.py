"""A left lookup join that doesn't send the rows of a hot key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot, so there are at most 1 / HOT_SHARE hot keys to broadcast.
HOT_SHARE = 1 / 1000


def lookup(rows: DataFrame, key: str, spread: Column, table: DataFrame, table_key: str, weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique ``table_key``), adding the table's other columns.

    ``weight`` counts the rows of a key and ``total`` all rows. Hot keys are settled by a broadcast of at most 1 / HOT_SHARE
    rows; their rows then travel under a key made of ``spread``, which differs from row to row and matches nothing.
    """
    others = [c for c in table.columns if c != table_key]
    if total <= 1 / HOT_SHARE:
        return rows.join(table.withColumnRenamed(table_key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")
    hot = table.where(F.col(weight) >= max(2, total * HOT_SHARE)).select(F.col(table_key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in others])
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    cold = table.where(F.col(weight) < max(2, total * HOT_SHARE)).select(F.col(table_key).alias("__k"), *others)
    own = F.struct(F.when(F.col("__hk").isNull(), F.col(key)).alias("k"), F.when(F.col("__hk").isNotNull() | F.col(key).isNull(), spread).alias("s"))
    rows = rows.withColumn("__own", F.xxhash64(own))
    cold = cold.withColumn("__ch", F.xxhash64(F.struct(F.col("__k").alias("k"), F.lit(None).cast(rows.select(spread.alias("s")).schema[0].dataType).alias("s"))))
    both = rows.join(cold, (rows["__own"] == cold["__ch"]) & (F.col(key) == cold["__k"]), "left")
    picked = [F.when(F.col("__hk").isNull(), F.col(c)).otherwise(F.col(f"__h_{c}")).alias(c) for c in others]
    return both.select(*[rows[c] for c in rows.columns if not c.startswith("__h") and c != "__own"], *picked)
