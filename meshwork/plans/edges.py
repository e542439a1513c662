"""Edges cut at hubs and kept in buckets, and logs that only grow, so that a round shuffles its front and nothing else."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans.durable import checkpointed, new_path, remove

#: Edges of a piece of a hub; a piece has a thousandth of all edges if that is more, so there are at most some 1000 pieces of hubs.
PIECE_ROWS = 100_000


class Bucketed:
    """A table in the shared folder, bucketed by ``keys``: joins on all keys read it without a shuffle, whatever was appended."""

    def __init__(self, spark: SparkSession, keys: list[str], name: str):
        self.spark, self.keys, self.path = spark, keys, new_path(spark, name)
        self.name = f"meshwork_{uuid.uuid4().hex}"
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def append(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, *self.keys).write.mode("append").format("parquet").bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


class SplitEdges:
    """Edges (src, dst, weight); those of a hub are dealt over several values of ``salt`` by their other end."""

    def __init__(self, edges: DataFrame):
        degrees = edges.groupBy(F.col("src").alias("hub")).agg(F.count(F.lit(1)).alias("n"))
        total, self.heaviest, self.mean = edges.agg(F.count(F.lit(1)), F.max("weight"), F.avg("weight")).first()
        piece = max(PIECE_ROWS, total // 1000)
        self.hubs = checkpointed(degrees.where(F.col("n") > piece).select("hub", F.expr(f"cast((n - 1) div {piece} as int)").alias("last")))  # at most total / piece rows
        salted = edges.join(F.broadcast(self.hubs), F.col("src") == F.col("hub"), "left")
        salted = salted.select("src", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("last") + 1), F.lit(0)).cast("int").alias("salt"), "dst", "weight")
        self.table = Bucketed(edges.sparkSession, ["src", "salt"], "edges")
        self.table.append(salted)

    def out_of(self, front: DataFrame, name: str) -> DataFrame:
        """``front`` with dst and weight of every edge that leaves its ``name``; rows of a hub are copied to its pieces."""
        rows = front.join(F.broadcast(self.hubs), F.col(name) == F.col("hub"), "left")
        rows = rows.select(*front.columns, F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("salt"))
        edges = self.table.read().withColumnRenamed("salt", "__salt")
        return rows.join(edges, (F.col(name) == F.col("src")) & (F.col("salt") == F.col("__salt"))).select(*front.columns, "dst", "weight")

    def drop(self) -> None:
        self.table.drop()
