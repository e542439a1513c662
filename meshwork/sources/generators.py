"""Generated graphs."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwork.errors import GraphError
from meshwork.operators.graph import Graph
from meshwork.plans.durable import checkpointed
from meshwork.specs import GraphSpecs


def _pairs(spark: SparkSession, n: int, directed: bool):
    a = spark.range(n).select(F.col("id").cast("int").alias("u"))
    ends = F.sequence(F.lit(0), F.lit(n - 1)) if directed else F.when(F.col("u") + 1 < n, F.sequence(F.col("u") + 1, F.lit(n - 1)))
    e = a.select("u", F.explode(ends).alias("v")).where("u <> v")  # no join: each node makes its own pairs
    return e.withColumn("seq", F.col("u").cast("long") * n + F.col("v"))


def complete_graph(spark: SparkSession, n: int, directed: bool) -> Graph:
    """Unweighted; nodes come from edges, so one node alone is an empty graph."""
    if n < 2:
        return Graph.new(spark, GraphSpecs(directed=directed, missing_nodes="create"), "int")
    return Graph.build(spark.createDataFrame([], "seq long, name int"), _pairs(spark, n, directed), GraphSpecs(directed=directed, missing_nodes="create"))


def fast_gnp_random_graph(spark: SparkSession, n: int, p: float, directed: bool, seed: int = 0) -> Graph:
    """G(n, p) with weights uniform in [0, 1). Equal seeds give equal graphs.

    Each node skips ahead to its next neighbour by a geometric step drawn from a hash of (node, step, seed), so the work is
    that of the edges drawn and not of all pairs. A node's steps are drawn in portions until they leave its row of pairs.
    """
    if not 0 < p < 1:
        raise GraphError("InvalidArgument", "p lies strictly between 0 and 1")
    unit = lambda *of: (F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    portion = max(16, int(n * p + 4 * math.sqrt(n * p)) + 1)
    row = F.lit(n - 1) if directed else F.lit(n - 1) - F.col("u")  # candidates of a node: the others, or those after it
    front, parts, turn = spark.range(n).select(F.col("id").cast("int").alias("u"), F.lit(-1).cast("long").alias("at")), [], 0
    while turn == 0 or not front.isEmpty():
        gap = lambda k: F.floor(F.log(unit("u", F.lit(turn) * portion + k, F.lit(1))) / math.log1p(-p)).cast("long") + 1  # noqa: B023, E731
        step = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + gap(k)))
        places = F.aggregate(F.sequence(F.lit(0), F.lit(portion - 1)), F.array("at"), step)
        drawn = checkpointed(front.select("u", F.slice(places, 2, portion).alias("places"), row.cast("long").alias("row")))
        parts.append(drawn.select("u", "row", F.explode("places").alias("at")).where("at < row").drop("row"))
        front = drawn.where(F.element_at("places", -1) < F.col("row")).select("u", F.element_at("places", -1).alias("at"))
        turn += 1
    e = parts[0]
    for more in parts[1:]:
        e = e.unionByName(more)
    v = F.when(F.col("at") >= F.col("u"), F.col("at") + 1).otherwise(F.col("at")) if directed else F.col("u") + 1 + F.col("at")
    e = e.select("u", v.cast("int").alias("v")).withColumn("seq", F.col("u").cast("long") * n + F.col("v")).withColumn("weight", unit("u", "v", F.lit(2)))
    nodes = spark.range(n).select(F.col("id").alias("seq"), F.col("id").cast("int").alias("name"))
    return Graph.build(nodes, e, GraphSpecs(directed=directed))


#: Zachary's karate club (fixed values): two members and how often they met.
KARATE = (
    (0, 1, 4), (0, 2, 5), (0, 3, 3), (0, 4, 3), (0, 5, 3), (0, 6, 3), (0, 7, 2), (0, 8, 2), (0, 10, 2), (0, 11, 3), (0, 12, 1), (0, 13, 3),
    (0, 17, 2), (0, 19, 2), (0, 21, 2), (0, 31, 2), (1, 2, 6), (1, 3, 3), (1, 7, 4), (1, 13, 5), (1, 17, 1), (1, 19, 2), (1, 21, 2),
    (1, 30, 2), (2, 3, 3), (2, 7, 4), (2, 8, 5), (2, 9, 1), (2, 13, 3), (2, 27, 2), (2, 28, 2), (2, 32, 2), (3, 7, 3), (3, 12, 3),
    (3, 13, 3), (4, 6, 2), (4, 10, 3), (5, 6, 5), (5, 10, 3), (5, 16, 3), (6, 16, 3), (8, 30, 3), (8, 32, 3), (8, 33, 4), (9, 33, 2),
    (13, 33, 3), (14, 32, 3), (14, 33, 2), (15, 32, 3), (15, 33, 4), (18, 32, 1), (18, 33, 2), (19, 33, 1), (20, 32, 3), (20, 33, 1),
    (22, 32, 2), (22, 33, 3), (23, 25, 5), (23, 27, 4), (23, 29, 3), (23, 32, 5), (23, 33, 4), (24, 25, 2), (24, 27, 3), (24, 31, 2),
    (25, 31, 7), (26, 29, 4), (26, 33, 2), (27, 33, 4), (28, 31, 2), (28, 33, 2), (29, 32, 4), (29, 33, 2), (30, 32, 3), (30, 33, 3),
    (31, 32, 4), (31, 33, 4), (32, 33, 5),
)


def karate_club_graph(spark: SparkSession) -> Graph:
    """34 nodes, 78 weighted undirected edges."""
    return Graph.of(spark, GraphSpecs(directed=False), list(KARATE), list(range(34)), "int")
