"""Degrees of a stream of edges, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degree(edges: DataFrame) -> DataFrame:
    """(name, value) over a streaming frame with u and v; run it in complete or update mode."""
    return edges.select(F.explode(F.array("u", "v")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("value"))
