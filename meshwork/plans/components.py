"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.durable import checkpointed

MAX_ROUNDS = 60


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v). Large: neighbours above u move to the least of u's neighbourhood. Small: those below, and u itself."""
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = pairs.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def least_reachable(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least one that the pairs (u, v) connect it with."""
    top = np.arange(n)
    while len(u):
        np.minimum.at(top, np.maximum(u, v), np.minimum(u, v))  # the ends are tops, so a top moves below another
        while (further := top[top]).tobytes() != top.tobytes():
            top = further
        u, v = top[u], top[v]
        u, v = u[u != v], v[u != v]
    return top


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """The components of few pairs, whose nodes are longs or structs of longs, none of them null."""
    kind = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if len(b)]):
            return
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held])
        fields = [f.to_numpy() for f in (ends.flatten() if pa.types.is_struct(ends.type) else [ends])]
        order = np.lexsort(fields[::-1])
        new = np.concatenate([[True], np.any([f[order][1:] != f[order][:-1] for f in fields], axis=0)])
        number = np.empty(len(order), np.int64)  # in the order of the nodes, so that the least number is the least node
        number[order] = np.cumsum(new) - 1
        top = least_reachable(*np.split(number, 2), int(new.sum()))
        nodes = ends.take(pa.array(order[new]))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(top))], ["node", "component"])

    return pairs.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(pairs: DataFrame, few: int = 0) -> DataFrame:
    """(node, component) for every node of a pair (u, v); component is the least node reachable. Loops and repeats do no harm.

    Each round is cut with a reliable checkpoint; it ends when a round leaves the pairs as they were. Up to ``few`` different
    pairs, counted first, are settled by one task instead (their nodes: longs or structs of longs, none of them null).
    """
    pairs = checkpointed(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and pairs.count() <= few:
        return _in_one_task(pairs)
    sign = None
    for _ in range(MAX_ROUNDS):
        mark = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(mark) == sign or mark[0] == 0:
            break
        sign = tuple(mark)
        pairs = checkpointed(_star(_star(pairs, True), False))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
