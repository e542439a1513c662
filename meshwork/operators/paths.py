"""Traversal, components and shortest paths as checkpointed DataFrame fixpoints, and all-sources kernels over a broadcast graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.errors import GraphError
from meshwork.functions import kernels
from meshwork.operators.graph import Graph, dense_index
from meshwork.plans.components import components
from meshwork.plans.durable import checkpointed
from meshwork.plans.edges import Bucketed, SplitEdges
from meshwork.plans.skew import lookup
from meshwork.plans.strong import strong_components

#: A graph up to this many adjacency rows is broadcast to the kernels (16 bytes a row); the count is taken first. Larger ones
#: go by DataFrame rounds keyed by (source, node).
KERNEL_EDGES = 20_000_000
#: Where searches go in sweeps (:class:`kernels.Sweeps`, 8 bytes a row, sorted by tasks and not by the driver) so many times as many rows.
SWEEP_SHARE = 3


def breadth_first_search(g: Graph, start) -> DataFrame:
    """(name, level) of all nodes reachable from ``start``. A level is appended to the levels before it; edges stay where they are."""
    g.ensure_nodes([start])
    return _levels(SplitEdges(g.adj), g.get_node(start).select("name"))


def _levels(edges: SplitEdges, start: DataFrame) -> DataFrame:
    seen, level = Bucketed(start.sparkSession, ["name"], "levels"), 0
    front = checkpointed(start.withColumn("level", F.lit(0)))
    while not front.isEmpty():
        seen.append(front)
        level += 1
        step = edges.out_of(front.select("name"), "name").select(F.col("dst").alias("name")).distinct()
        front = checkpointed(step.join(seen.read(), "name", "left_anti").withColumn("level", F.lit(level)))
    edges.drop()
    return seen.read()


def _components(g: Graph) -> DataFrame:
    found = components(g.both.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return g.nodes.select("name").join(found.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def connected_components(g: Graph) -> DataFrame:
    """(name, component): the least name of the component."""
    g.ensure_undirected()
    return _components(g)


def weakly_connected_components(g: Graph) -> DataFrame:
    g.ensure_directed()
    return _components(g)


def number_of_connected_components(g: Graph) -> int:
    return connected_components(g).select("component").distinct().count()


def node_connected_component(g: Graph, name) -> DataFrame:
    g.ensure_undirected()
    return breadth_first_search(g, name).select("name")


def strongly_connected_components(g: Graph) -> DataFrame:
    """(name, component), the least name of each; see :func:`strong_components`."""
    g.ensure_directed()
    return strong_components(g.nodes, g.adj)


# ---- kernels over a broadcast graph ----


def small_enough(g: Graph, most: int | None = None) -> bool:
    """Whether the adjacency has at most KERNEL_EDGES rows, or ``most`` if that is less."""
    return g.adj.count() <= min(KERNEL_EDGES, KERNEL_EDGES if most is None else most)


def searchable(g: Graph, weighted: bool) -> bool:
    """Whether :func:`by_sources` can broadcast the graph."""
    return small_enough(g) or (g.adj.count() <= SWEEP_SHARE * KERNEL_EDGES and _fit(g, weighted))


def _fit(g: Graph, weighted: bool) -> bool:
    """:meth:`kernels.Sweeps.fit`, of the weights alone."""
    if not weighted:
        return True
    kinds = np.array([r[0] for r in g.adj.select("weight").distinct().limit(kernels.MOST_WEIGHTS + 1).collect()], float)
    return kernels.Sweeps.fit(kernels.Csr(g.number_of_nodes(), np.zeros(len(kinds), int), np.zeros(len(kinds), int), kinds), True)


def sweeps(g: Graph, weighted: bool) -> kernels.Sweeps:
    """The adjacency by node index for searches from blocks of sources. Tasks sort it, and 4 bytes a row and order reach the driver."""
    n, found = g.number_of_nodes(), []
    ids = g.nodes.select("idx", "name")
    rows = g.unit_adj(weighted).join(ids.select(F.col("idx").cast("int").alias("a"), F.col("name").alias("src")), "src").join(ids.select(F.col("idx").cast("int").alias("b"), F.col("name").alias("dst")), "dst")
    rows = checkpointed(rows.select("a", "b", F.col("weight").cast("double").alias("w")))
    parts = max(g.spark.sparkContext.defaultParallelism, -(-rows.count() // (1 << 20)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            own, other, w = (r.column(c).to_numpy() for c in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    at, count = np.unique(own[lo:hi], return_counts=True)
                    yield batch({"w": [float(w[lo])], "at": [at.astype(np.int32).tobytes()], "count": [count.astype(np.int32).tobytes()], "ends": [other[lo:hi].astype(np.int32).tobytes()]})

    for own, other in ("ab", "ba"):
        t = rows.repartitionByRange(parts, "w", own, other).sortWithinPartitions("w", own, other).select(own, other, "w").mapInArrow(pack, "w double, at binary, count binary, ends binary").toArrow()
        sizes: dict = {}
        for w, x in zip(t.column("w").to_pylist(), t.column("ends"), strict=True):
            sizes[w] = sizes.get(w, 0) + len(x.as_buffer()) // 4
        ends, counts, filled = {w: np.empty(k, np.int32) for w, k in sizes.items()}, {w: np.zeros(n, np.int32) for w in sizes}, dict.fromkeys(sizes, 0)
        for w, at, count, x in zip(t.column("w").to_pylist(), t.column("at"), t.column("count"), t.column("ends"), strict=True):
            at, count, x = (np.frombuffer(y.as_buffer(), np.int32) for y in (at, count, x))
            counts[w][at] += count
            ends[w][filled[w] : filled[w] + len(x)] = x
            filled[w] += len(x)
        found.append((ends, counts))
        del t
    (to, out), (near, into) = found
    return kernels.Sweeps.of(n, [(w, near[w], to[w], out[w], into[w]) for w in sorted(to)])


def csr(g: Graph, weighted: bool, reverse: bool = False) -> kernels.Csr:
    """The adjacency by node index, brought to the driver; only after :func:`small_enough`."""
    a = g.unit_adj(weighted)
    ids = g.nodes.select("idx", "name")
    ends = a.join(ids.select(F.col("idx").alias("i"), F.col("name").alias("src")), "src").join(ids.select(F.col("idx").alias("j"), F.col("name").alias("dst")), "dst")
    t = ends.select("i", "j", "weight").toArrow()
    i, j, w = (t.column(c).to_numpy() for c in ("i", "j", "weight"))
    order = np.lexsort((j, i))  # a pair stands once
    i, j, w = i[order], j[order], w[order]
    return kernels.Csr(g.number_of_nodes(), j if reverse else i, i if reverse else j, w)


def indexed(g: Graph, weighted: bool) -> DataFrame:
    """The adjacency (a, b, w) by node index; the edges of a hub don't meet its index in one task."""
    rows = g.unit_adj(weighted)
    total = rows.count()
    for end, other, name in (("src", "dst", "a"), ("dst", "src", "b")):
        degrees = rows.groupBy(F.col(end).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        ids = g.nodes.select("name", F.col("idx").alias(name)).join(degrees, "name")
        rows = lookup(rows, end, F.col(other), ids.withColumnRenamed("name", "k"), "k", "n", total).drop("n")
    return rows.select("a", "b", F.col("weight").alias("w"))


def check_weights(g: Graph, weighted: bool, positive: bool = False) -> None:
    """Weights must be there and not negative; where paths are counted they must be positive, as a path may go round a cycle of zeros."""
    if weighted:
        g.ensure_weighted()
        least = g.edges.agg(F.min("weight")).first()[0]
        if least is not None and least < 0:
            raise GraphError("ContradictoryPaths", "negative weights")
        if positive and least == 0:
            raise GraphError("InvalidArgument", "paths need positive weights")


def by_sources(g: Graph, weighted: bool, job, schema: str, sources: DataFrame | None = None) -> DataFrame:
    """Run ``job(graph, names, sources) -> iterator of record batches`` once a task, over its share of the sources' indices.

    The graph is broadcast as :class:`kernels.Sweeps` where its weights fit that, else as a Csr; ``names`` by index as Arrow. So the rows
    get their names where they are made: Spark can't know how many they are and would take them for few enough to broadcast in a join.
    """
    graph = sweeps(g, weighted) if _fit(g, weighted) else csr(g, weighted)
    named = g.nodes.select("idx", "name").toArrow().sort_by("idx").column("name").combine_chunks()
    shared = g.spark.sparkContext.broadcast((graph, named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches]
        if held and len(own := np.concatenate(held)):
            yield from job(*shared.value, own)

    ids = (g.nodes if sources is None else sources).select("idx")
    return ids.repartition(2 * g.spark.sparkContext.defaultParallelism, "idx").mapInArrow(run, schema)


def batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def lengths(g: Graph, weighted: bool = False, sources=None, cutoff: float | None = None, target=None) -> DataFrame:
    """(source, target, distance) of all reachable pairs, the source itself at 0 included; sources are names or a table of them.

    Searches end beyond ``cutoff``, and beyond the distance of ``target`` where it is reached; so do the rows.
    """
    check_weights(g, weighted)
    start = g.nodes if sources is None else g.nodes.join(sources, "name", "left_semi") if isinstance(sources, DataFrame) else g.nodes.where(F.col("name").isin(*sources))
    if not searchable(g, weighted):
        return length_rounds(g, weighted, start, cutoff, target)
    stop = None if target is None else g.get_node(target).first()["idx"]
    most = np.inf if cutoff is None else cutoff

    def job(graph, names: pa.Array, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for found in kernels.settled(graph, weighted, own, most, stop):
            held.append(found)
            if (rows := rows + len(found[0])) >= 1 << 18:
                yield named(names, held)
                held, rows = [], 0
        if rows:
            yield named(names, held)

    def named(names: pa.Array, held: list) -> pa.RecordBatch:
        s, t, d = (np.concatenate(z) for z in zip(*held, strict=True))
        return batch({"source": names.take(pa.array(s)), "target": names.take(pa.array(t)), "distance": d})

    kind = g.nodes.schema["name"].dataType.simpleString()
    return by_sources(g, weighted, job, f"source {kind}, target {kind}, distance double", start)


def length_rounds(g: Graph, weighted: bool, start: DataFrame, cutoff: float | None = None, target=None) -> DataFrame:
    """The same by delta-stepping: pairs (source, target) are settled bucket after bucket of distances, each a mean weight wide.

    Inside a bucket the light edges, no heavier than its width, are followed until nothing comes nearer; what is settled then is
    appended to a log and sends along its heavy edges once. Pairs beyond the bucket wait; those of a source that has settled the
    target are dropped.
    """
    edges = SplitEdges(g.unit_adj(weighted))
    width, pair = edges.mean or 1.0, ["source", "target"]
    settled = Bucketed(g.spark, pair, "settled")
    waiting = checkpointed(start.select(F.col("name").alias("source"), F.col("name").alias("target"), F.lit(0.0).alias("distance")))
    settled.append(waiting.limit(0))

    def sent(front: DataFrame, which: str) -> DataFrame:
        rows = edges.out_of(front, "target").where(which).select("source", F.col("dst").alias("target"), (F.col("distance") + F.col("weight")).alias("distance"))
        rows = rows if cutoff is None else rows.where(F.col("distance") <= cutoff)
        return rows.groupBy(*pair).agg(F.min("distance").alias("distance")).join(settled.read(), pair, "left_anti")

    while (least := waiting.agg(F.min("distance")).first()[0]) is not None:
        end = max((least // width + 1) * width, float(np.nextafter(least, np.inf)))
        best = front = checkpointed(waiting.where(F.col("distance") < end))
        later = [waiting.where(F.col("distance") >= end)]
        while not front.isEmpty():
            step = checkpointed(sent(front, f"weight <= {width!r}"))
            later.append(step.where(F.col("distance") >= end))
            nearer = step.where(F.col("distance") < end).join(best.withColumnRenamed("distance", "old"), pair, "left").where("old is null or distance < old")
            front = checkpointed(nearer.drop("old"))
            best = checkpointed(best.join(front, pair, "left_anti").unionByName(front))
        if (edges.heaviest or 0.0) > width:
            later.append(sent(best, f"weight > {width!r}"))
        rest = later[0]
        for more in later[1:]:
            rest = rest.unionByName(more)
        rest = checkpointed(rest.groupBy(*pair).agg(F.min("distance").alias("distance")))
        settled.append(best)
        rest = rest.join(settled.read(), pair, "left_anti")
        if target is not None:
            rest = rest.join(settled.read().where(F.col("target") == F.lit(target)).select("source"), "source", "left_anti")
        waiting = checkpointed(rest)
    edges.drop()
    out = settled.read()
    if target is not None:
        limit = out.where(F.col("target") == F.lit(target)).select("source", F.col("distance").alias("most"))
        out = out.join(limit, "source", "left").where("most is null or distance <= most").drop("most")
    return out


def paths(g: Graph, dist: DataFrame, weighted: bool, first_only: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(source, target, distance, paths): shortest paths over the edges with d(u) + w = d(v). Their number can be exponential.

    With ``wanted`` (source, target) only the paths of these pairs are spelt out, over the edges that lead to their targets.
    """
    adj = g.unit_adj(weighted)
    check_weights(g, weighted, positive=True)
    dist = checkpointed(dist)
    tight = dist.join(adj, dist["target"] == adj["src"]).select("source", F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("distance") + F.col("weight")).alias("d"))
    tight = checkpointed(tight.join(dist.withColumnRenamed("target", "b"), ["source", "b"]).where("d = distance").select("source", "a", "b"))
    if wanted is not None:
        ends = needed = checkpointed(wanted.select("source", F.col("target").alias("b")).distinct())
        while not ends.isEmpty():
            before = ends.join(tight, ["source", "b"]).select("source", F.col("a").alias("b")).distinct()
            ends = checkpointed(before.join(needed, ["source", "b"], "left_anti"))
            needed = checkpointed(needed.unionByName(ends))
        tight = checkpointed(tight.join(needed, ["source", "b"], "left_semi"))
        dist = dist.join(wanted.select("source").distinct(), "source", "left_semi")
    every = front = checkpointed(dist.where("source = target").select("source", F.col("target").alias("b"), F.array("source").alias("path")))
    while True:
        step = front.withColumnRenamed("b", "a").join(tight, ["source", "a"]).select("source", "b", F.concat("path", F.array("b")).alias("path"))
        if first_only:  # the least path in name order of those of this many edges
            step = step.groupBy("source", "b").agg(F.min("path").alias("path"))
        front = checkpointed(step)
        if front.isEmpty():
            break
        every = checkpointed(every.unionByName(front))
    return _listed(dist, every, first_only, wanted)


def _listed(dist: DataFrame, every: DataFrame, first_only: bool, wanted: DataFrame | None) -> DataFrame:
    found = every.groupBy("source", F.col("b").alias("target")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    if first_only:
        found = found.withColumn("paths", F.slice("paths", 1, 1))
    return (dist if wanted is None else dist.join(wanted.select("source", "target").distinct(), ["source", "target"], "left_semi")).join(found, ["source", "target"])


def multi_source(g: Graph, sources, weighted: bool = False, target=None, cutoff: float | None = None, first_only: bool = False, with_paths: bool = True, include_settled: bool = False) -> DataFrame:
    """Independent runs from each source. With a target only its row is returned, or with ``include_settled`` all nearer nodes too."""
    check_weights(g, weighted)
    g.ensure_nodes([*sources, *([] if target is None else [target])])
    dist = lengths(g, weighted, list(sources), cutoff, target)
    out = paths(g, dist, weighted, first_only) if with_paths else dist
    return out if target is None or include_settled else out.where(F.col("target") == F.lit(target))


def single_source(g: Graph, source, weighted: bool = False, **options) -> DataFrame:
    return multi_source(g, [source], weighted, **options)


def all_pairs(g: Graph, weighted: bool = False, target=None, cutoff: float | None = None, first_only: bool = False, with_paths: bool = False) -> DataFrame:
    check_weights(g, weighted)
    if target is not None:
        g.ensure_nodes([target])
    dist = lengths(g, weighted, None, cutoff, target)
    out = paths(g, dist, weighted, first_only) if with_paths else dist
    return out if target is None else out.where(F.col("target") == F.lit(target))


def contains_path_through_node(paths_col: str, name):
    """Whether the name lies strictly inside any of the paths."""
    return F.exists(paths_col, lambda p: (F.size(p) > 2) & F.array_contains(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(1))), F.lit(name)))


def get_all_shortest_paths_involving(g: Graph, name, weighted: bool = False) -> DataFrame:
    """Pairs of other nodes of which some shortest path leads through the node, with all their shortest paths.

    Searches to and from the node tell which pairs they are, by d(s, node) + d(node, t) = d(s, t), up to rounding; only their paths
    are spelt out, and looked through. Within the kernels' bound a source's paths are spelt out by its task and go to no disk.
    """
    g.ensure_nodes([name])
    check_weights(g, weighted, positive=True)
    if searchable(g, weighted):
        return _paths_over(g, name, weighted)
    ahead = checkpointed(lengths(g, weighted, [name]).where("source <> target").select("target", F.col("distance").alias("on")))
    behind = checkpointed(lengths(g.reverse(), weighted, [name]).where("source <> target").select(F.col("target").alias("source"), F.col("distance").alias("to"))) if g.specs.directed else ahead.select(F.col("target").alias("source"), F.col("on").alias("to"))
    dist = checkpointed(lengths(g, weighted, behind.select(F.col("source").alias("name"))))
    near = F.abs(F.col("to") + F.col("on") - F.col("distance")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("distance"))
    wanted = checkpointed(dist.where("source <> target").join(behind, "source").join(ahead, "target").where(near).select("source", "target"))
    return paths(g, dist, weighted, wanted=wanted).where(contains_path_through_node("paths", name))


def _paths_over(g: Graph, name, weighted: bool) -> DataFrame:
    """(source, target, distance, paths) of the pairs of other nodes of which some shortest path leads through the node.

    A source's search and the paths from it are the work of one task, so nothing is shuffled or kept.
    """
    middle = g.get_node(name).first()["idx"]

    def job(graph, names: pa.Array, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        on = kernels.path_steps(graph, weighted, middle)[0]
        rank = np.empty(graph.n, np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(graph.n)
        ahead = np.flatnonzero(np.isfinite(on))
        held, rows = [], 0
        for s in own.tolist():
            d, sigma, steps = kernels.path_steps(graph, weighted, s)
            if s == middle or not np.isfinite(d[middle]):
                continue
            wanted = np.zeros(graph.n, bool)
            wanted[ahead] = np.abs(d[middle] + on[ahead] - d[ahead]) <= 1e-9 * np.maximum(1.0, d[ahead])
            wanted[[s, middle]] = False
            if not wanted.any():
                continue
            for targets, counts, lengths, nodes in kernels.spelt_paths(s, steps, sigma, wanted, rank):
                held.append((np.full(len(targets), s), targets, d[targets], counts, lengths, nodes))
                if (rows := rows + len(lengths)) >= kernels.PATHS_AT_ONCE:
                    yield named(names, held)
                    held, rows = [], 0
        if held:
            yield named(names, held)

    def named(names: pa.Array, held: list) -> pa.RecordBatch:
        s, t, d, counts, lengths, nodes = (np.concatenate(z) for z in zip(*held, strict=True))
        begin = np.append(0, np.cumsum(lengths))
        listed = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), names.take(pa.array(nodes)))
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), listed)
        first = np.append(0, np.cumsum(counts))[:-1]
        # rounding may take a pair for one by way of the node
        through = np.add.reduceat(np.add.reduceat(nodes == middle, begin[:-1], dtype=np.int64), first) > 0
        out = batch({"source": names.take(pa.array(s)), "target": names.take(pa.array(t)), "distance": d, "paths": listed})
        return out if through.all() else out.filter(pa.array(through))

    kind = g.nodes.schema["name"].dataType.simpleString()
    return by_sources(g, weighted, job, f"source {kind}, target {kind}, distance double, paths array<array<{kind}>>")


def bfs_equal_size_partitions(g: Graph, k: int) -> DataFrame:
    """(name, part), parts of n // k + 1 nodes or fewer.

    The greedy fill is sequential by definition, so it runs in one task while the graph fits there. A larger graph is filled
    in the order of (least node of the component, breadth-first level from it, index), which needs no one task.
    """
    if k < 1:
        raise GraphError("InvalidArgument", "k must be positive")
    if not small_enough(g):
        return partition_rounds(g, k)
    c, n = csr(g, False), g.number_of_nodes()
    near: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        for j in c.dst[c.start[i] : c.start[i + 1]].tolist():
            near[i].add(j)
            near[j].add(i)
    label = kernels.equal_partitions(n, [sorted(x) for x in near], k)
    return labelled(g, label, "part")


def partition_rounds(g: Graph, k: int) -> DataFrame:
    """The fill of :func:`bfs_equal_size_partitions` for graphs of any size."""
    roots = checkpointed(_components(g))
    seen = front = checkpointed(roots.where("name = component").select("name", F.lit(0).alias("level")))
    level = 0
    while not front.isEmpty():
        level += 1
        step = front.join(g.both, front["name"] == g.both["src"]).select(F.col("dst").alias("name")).distinct()
        front = checkpointed(step.join(seen, "name", "left_anti").withColumn("level", F.lit(level)))
        seen = checkpointed(seen.unionByName(front))
    rows = roots.join(seen, "name").join(g.nodes.select("name", "idx"), "name").withColumnRenamed("idx", "at")
    most = g.number_of_nodes() // k + 1
    return dense_index(rows, ["component", "level", "at"]).select("name", F.expr(f"idx div {most}").alias("part"))


def labelled(g: Graph, label: np.ndarray, column: str) -> DataFrame:
    rows = g.spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(label)), column: np.asarray(label, np.int64)}), f"idx long, {column} long")
    return g.nodes.join(rows, "idx").select("name", column)
