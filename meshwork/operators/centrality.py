"""Centralities of nodes and groups, resiliency, and communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.errors import GraphError
from meshwork.functions import kernels
from meshwork.operators import paths as P
from meshwork.operators.graph import Graph, dense_index
from meshwork.plans.communities import MAX_SWEEPS, PATIENCE, Packed, communities
from meshwork.plans.components import components
from meshwork.plans.durable import checkpointed
from meshwork.plans.edges import Bucketed
from meshwork.plans.grid import Grid, dependency_sums, reach_sums


def degree_centrality(g: Graph) -> DataFrame:
    n = g.number_of_nodes()
    value = F.lit(1.0) if n <= 1 else F.col("value") / (n - 1)
    return g.get_degree_for_all_nodes().select("name", value.alias("value"))


def closeness_centrality(g: Graph, weighted: bool = False, wf_improved: bool = True) -> DataFrame:
    """By distances to the node (of directed graphs, incoming ones)."""
    P.check_weights(g, weighted)
    n = g.number_of_nodes()
    if P.searchable(g, weighted):

        def job(graph, names, own):
            r, total = kernels.reach_totals(graph, weighted, own)
            yield P.batch({"name": names, "r": r, "total": total})

        sums = P.by_sources(g, weighted, job, f"name {g._kind}, r double, total double").groupBy("name").agg(F.sum("r").alias("r"), F.sum("total").alias("total"))
    else:
        sums = reach_sums(Grid(P.indexed(g, weighted), n), weighted).join(g.nodes, "idx").select("name", F.col("x").alias("r"), F.col("y").alias("total"))
    value = F.when(F.col("total") > 0, (F.col("r") - 1) / F.col("total")).otherwise(0.0)
    if wf_improved:
        value = value * ((F.col("r") - 1) / max(n - 1, 1))
    return sums.select("name", value.alias("value"))


def _raw_betweenness(g: Graph, weighted: bool) -> DataFrame:
    P.check_weights(g, weighted, positive=True)
    if P.searchable(g, weighted):

        def job(graph, names, own):
            add = kernels.dependencies_from if isinstance(graph, kernels.Sweeps) else lambda c, s: kernels.dependencies(c, weighted, s)
            total = np.zeros(len(names))
            for s in own.tolist():
                total += add(graph, s)
            at = np.flatnonzero(total)
            yield P.batch({"name": names.take(pa.array(at)), "x": total[at]})

        sums = P.by_sources(g, weighted, job, f"name {g._kind}, x double").groupBy("name").agg(F.sum("x").alias("x"))
        return g.nodes.join(sums, "name", "left").select("name", F.coalesce("x", F.lit(0.0)).alias("x"))
    edges = checkpointed(P.indexed(g, weighted).where("a <> b"))
    n = g.number_of_nodes()
    sums = dependency_sums(Grid(edges, n), Grid(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"), n))
    return g.nodes.join(sums, "idx", "left").select("name", F.coalesce("x", F.lit(0.0)).alias("x"))


def count_rounds(g: Graph, weighted: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distances (source, target, distance), tight edges (source, a, b) and path counts (source, b, s), keyed by (source, node).

    Path counts sum over numbers of edges along tight edges.
    """
    adj = g.unit_adj(weighted)
    dist = checkpointed(P.length_rounds(g, weighted, g.nodes))
    tight = dist.join(adj, dist["target"] == adj["src"]).select("source", F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("distance") + F.col("weight")).alias("d"))
    tight = checkpointed(tight.join(dist.withColumnRenamed("target", "b"), ["source", "b"]).where("d = distance").select("source", "a", "b"))
    front = checkpointed(dist.where("source = target").select("source", F.col("target").alias("b"), F.lit(1.0).alias("x")))
    every = front
    while not front.isEmpty():
        front = checkpointed(front.withColumnRenamed("b", "a").join(tight, ["source", "a"]).groupBy("source", "b").agg(F.sum("x").alias("x")))
        every = checkpointed(every.unionByName(front))
    return dist, tight, checkpointed(every.groupBy("source", "b").agg(F.sum("x").alias("s")))


def betweenness_centrality(g: Graph, weighted: bool = False, normalized: bool = True) -> DataFrame:
    n = g.number_of_nodes()
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) if normalized else (1.0 if g.specs.directed else 0.5)
    return _raw_betweenness(g, weighted).select("name", (F.col("x") * scale).alias("value"))


def average_node_betweenness(g: Graph, weighted: bool = False) -> float:
    return betweenness_centrality(g, weighted, False).agg(F.avg("value")).first()[0]


def eigenvector_centrality(g: Graph, weighted: bool = False, max_iter: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration on I + A'; a missing weight counts 1."""
    g.ensure_not_multi_edges()
    n = g.number_of_nodes()
    w = F.when(F.isnan("weight"), 1.0).otherwise(F.col("weight")) if weighted else F.lit(1.0)
    if P.small_enough(g):
        c = P.csr(Graph(g.nodes, g.edges.withColumn("weight", w), g.specs), True)
        src, v = np.repeat(np.arange(n), np.diff(c.start)), np.full(n, 1.0 / max(n, 1))
        for _ in range(max_iter):
            y = v + np.bincount(c.dst, c.weight * v[src], n)
            y /= np.sqrt((y * y).sum()) or 1.0
            moved, v = np.abs(y - v).sum(), y
            if moved < n * tolerance:
                rows = g.spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "value": v}), "idx long, value double")
                return g.nodes.join(rows, "idx").select("name", "value")
        raise GraphError("PowerIterationFailedConvergence", f"not within {max_iter} iterations")
    adj = checkpointed(g.adj.select("src", F.col("dst").alias("name"), w.alias("w")))
    x = checkpointed(g.nodes.select("name", F.lit(1.0 / max(n, 1)).alias("x")))
    for _ in range(max_iter):
        sent = adj.join(x.withColumnRenamed("name", "src"), "src").select("name", (F.col("x") * F.col("w")).alias("x"))
        raw = checkpointed(x.unionByName(sent).groupBy("name").agg(F.sum("x").alias("y")))
        norm = raw.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        both = checkpointed(raw.join(x, "name").select("name", (F.col("y") / norm).alias("new"), "x"))
        moved = both.agg(F.sum(F.abs(F.col("new") - F.col("x")))).first()[0] or 0.0
        x = both.select("name", F.col("new").alias("x"))
        if moved < n * tolerance:
            return x.select("name", F.col("x").alias("value"))
    raise GraphError("PowerIterationFailedConvergence", f"not within {max_iter} iterations")


# ---- groups ----


def _group(g: Graph, group, most: int) -> list:
    members = sorted(set(group))
    if not members or len(members) > most:
        raise GraphError("InvalidArgument", "the group is empty or too large")
    g.ensure_nodes(members)
    return members


def group_degree_centrality(g: Graph, group, normalized: bool = True) -> float:
    n = g.number_of_nodes()
    c = _group(g, group, n - 1)
    found = g.adj.where(F.col("src").isin(*c) & ~F.col("dst").isin(*c)).select("dst").distinct().count()
    return found / (n - len(c)) if normalized else float(found)


def group_closeness_centrality(g: Graph, group, weighted: bool = False) -> float:
    """One frontier from the whole group; unreachable nodes add nothing to the sum but stay in the numerator."""
    P.check_weights(g, weighted)
    n = g.number_of_nodes()
    c = _group(g, group, n - 1)
    h = g.reverse() if g.specs.directed else g
    adj = h.unit_adj(weighted)
    best = front = checkpointed(h.nodes.where(F.col("name").isin(*c)).select("name", F.lit(0.0).alias("d")))
    while not front.isEmpty():
        step = front.join(adj, front["name"] == adj["src"]).groupBy(F.col("dst").alias("name")).agg(F.min(F.col("d") + F.col("weight")).alias("e"))
        front = checkpointed(step.join(best, "name", "left").where("d is null or e < d").select("name", F.col("e").alias("d")))
        best = checkpointed(best.join(front.select("name"), "name", "left_anti").unionByName(front))
    total = best.agg(F.sum("d")).first()[0] or 0.0
    return (n - len(c)) / total if total else 0.0


def _counts(g: Graph, weighted: bool) -> DataFrame:
    """(source, target, distance, sigma) of all reachable pairs, for graphs of any size."""
    dist, _, sigma = count_rounds(g, weighted)
    return dist.join(sigma.select("source", F.col("b").alias("target"), F.col("s").alias("sigma")), ["source", "target"])


def _cut_shares(g: Graph, weighted: bool, c: list) -> tuple[float, int]:
    """Over pairs outside the group, the shares of shortest paths that it cuts, and the number of pairs with an end in it.

    Each source is searched with and without the group, and only its two sums leave the task.
    """
    group = np.array([r.idx for r in g.nodes.where(F.col("name").isin(*c)).collect()])

    def job(graph, names, own):
        closed = np.zeros(graph.n, bool)
        closed[group] = True
        rest = graph
        if isinstance(graph, kernels.Csr):
            keep = ~(closed[graph.src] | closed[graph.dst])
            rest = kernels.Csr(graph.n, graph.src[keep], graph.dst[keep], graph.weight[keep])
        total, touching = 0.0, 0
        for s in own.tolist():
            d, sigma, _ = kernels.path_steps(graph, weighted, s)
            there = np.isfinite(d)
            there[s] = False
            if closed[s]:
                touching += int(there.sum())
                continue
            touching += int((there & closed).sum())
            there &= ~closed
            d2, left, _ = kernels.path_steps(rest, weighted, s, closed)
            total += float(there.sum() - (left[there] / sigma[there])[d2[there] == d[there]].sum())
        yield P.batch({"total": np.array([total]), "touching": np.array([touching])})

    return P.by_sources(g, weighted, job, "total double, touching long").agg(F.sum("total"), F.sum("touching")).first()


def group_betweenness_centrality(g: Graph, group, normalized: bool = True, endpoints: bool = False, weighted: bool = False) -> float:
    """Pairs outside the group: the share of their shortest paths that the group cuts, by comparing the graph with and without it."""
    g.ensure_not_multi_edges()
    P.check_weights(g, weighted, positive=True)
    n = g.number_of_nodes()
    c = _group(g, group, n - 2)
    if P.searchable(g, weighted):
        total, touching = _cut_shares(g, weighted, c)
        total = (total or 0.0) + (touching or 0) * endpoints
    else:
        outside = lambda d: d.where(~F.col("source").isin(*c) & ~F.col("target").isin(*c) & (F.col("source") != F.col("target")))
        every = checkpointed(_counts(g, weighted))
        rest = g._induced(g.nodes.where(~F.col("name").isin(*c)))
        rest = Graph(dense_index(rest.nodes.withColumnRenamed("idx", "old"), ["old"]).drop("old"), rest.edges, rest.specs)
        left = _counts(rest, weighted).select("source", "target", F.col("distance").alias("d2"), F.col("sigma").alias("s2"))
        both = outside(every).join(left, ["source", "target"], "left")
        kept = F.when(F.col("d2") == F.col("distance"), F.col("s2") / F.col("sigma")).otherwise(0.0)
        total = both.agg(F.sum(1.0 - kept)).first()[0] or 0.0
        if endpoints:
            total += every.where((F.col("source") != F.col("target")) & (F.col("source").isin(*c) | F.col("target").isin(*c))).count()
    k = len(c)
    if normalized:
        return total / ((n - k) * (n - k - 1))
    return total if g.specs.directed else total / 2


# ---- communities and resiliency ----

#: A graph up to this many adjacency rows goes through the sequential Louvain and Leiden, in plain Python on the driver (145,000 to 198,000 rows
#: of random graphs took 2 to 17 s, packed sweeps about 1 s, with like modularity).
SEQUENTIAL_EDGES = 100_000
#: Communities of up to this many nodes, counted first, are broadcast to the edges in each sweep (32 bytes a node); beyond, edges are shuffled to them.
BROADCAST_NODES = 1_000_000
#: The spectral gap of a graph up to this many nodes comes from a dense matrix (32 MB at most), up to BROADCAST_NODES from a Krylov
#: basis (of at most BASIS_BYTES on the driver), else from subspace iteration.
DENSE_NODES, BASIS_BYTES = 2_000, 1 << 28
#: Edges of a packed piece of the adjacency.
PACKED_EDGES = 1 << 20


def _edge_arrays(g: Graph, weighted: bool):
    """The edges by node index, on the driver; only after :func:`meshwork.operators.paths.small_enough`."""
    ids = g.nodes.select("idx", "name")
    rows = g.edges.withColumn("w", F.col("weight") if weighted else F.lit(1.0)).join(ids.select(F.col("idx").alias("i"), F.col("name").alias("u")), "u")
    t = rows.join(ids.select(F.col("idx").alias("j"), F.col("name").alias("v")), "v").orderBy("seq").select("i", "j", "w").toPandas()
    return g.number_of_nodes(), t["i"].to_numpy(np.int64), t["j"].to_numpy(np.int64), t["w"].to_numpy(float)


def community_rounds(g: Graph, weighted: bool = False, quality: str = "modularity", resolution: float = 1.0, connected: bool = False, seed: int = 0) -> DataFrame:
    """(name, community) for graphs of any size: rounds in which half of the nodes, by hash, move at once, then a merge of communities.

    A node moves to the neighbour community c of greatest gain w(node, c) - cost * mass(node) * mass(c); mass is the degree and
    cost resolution / 2m for modularity, the number of nodes and the resolution for cpm. A level ends when no node wants to move or
    PATIENCE sweeps bring no better partition, and the best one is merged. With ``connected``, communities are split into their connected
    parts first. Up to BROADCAST_NODES nodes (:mod:`meshwork.plans.communities`) they are arrays on the driver, and packed edges stay in
    tasks; beyond, edges lie in buckets of their first node, so a sweep shuffles none of them.
    """
    ids = g.nodes.select(F.col("idx").alias("n"), "name")
    n = ids.count()
    near = F.broadcast if n <= BROADCAST_NODES else lambda rows: rows
    e = g.edges.withColumn("w", F.col("weight") if weighted else F.lit(1.0)).join(near(ids.select(F.col("n").alias("a"), F.col("name").alias("u"))), "u").join(near(ids.select(F.col("n").alias("b"), F.col("name").alias("v"))), "v")
    two = e.select("a", "b", "w").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))  # a loop counts twice, as in degrees
    adj = checkpointed(two.groupBy("a", "b").agg(F.sum("w").alias("w")))
    total = adj.agg(F.sum("w")).first()[0]
    flat = checkpointed(ids.select("n", F.col("n").alias("top")))  # node and its present vertex
    if not total:
        return ids.join(flat, "n").select("name", F.col("top").alias("community"))
    cost = resolution / total if quality == "modularity" else resolution
    if n <= BROADCAST_NODES:
        degree = np.zeros(n)
        rows = adj.groupBy("a").agg(F.sum("w").alias("w")).toArrow()
        degree[rows.column("a").to_numpy()] = rows.column("w").to_numpy()
        loops = adj.where("a = b").agg(F.sum("w")).first()[0] or 0.0
        mass = degree if quality == "modularity" else np.ones(n)
        return P.labelled(g, communities(Packed(adj.where("a <> b")), mass, cost, loops, total, connected, seed), "community")
    if quality == "modularity":
        mass = adj.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("mass"))
        mass = ids.select("n").join(mass, "n", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    else:
        mass = ids.select("n", F.lit(1.0).alias("mass"))
    mass = checkpointed(mass)

    while True:
        state = best = checkpointed(mass.withColumn("c", F.col("n")))
        edges = Bucketed(g.spark, ["a"], "community-edges")
        edges.append(adj.where("a <> b"))
        loops = adj.where("a = b").agg(F.sum("w")).first()[0] or 0.0
        top = start = None
        idle = 0
        for sweep in range(MAX_SWEEPS + 1):
            masses = checkpointed(state.groupBy("c").agg(F.sum("mass").alias("cm")))
            state = state.join(near(masses), "c").select("n", "mass", "c", "cm")
            to = near(state.select(F.col("n").alias("b"), "c", "cm"))
            rows = edges.read().join(to, "b").select(F.col("a").alias("n"), "c", "cm", "w").groupBy("n", "c").agg(F.sum("w").alias("w"), F.first("cm").alias("cm"))
            own = near(state.select("n", "mass", F.col("c").alias("c0"), F.col("cm").alias("cm0")))
            rows = rows.join(own, "n").select("n", "c", "w", (F.col("w") - cost * F.col("mass") * (F.col("cm") - F.when(F.col("c") == F.col("c0"), F.col("mass")).otherwise(0.0))).alias("gain"), F.col("c") == F.col("c0"))
            rows = rows.toDF("n", "c", "w", "gain", "stays")
            rows = rows.groupBy("n").agg(F.max(F.struct((F.col("gain") + F.when(F.col("stays"), 1e-12).otherwise(0.0)).alias("gain"), (-F.col("c")).alias("c"))).alias("x"), F.max(F.when(F.col("stays"), F.col("w"))).alias("w0"))
            alone = -cost * F.col("mass") * (F.col("cm") - F.col("mass")) + 1e-12  # of a node that has no neighbour in its community
            rows = state.join(rows, "n", "left").withColumn("y", F.greatest(F.struct(F.when(F.col("w0").isNull(), alone).otherwise(F.lit(float("-inf"))).alias("gain"), (-F.col("c")).alias("c")), F.col("x")))
            turn = F.pmod(F.xxhash64("n", F.lit(sweep)), F.lit(2)) == 0
            moved = checkpointed(rows.select("n", "mass", F.col("c").alias("c0"), F.when(turn, -F.col("y.c")).otherwise(F.col("c")).alias("c"), (-F.col("y.c") != F.col("c")).alias("wants"), "w0"))
            # twice the sum over communities of inner weight less half the cost of their mass squared, before the sweep
            inner, wants = moved.agg(F.sum("w0"), F.count_if("wants")).first()
            now = (inner or 0.0) + loops - cost * masses.agg(F.sum(F.col("cm") * F.col("cm"))).first()[0]
            if start is None:
                top = start = now
            elif now > top + 1e-9 * abs(total):
                best, top, idle = held, now, 0
            else:
                idle += 1
            if not wants or idle >= PATIENCE:
                break
            state = held = moved.select("n", "mass", "c")
        edges.drop()
        if top <= start + 1e-9 * abs(total):
            break
        if connected:
            c = best.select("n", "c")
            inner = adj.join(c.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb and a <> b")
            parts = components(inner.select(F.col("a").alias("u"), F.col("b").alias("v")))
            best = checkpointed(best.join(parts.withColumnRenamed("node", "n"), "n", "left").select("n", "mass", F.coalesce("component", "n").alias("c")))
        c = best.select("n", "c")
        flat = checkpointed(flat.join(c.select(F.col("n").alias("top"), "c"), "top").select("n", F.col("c").alias("top")))
        adj = checkpointed(adj.join(c.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        mass = checkpointed(best.groupBy(F.col("c").alias("n")).agg(F.sum("mass").alias("mass")))
    return ids.join(flat, "n").select("name", F.col("top").alias("community"))


def louvain_communities(g: Graph, weighted: bool = False, resolution: float = 1.0, threshold: float | None = None, seed: int | None = None) -> DataFrame:
    """(name, community). Directed edges count as undirected. threshold and seed are accepted; moves go in index order.

    A graph too large for one task goes by :func:`community_rounds`.
    """
    if weighted:
        g.ensure_weighted()
    if g.nodes.isEmpty():
        raise GraphError("NoPartitions", "the graph is empty")
    if not P.small_enough(g, SEQUENTIAL_EDGES):
        return community_rounds(g, weighted, "modularity", resolution)
    n, u, v, w = _edge_arrays(g, weighted)
    return P.labelled(g, kernels.louvain(n, u, v, w, resolution), "community")


def louvain_partitions(g: Graph, weighted: bool = False, **options) -> list[DataFrame]:
    """Always one partition, the last level's."""
    return [louvain_communities(g, weighted, **options)]


def leiden(g: Graph, weighted: bool = False, quality: str = "modularity", resolution: float = 0.25, theta: float = 0.3, gamma: float = 0.05, seed: int = 0) -> DataFrame:
    """(name, community); ``quality`` is modularity or cpm.

    A graph too large for one task goes by :func:`community_rounds`, whose communities are connected too.
    """
    g.ensure_undirected()
    if quality not in ("modularity", "cpm"):
        raise GraphError("InvalidArgument", "quality is modularity or cpm")
    if weighted:
        g.ensure_weighted()
    if not P.small_enough(g, SEQUENTIAL_EDGES):
        return community_rounds(g, weighted, quality, resolution, connected=True, seed=seed)
    n, u, v, w = _edge_arrays(g, weighted)
    return P.labelled(g, kernels.leiden(n, u, v, w, quality, resolution, theta, gamma, seed), "community")


def spectral_gap(g: Graph, weighted: bool = False) -> float:
    """Difference of the two largest eigenvalues of the adjacency matrix."""
    g.ensure_undirected()
    n = g.number_of_nodes()
    if n < 2:
        raise GraphError("LaPackError", "a gap needs two nodes")
    if n > BROADCAST_NODES:
        return gap_rounds(g, weighted)
    if n > DENSE_NODES:
        return kernels.krylov_gap(_products(g, weighted, n), n, BASIS_BYTES)
    values = np.linalg.eigvalsh(g.get_adjacency_matrix_ndarray(weighted), UPLO="L")
    return float(values[-1] - values[-2])


def _products(g: Graph, weighted: bool, n: int):
    """x -> A x for a few columns x: they are broadcast to the packed edges, which stay where they are, and only sums of nodes come back."""
    parts = max(1, int(g.spark.conf.get("spark.sql.shuffle.partitions")))
    fields = [("at", np.int32), ("start", np.int32), ("near", np.int32), ("w", np.float64)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one piece each: its nodes, where their edges start, the other ends and the weights."""

        def piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b, w = (np.concatenate([r.column(c).to_numpy() for r in held]) for c in ("a", "b", "w"))
            start = np.flatnonzero(np.diff(a, prepend=-1))
            return P.batch({c: [x.astype(kind).tobytes()] for (c, kind), x in zip(fields, (a[start], start, b, w), strict=True)})

        held, size = [], 0
        for r in batches:
            held, size = [*held, r], size + len(r)
            if size >= PACKED_EDGES:
                yield piece(held)
                held, size = [], 0
        if size:
            yield piece(held)

    rows = P.indexed(g, weighted).repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b")
    packed = checkpointed(rows.mapInArrow(pack, ", ".join(f"{c} binary" for c, _ in fields)))

    def times(x: np.ndarray) -> np.ndarray:
        shared = g.spark.sparkContext.broadcast(np.ascontiguousarray(x.T))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                for row in range(len(r)):
                    at, start, near, w = (np.frombuffer(r.column(c)[row].as_buffer(), kind) for c, kind in fields)
                    sums = np.array([np.add.reduceat(w * column[near], start) for column in shared.value])
                    yield P.batch({"at": [at.tobytes()], "y": [sums.tobytes()]})

        y = np.zeros(x.T.shape)
        for r in packed.mapInArrow(run, "at binary, y binary").toArrow().to_batches():
            for at, sums in zip(*r.columns, strict=True):
                at = np.frombuffer(at.as_buffer(), np.int32)
                y[:, at] += np.frombuffer(sums.as_buffer()).reshape(len(y), -1)
        shared.destroy()
        return y.T

    return times


def gap_rounds(g: Graph, weighted: bool = False, vectors: int = 6, max_iter: int = 300, tolerance: float = 1e-7) -> float:
    """The same by subspace iteration: the vectors are columns of a frame, one join a round; only small Gram matrices reach the driver.

    The matrix is shifted by its greatest row sum, so its greatest eigenvalues are those of greatest size.
    """
    adj = checkpointed(g.unit_adj(weighted).select("src", F.col("dst").alias("name"), F.col("weight").alias("w")))
    shift = adj.groupBy("name").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 0.0
    xs = [f"x{i}" for i in range(vectors)]
    k = min(vectors, g.number_of_nodes())
    xs = xs[:k]
    x = checkpointed(g.nodes.select("name", *[(F.shiftrightunsigned(F.xxhash64("name", F.lit(i)), 11) / float(1 << 53) - 0.5).alias(c) for i, c in enumerate(xs)]))
    before = None
    for _ in range(max_iter):
        sent = adj.join(x.withColumnRenamed("name", "src"), "src").select("name", *[(F.col("w") * F.col(c)).alias(f"y_{c}") for c in xs])
        summed = sent.groupBy("name").agg(*[F.sum(f"y_{c}").alias(f"y_{c}") for c in xs])
        both = checkpointed(x.join(summed, "name", "left").select("name", *xs, *[(F.coalesce(f"y_{c}", F.lit(0.0)) + shift * F.col(c)).alias(f"y_{c}") for c in xs]))
        row = both.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)], *[F.sum(F.col(a) * F.col(f"y_{b}")).alias(f"h{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)],
                       *[F.sum(F.col(f"y_{a}") * F.col(f"y_{b}")).alias(f"z{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)]).first()
        gram, ritz, new = (np.array([[row[f"{p}{i}_{j}"] for j in range(k)] for i in range(k)]) for p in "ghz")
        half = np.linalg.inv(np.linalg.cholesky(gram))
        values = np.linalg.eigvalsh(half @ ((ritz + ritz.T) / 2) @ half.T)
        gap = float(values[-1] - values[-2])
        if before is not None and abs(gap - before) <= tolerance * max(1.0, abs(values[-1] - shift)):
            return gap
        before = gap
        turn = np.linalg.inv(np.linalg.cholesky((new + new.T) / 2)).T  # columns of the products made orthonormal
        x = both.select("name", *[sum((F.col(f"y_{a}") * float(turn[i, j]) for i, a in enumerate(xs)), F.lit(0.0)).alias(b) for j, b in enumerate(xs)])
    raise GraphError("PowerIterationFailedConvergence", f"not within {max_iter} iterations")
