"""The forms for graphs beyond one task against the forms for small ones, and the weighted kernels against brute force."""

import heapq
import itertools

import numpy as np
import pytest

from meshwork import specs
from meshwork.errors import GraphError
from meshwork.functions import kernels
from meshwork.operators import centrality as C
from meshwork.operators import paths as P
from meshwork.operators import structure as S
from meshwork.operators.graph import Graph
from meshwork.sources import generators


def values(df, col="value"):
    return {r["name"]: r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def triangles(spark):
    """Two triangles and the edge between them."""
    return Graph.of(spark, specs.undirected_create_missing(), [(0, 1, 1), (0, 2, 2), (1, 2, 1), (2, 3, 1), (3, 4, 2), (3, 5, 1), (4, 5, 1)], kind="int")


def test_communities_by_rounds(triangles, monkeypatch):
    monkeypatch.setattr(P, "KERNEL_EDGES", 0)
    lab = values(C.louvain_communities(triangles, True), "community")
    assert lab[0] == lab[1] == lab[2] != lab[3] == lab[4] == lab[5]
    lei = C.leiden(triangles, True, quality="cpm", resolution=0.5)
    lab = values(lei, "community")
    assert S.is_partition(triangles, lei) and lab[0] == lab[1] == lab[2] != lab[3] == lab[4] == lab[5]


def test_gap_by_rounds(triangles):
    assert C.gap_rounds(triangles, True, max_iter=60) == pytest.approx(C.spectral_gap(triangles, True), abs=1e-4)


def test_group_betweenness_and_partitions_by_rounds(triangles, monkeypatch):
    want = C.group_betweenness_centrality(triangles, [2, 3], weighted=True)
    monkeypatch.setattr(P, "KERNEL_EDGES", 0)
    assert C.group_betweenness_centrality(triangles, [2, 3], weighted=True) == pytest.approx(want)
    parts = P.bfs_equal_size_partitions(triangles, 2).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 6 and max(r["count"] for r in parts) <= 4 and len(parts) == 2


def brute(n, edges, s):
    """Distances and path counts by a plain queue over positive weights."""
    out: dict = {}
    for u, v, w in edges:
        out.setdefault(u, []).append((v, w))
    dist, queue = {s: 0.0}, [(0.0, s)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > dist[u]:
            continue
        for v, w in out.get(u, ()):
            if d + w < dist.get(v, np.inf):
                dist[v] = d + w
                heapq.heappush(queue, (d + w, v))
    count = {s: 1}
    for v in sorted(dist, key=dist.get):
        if v != s:
            count[v] = sum(count[u] for u, x, w in edges if x == v and u in dist and dist[u] + w == dist[v])
    return dist, count


def test_weighted_kernels_equal_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(20):
        n = 12
        edges = [(u, v, float(rng.integers(1, 5))) for u, v in itertools.permutations(range(n), 2) if rng.random() < 0.25]
        u, v, w = (np.array(z) for z in zip(*edges, strict=True))
        g = kernels.Csr(n, u, v, w)
        each = [brute(n, edges, s) for s in range(n)]
        total = np.zeros(n)
        for s in range(n):
            dist, sigma, _ = kernels.tight_levels(g, s)
            assert {i: d for i, d in enumerate(dist) if np.isfinite(d)} == each[s][0]
            assert all(sigma[i] == c for i, c in each[s][1].items())
            total += kernels.dependencies(g, True, s)
        want = np.zeros(n)
        for s, t, x in itertools.permutations(range(n), 3):
            (d, c), (dx, cx) = each[s], each[x]
            if t in d and x in d and t in dx and d[x] + dx[t] == d[t]:
                want[x] += c[x] * cx[t] / c[t]
        assert np.allclose(total, want)


def test_zero_weights(spark):
    g = Graph.of(spark, specs.directed_create_missing(), [("s", "a", 1), ("s", "b", 1), ("b", "a", 0), ("a", "t", 1)])
    assert {(r.source, r.target): r.distance for r in P.all_pairs(g, True).collect()}["b", "t"] == 1.0
    for count in (lambda: C.betweenness_centrality(g, True), lambda: C.group_betweenness_centrality(g, ["a"], weighted=True)):
        with pytest.raises(GraphError, match="InvalidArgument"):
            count()


def test_attributes(spark):
    g = Graph.of(spark, specs.directed(), [("a", "b", 2.0, {"kind": "x"})], [("a", {"age": 3}), "b"])
    assert g.edges.first().attributes == {"kind": "x"} and {r.name: r.attributes for r in g.nodes.collect()} == {"a": {"age": "3"}, "b": None}
    h = g.add_node(("a", {"age": 4})).add_node(("c", None)).add_edge(("b", "c", 1.0, {"kind": "y"})).add_edge(("c", "a"))
    assert {r.name: (r.idx, r.attributes) for r in h.nodes.collect()} == {"a": (0, {"age": "4"}), "b": (1, None), "c": (2, None)}
    assert {(r.u, r.v): r.attributes for r in h.edges.collect()} == {("a", "b"): {"kind": "x"}, ("b", "c"): {"kind": "y"}, ("c", "a"): None}


def test_directed_loops(spark):
    g = Graph.of(spark, specs.multi_directed().but(missing_nodes="create"), [("a", "a", 1.5), ("a", "b", 1.0)])
    assert g.get_node_degree("a") == 3 and g.get_node_degree("a", loops_count_both=True) == 5
    assert values(g.get_weighted_degree_for_all_nodes(loops_count_both=True)) == {"a": 7.0, "b": 1.0}


def test_gnp_directed_and_not(spark):
    for directed, pairs in ((True, 60 * 59), (False, 60 * 59 / 2)):
        e = generators.fast_gnp_random_graph(spark, 60, 0.3, directed, 5).edges.collect()
        assert len({(r.u, r.v) for r in e}) == len(e) and all(r.u != r.v and 0 <= r.u < 60 and 0 <= r.v < 60 for r in e)
        assert abs(len(e) - 0.3 * pairs) < 5 * (0.21 * pairs) ** 0.5


def test_streaming_degree(spark, tmp_path):
    from meshwork.streaming import ingest

    assert callable(ingest.streaming_degree)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "u string, v string")
    edges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, v string").parquet(str(tmp_path / "in"))
    q = ingest.streaming_degree(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("degrees").collect()
    assert {tuple(r)[0]: tuple(r)[1] for r in got} == {"a": 3, "b": 2, "c": 1}
