"""Golden values on small graphs and the karate club."""

import importlib
import math
import sys

import pytest

from meshwork import catalog, specs
from meshwork.errors import GraphError
from meshwork.operators import centrality as C
from meshwork.operators import paths as P
from meshwork.operators import structure as S
from meshwork.operators.graph import Graph
from meshwork.sources import generators, graphml

FIVE = [("n1", "n2", 1), ("n2", "n3", 5), ("n1", "n4", 2), ("n4", "n3", 3), ("n1", "n5", 9), ("n3", "n5", 1)]
TRI5 = [("n0", "n1", 1.1), ("n0", "n2", 1.3), ("n0", "n3", 1.4), ("n3", "n2", 1.5), ("n4", "n3", 1.6), ("n4", "n2", 1.7)]
DIR, UND = specs.directed_create_missing(), specs.undirected_create_missing()


def values(df, col="value"):
    return {r["name"]: r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def karate(spark):
    return generators.karate_club_graph(spark)


def test_karate_counts(karate):
    assert karate.number_of_nodes() == 34 and karate.number_of_edges() == 78
    assert karate.get_density() == pytest.approx(0.13903743315508021)
    assert S.transitivity(karate) == pytest.approx(0.2556818181818182)
    assert round(S.average_clustering(karate), 3) == 0.571 and round(S.average_clustering(karate, count_zeros=False), 3) == 0.606
    assert {r.multiplicity: r.cnt for r in S.generalized_degree(karate, [0]).collect()} == {0: 2, 1: 5, 2: 4, 3: 2, 5: 2, 7: 1}
    sq = values(S.square_clustering(karate))
    assert sq[0] == pytest.approx(0.0905172414) and sq[1] == pytest.approx(0.1721611722) and sq[33] == pytest.approx(0.1215805471)
    con = values(S.constraint(karate, weighted=True))
    assert con[0] == pytest.approx(0.190623489) and con[33] == pytest.approx(0.186287286) and con[11] == pytest.approx(1.0)
    assert S.cut_size(karate, [0, 1, 2, 3], [4, 5, 6, 7], True) == 22.0
    assert S.edge_boundary(karate, [0, 1, 2, 3], [4, 5, 6, 7]).count() == 7


def test_karate_centrality(karate, monkeypatch):
    b = values(C.betweenness_centrality(karate, False, False))
    assert round(b[0], 2) == 231.07 and round(b[33], 2) == 160.55 and round(b[32], 2) == 76.69
    fast = values(C.betweenness_centrality(karate, True, False))
    with monkeypatch.context() as m:
        m.setattr(P, "KERNEL_EDGES", 0)
        assert values(C.betweenness_centrality(karate, True, False)) == pytest.approx(fast, abs=1e-9)
    assert C.average_node_betweenness(karate, True) == pytest.approx(26.19362745)
    assert C.average_node_betweenness(karate, False) == pytest.approx(23.23529412)
    assert C.spectral_gap(karate, True) == pytest.approx(4.581245823406171)
    for group, want in (([0], 0.4376352814), ([33], 0.3040749759), ([0, 33], 0.6845574117)):
        assert C.group_betweenness_centrality(karate, group) == pytest.approx(want)


def test_karate_communities(spark, karate):
    six = spark.createDataFrame([(i // 6, i) for i in range(34)], "community long, name int")
    assert round(S.modularity(karate, six), 4) == -0.0015 and round(S.modularity(karate, six, resolution=2.0), 4) == -0.2081
    lou = C.louvain_communities(karate, True)
    assert lou.select("community").distinct().count() == 4 and S.modularity(karate, lou, True) == pytest.approx(0.4449, abs=2e-3)
    lei = C.leiden(karate, True, resolution=1.0, seed=3)
    assert S.is_partition(karate, lei) and S.modularity(karate, lei, True) > 0.35
    ego = karate.get_ego_graph(4)
    assert {r.name for r in ego.nodes.collect()} == {0, 4, 6, 10} and ego.edges.count() == 5
    parts = P.bfs_equal_size_partitions(karate, 3).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 34 and max(r["count"] for r in parts) <= 12


def test_five(spark):
    g = Graph.of(spark, DIR, FIVE)
    assert values(C.betweenness_centrality(g, True, False)) == {"n1": 0, "n2": 0, "n3": 3, "n4": 2, "n5": 0}
    assert values(C.betweenness_centrality(g, False, False)) == {"n1": 0, "n2": 0.5, "n3": 2, "n4": 0.5, "n5": 0}
    close = {k: round(v, 2) for k, v in values(C.closeness_centrality(g)).items()}
    assert close == {"n1": 0, "n2": 0.25, "n3": 0.56, "n4": 0.25, "n5": 0.67}
    with pytest.raises(GraphError, match="PowerIteration"):
        C.eigenvector_centrality(g, True)
    e = values(C.eigenvector_centrality(Graph.of(spark, DIR, [*FIVE, ("n5", "n1", 1)]), True))
    assert [round(e[k], 2) for k in sorted(e)] == [0.28, 0.09, 0.31, 0.18, 0.89]
    best = P.single_source(g, "n1", True, target="n5").first()
    assert best.distance == 6.0 and best.paths == [["n1", "n4", "n3", "n5"]]
    text = graphml.write_graphml_string(g)
    back = graphml.read_graphml_string(spark, text, UND)
    assert back.specs.directed and back.number_of_nodes() == 5 and back.size(True) == 21.0
    with pytest.raises(GraphError, match="ReadError"):
        graphml.read_graphml_string(spark, "<graphml><node/></graphml>", DIR)
    assert [r.name for r in g.reverse().get_successor_nodes("n5").orderBy("name").collect()] == ["n1", "n3"]


def test_clustering_weights(spark):
    u, d = Graph.of(spark, UND, TRI5), Graph.of(spark, DIR, TRI5)
    w = values(S.clustering(u, True))
    assert w["n0"] == pytest.approx(0.274042154) and w["n2"] == pytest.approx(0.587358615) and w["n4"] == pytest.approx(0.939949381) and w["n1"] == 0
    c = values(S.clustering(d))
    assert c["n0"] == pytest.approx(1 / 6) and c["n2"] == pytest.approx(1 / 3) and c["n4"] == 0.5
    assert values(S.clustering(d, True))["n4"] == pytest.approx(0.469974691)


def test_policies(spark):
    with pytest.raises(GraphError, match="DuplicateEdge"):
        Graph.of(spark, DIR, [("a", "b", 1), ("a", "b", 2)])
    assert Graph.of(spark, DIR.but(dedupe="first"), [("a", "b", 1), ("a", "b", 2)]).size(True) == 1
    assert Graph.of(spark, DIR.but(dedupe="last"), [("a", "b", 1), ("a", "b", 2)]).size(True) == 2
    with pytest.raises(GraphError, match="SelfLoopsFound"):
        Graph.of(spark, DIR, [("a", "a", 1)])
    assert Graph.of(spark, DIR.but(loops_forbidden="drop"), [("a", "a", 1)]).number_of_nodes() == 0
    with pytest.raises(GraphError, match="NodeNotFound"):
        Graph.of(spark, specs.directed(), [("a", "b", 1)])
    loop = Graph.of(spark, UND.but(self_loops=True), [("n1", "n1", 10), ("n1", "n2", 1)])
    assert loop.get_node_weighted_degree("n1") == 21 and loop.get_node_degree("n1") == 3
    und = [("n1", "n3", 1), ("n3", "n1", 5), ("n2", "n3", 2)]
    g = Graph.of(spark, DIR, und)
    for how, want in (("min", 1), ("max", 5), ("sum", 6)):
        assert g.to_undirected(how).get_edge("n3", "n1").first().weight == want
    assert math.isnan(g.to_undirected().get_edge("n1", "n3").first().weight)
    more = g.add_node("z").add_edge_tuple("z", "n1")
    assert more.number_of_nodes() == 4 and more.number_of_edges() == 4 and not more.edges_have_weight()
    empty = Graph.new(spark, UND)
    assert empty.get_density() == 0.0 and S.transitivity(empty) == 0.0


def test_components_and_groups(spark):
    scc = Graph.of(spark, DIR, [("n1", "n2"), ("n2", "n1"), ("n2", "n3"), ("n3", "n4"), ("n4", "n5"), ("n5", "n3")])
    c = values(P.strongly_connected_components(scc), "component")
    assert c["n1"] == c["n2"] != c["n3"] == c["n4"] == c["n5"]
    wcc = Graph.of(spark, DIR, [("n1", "n2"), ("n3", "n4"), ("n5", "n6"), ("n7", "n8"), ("n8", "n1")])
    w = values(P.weakly_connected_components(wcc), "component")
    assert w["n7"] == w["n2"] == "n1" and w["n4"] == "n3" and len(set(w.values())) == 3
    path = Graph.of(spark, UND, [(i, i + 1) for i in range(4)], kind="int")
    assert C.group_betweenness_centrality(path, [2]) == pytest.approx(2 / 3) and C.group_betweenness_centrality(path, [1, 3]) == pytest.approx(1.0)
    inv = Graph.of(spark, DIR, [("n1", "n2"), ("n2", "n3"), ("n1", "n4"), ("n4", "n3"), ("n2", "n5")])
    assert P.get_all_shortest_paths_involving(inv, "n2").count() == 2
    lou = Graph.of(spark, UND, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)], kind="int")
    assert sorted(r["count"] for r in C.louvain_communities(lou).groupBy("community").count().collect()) == [3, 3]
    lou4 = Graph.of(spark, DIR, [(0, 1, 1.1), (1, 0, 1.2), (0, 2, 1.3), (0, 3, 1.4), (3, 2, 1.5)], kind="int")
    lab = values(C.louvain_communities(lou4, True), "community")
    assert lab[0] == lab[1] != lab[2] == lab[3]


def test_rounds_equal_kernels(spark, karate):
    fast = {(r.source, r.target): r.distance for r in P.lengths(karate, True).collect()}
    slow = {(r.source, r.target): r.distance for r in P.length_rounds(karate, True, karate.nodes).collect()}
    assert fast == slow


def test_matrices_and_generators(spark):
    g = Graph.of(spark, UND, [(0, 1, 2.0), (1, 2, 3.0)], kind="int")
    assert g.get_adjacency_matrix_vec(True) == [0, 2, 0, 2, 0, 3, 0, 3, 0] and g.get_adjacency_matrix_sprs(True).count() == 2
    assert [r.row for r in g.get_adjacency_matrix_vec_vec(False).orderBy("i").collect()] == [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
    assert generators.complete_graph(spark, 3, True).edges.count() == 6 and generators.complete_graph(spark, 3, False).edges.count() == 3
    gnp = generators.fast_gnp_random_graph(spark, 100, 0.2, False, 1)
    assert gnp.number_of_nodes() == 100 and 800 < gnp.edges.count() < 1180
    with pytest.raises(GraphError, match="InvalidArgument"):
        generators.fast_gnp_random_graph(spark, 10, 1.0, True)


def test_entry_without_the_subpackage(spark, monkeypatch):
    """Importing the subpackage fails as if its folder were gone; the entry then has the graph queries and no other."""
    for name in ("__spark_entry__", *[m for m in sys.modules if m.startswith("meshwork.llm") or m == "corpus_pipeline"]):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "meshwork.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0 and entry.queries() == catalog.QUERIES and entry.oracle_sql() == catalog.ORACLE
    monkeypatch.delitem(sys.modules, "__spark_entry__")
