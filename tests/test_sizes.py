"""What larger tables brought to light: empty cuts, dense matrices in pieces, searches from blocks of sources."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork import catalog, specs
from meshwork.functions import kernels
from meshwork.operators import centrality as C
from meshwork.operators import paths as P
from meshwork.operators import structure as S
from meshwork.operators.graph import Graph
from meshwork.sources import graphml


def test_an_empty_cut_is_null_as_in_sql(spark, tmp_path):
    """Two groups of users that no hand-off connects."""
    duckdb = pytest.importorskip("duckdb")
    users = [(k, u) for k, group in (("a", [1, 2, 3, 5, 8, 1]), ("b", [4, 6, 7, 4])) for u in group]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), u, k) for i, (k, u) in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert db.sql(catalog.ORACLE["cut_size"]).fetchall() == [tuple(r) for r in catalog.QUERIES["cut_size"](spark, str(tmp_path)).collect()] == [(None,)]
    assert S.cut_size(catalog.handoff(spark, str(tmp_path)), [1, 2], [4], True) == 0.0


def random_graph(n, p, seed, top=4):
    rng = np.random.default_rng(seed)
    u, v = (np.array(z) for z in zip(*[(u, v) for u in range(n) for v in range(n) if v != 5 and rng.random() < p], strict=True))
    return kernels.Csr(n, u, v, rng.integers(1, top, len(u)).astype(float))


@pytest.mark.parametrize("weighted", [False, True])
def test_searches_from_blocks_equal_those_from_single_sources(weighted, monkeypatch):
    monkeypatch.setattr(kernels, "EDGES_AT_ONCE", 7)
    for seed in range(5):
        c = random_graph(70, 0.04, seed)
        g, own = kernels.Sweeps(c, weighted), np.arange(70)
        for most, stop in ((np.inf, None), (2.0, None), (np.inf, 7)):
            pairs = [{(s, t): d for found in kernels.settled(form, weighted, own, most, stop) for s, t, d in zip(*(x.tolist() for x in found), strict=True)} for form in (c, g)]
            assert pairs[0] == pairs[1] and len(pairs[0]) >= 70
        assert all(np.array_equal(*x) for x in zip(kernels.reach_totals(c, weighted, own), kernels.reach_totals(g, weighted, own), strict=True))
        for s in own:
            (d, k, _), (d2, k2, _) = kernels.path_steps(c, weighted, s), kernels.path_steps(g, weighted, s)
            assert np.array_equal(d, d2) and np.array_equal(k, k2)
            assert np.allclose(kernels.dependencies(c, weighted, s), kernels.dependencies_from(g, s))


def test_weights_that_are_no_whole_numbers_go_one_by_one(spark):
    """Halves of the weights give halves of the distances, by the other kernels, and the same paths."""
    edges = [(int(u), int(v), float(w)) for c in [random_graph(30, 0.1, 3)] for u, v, w in zip(c.src, c.dst, c.weight, strict=True)]
    whole, half = (Graph.of(spark, specs.directed_create_missing().but(self_loops=True), [(u, v, w / k) for u, v, w in edges], kind="int") for k in (1, 2))
    get = lambda rows: {r[0]: r[1] for r in rows.collect()}
    near = lambda g: {(r.source, r.target): r.distance for r in P.all_pairs(g, True).collect()}
    assert {k: d / 2 for k, d in near(whole).items()} == near(half)
    assert get(C.closeness_centrality(half, True)) == pytest.approx({k: 2 * x for k, x in get(C.closeness_centrality(whole, True)).items()})
    assert C.group_betweenness_centrality(whole, [1, 2], True, True, True) == pytest.approx(C.group_betweenness_centrality(half, [1, 2], True, True, True))
    through = lambda g: {(r.source, r.target): sorted(map(tuple, r.paths)) for r in P.get_all_shortest_paths_involving(g, 1, True).collect()}
    found = through(whole)
    assert found == through(half) and all(any(1 in p[1:-1] for p in x) for x in found.values()) and len(found) == 3


def test_all_pairs_are_named_without_a_join(spark):
    """A join would take the pairs for few enough to broadcast."""
    g = Graph.of(spark, specs.directed_create_missing(), [("a", "b", 1.0), ("b", "c", 2.0)])
    pairs = P.all_pairs(g, True)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")  # nothing follows the searches
    assert {tuple(r) for r in pairs.collect()} == {("a", "a", 0.0), ("b", "b", 0.0), ("c", "c", 0.0), ("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 2.0)}


def test_a_dense_matrix_in_pieces(spark, monkeypatch):
    g = Graph.of(spark, specs.directed_create_missing(), [(0, 1, 2.0), (1, 2, 3.0), (4, 0, 1.0)], nodes=[*range(5)], kind="int")
    monkeypatch.setattr("meshwork.operators.graph.DENSE_VALUES", 2)
    pieces = g.dense_pieces(True, 2)
    assert pieces.rdd.getNumPartitions() == 13  # by the number of values
    flat = np.full(25, np.nan)
    for r in pieces.collect():
        assert len(r["values"]) <= 2
        flat[r.i * 5 + r["first"] :][: len(r["values"])] = r["values"]
    assert flat.tolist() == g.get_adjacency_matrix_vec(True)


def test_triangles_come_from_lists_not_from_wedges(spark):
    """Against brute force, with strengths; before, each wedge was a row that travelled to its third edge."""
    rng = np.random.default_rng(2)
    ties = {(u, v): float(rng.integers(1, 9)) for u in range(25) for v in range(u + 1, 25) if u == 0 or rng.random() < 0.3}
    rows = spark.createDataFrame([(a, b, w) for (u, v), w in ties.items() for a, b in ((u, v), (v, u))], "a int, b int, s double")
    found = S.triangle_rows(rows)
    want = {(u, v, x): ties[u, v] * ties[u, x] * ties[v, x] for u, v in ties for x in range(v + 1, 25) if (u, x) in ties and (v, x) in ties}
    assert "array_intersect" in found._jdf.queryExecution().toString()
    assert {tuple(sorted((r.x, r.y, r.z))): r.p for r in found.collect()} == want and found.count() == len(want) > 50


def test_the_gap_of_a_large_graph_takes_few_products(spark, monkeypatch):
    """Beyond the dense matrix, by a Krylov basis over packed edges, with a hub in several pieces; before, by 300 rounds of joins at most."""
    monkeypatch.setattr(C, "PACKED_EDGES", 40)
    monkeypatch.setattr(C, "DENSE_NODES", 0)
    monkeypatch.setattr(C, "gap_rounds", None)
    rng = np.random.default_rng(6)
    ties = [(u, v, float(rng.integers(1, 5))) for u in range(60) for v in range(u, 60) if u == 0 or rng.random() < 0.3]
    g = Graph.of(spark, specs.undirected_create_missing().but(self_loops=True), ties, kind="int")
    for weighted in (True, False):
        values = np.linalg.eigvalsh(g.get_adjacency_matrix_ndarray(weighted))
        assert C.spectral_gap(g, weighted) == pytest.approx(values[-1] - values[-2], abs=1e-6)


def test_a_krylov_basis_of_little_room_and_repeated_eigenvalues():
    path = np.diag(np.ones(99), 1) + np.diag(np.ones(99), -1)
    star = np.zeros((40, 40))
    star[0, 1:] = star[1:, 0] = 1.0
    for a, room in ((path, 1 << 20), (path, 0), (np.kron(np.eye(2), path), 1 << 20), (star, 1 << 20), (np.kron(np.eye(2), star), 1 << 20), (np.zeros((30, 30)), 1 << 20), (star[:3, :3], 0)):
        values = np.linalg.eigvalsh(a)
        assert kernels.krylov_gap(lambda x, a=a: a @ x, len(a), room) == pytest.approx(values[-1] - values[-2], abs=1e-7)


def test_paths_down_travel_as_lists(spark, monkeypatch):
    """One row for each tie, though there are many more paths, each of which was a row before; hubs in parts give the same."""
    rng = np.random.default_rng(8)
    ties = [(u, v) for u in range(40) for v in range(u + 1, 40) if u < 2 or rng.random() < 0.3]
    g = Graph.of(spark, specs.undirected_create_missing(), ties, nodes=[*range(42)], kind="int")
    near: dict = {v: set() for v in range(42)}
    for u, v in ties:
        near[u].add(v), near[v].add(u)

    def square(v):
        q = possible = 0
        for u, w in itertools.combinations(near[v], 2):
            both = len((near[u] & near[w]) - {v})
            theta = both + 1 + (w in near[u])
            q, possible = q + both, possible + len(near[u]) - theta + len(near[w]) - theta + both
        return q / possible if possible > 0 else 0.0

    want = {v: pytest.approx(square(v)) for v in near}
    assert {r.name: r.value for r in S.square_clustering(g).collect()} == want
    rows = S._path_lists(S._by_rank(g)[1])[0].collect()
    assert len(rows) == len(ties) < sum(len(r.lows) for r in rows) / 3
    monkeypatch.setattr(S, "GROUP_PATHS", 60)
    monkeypatch.setattr(S, "LIST_NODES", 7)
    monkeypatch.setattr(S, "TASK_PATHS", 100)
    assert {r.name: r.value for r in S.square_clustering(g).collect()} == want
    assert max(r.part for r in S._path_lists(S._by_rank(g)[1])[0].collect()) > 2


def test_a_document_is_written_and_read_in_parts(spark, tmp_path):
    """The parts, put together by name, are the document; before, one task wrote it and one read it."""
    g = Graph.of(spark, specs.directed_create_missing(), [(f"n{i % 90}<&>\"", f"n{i * 7 % 300}", i / 2) for i in range(400) if i % 90 != i * 7 % 300], nodes=["z", "a"])
    path = str(tmp_path / "g")
    graphml.write_graphml_file(g, path)
    files = sorted((tmp_path / "g").glob("part-*"))
    assert len(files) > 4 and "".join(f.read_text() for f in files) == graphml.write_graphml_string(g) + "\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert graphml._by_lines(spark, path)[0].rdd.getNumPartitions() > 4
        back = graphml.read_graphml_file(spark, path, specs.directed_create_missing())
        name = lambda h: [r.name for r in h.nodes.orderBy("idx").collect()]
        rows = lambda h: [tuple(r) for r in h.edges.orderBy("seq").select("u", "v", "weight").collect()]
        assert name(back) == name(g) and rows(back) == rows(g)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ['<graphml><graph edgedefault="undirected"><node id="b"/><node id="a"/>\n<edge source="b"\ntarget="a"><data key="weight">2</data></edge></graph></graphml>',
                                  '<graphml>\n<!-- <graph edgedefault="directed"> -->\n<graph edgedefault="undirected">\n<node id="b"/>\n<edge source="b" target="a"><data key="weight">2</data></edge>\n</graph>\n</graphml>',
                                  "<graphml>\n<key id='w' for='edge' attr.name='weight'/>\n<graph id='g' edgedefault='undirected'>\n<node id='b'></node>\n<edge source='b' target='a'><data key='x'>3</data><data key='w'> 2.0 </data></edge>\n</graph></graphml>"])
def test_documents_with_and_without_lines(spark, text):
    back = graphml.read_graphml_string(spark, text, specs.directed_create_missing())
    assert not back.specs.directed and [r.name for r in back.nodes.orderBy("idx").collect()] == ["b", "a"] and back.size(True) == 2.0


def planted(spark, groups=6, size=20, seed=4):
    """Groups of many ties inside and few between, with a loop and whole weights."""
    rng = np.random.default_rng(seed)
    n = groups * size
    ties = [(u, v, float(rng.integers(1, 4))) for u in range(n) for v in range(u + 1, n) if rng.random() < (0.5 if u // size == v // size else 0.02)]
    return Graph.of(spark, specs.undirected_create_missing().but(self_loops=True), [*ties, (0, 0, 2.0)], kind="int"), {v: v // size for v in range(n)}


def partition(found):
    groups: dict = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.name)
    return {frozenset(x) for x in groups.values()}


def test_leiden_sweeps_over_packed_edges(spark, monkeypatch):
    """Edges are packed once a level and a sweep is one job; before, it was a chain of joins with two checkpoints."""
    from meshwork.plans import communities

    g, want = planted(spark)
    monkeypatch.setattr(C, "SEQUENTIAL_EDGES", 0)
    monkeypatch.setattr(communities, "PIECE", 300)
    swept, packed = [], communities.Packed.each
    monkeypatch.setattr(communities.Packed, "each", lambda self, job, shared: swept.append((self.rows is None, len(found := packed(self, job, shared)))) or found)
    for quality, resolution in (("modularity", 1.0), ("cpm", 0.2)):
        found = C.leiden(g, True, quality=quality, resolution=resolution, seed=3)
        assert partition(found) == {frozenset(v for v in want if want[v] == k) for k in range(6)}
    assert max(k for _, k in swept) > 3 and {local for local, _ in swept} == {True, False}  # several pieces in tasks, then few edges on the driver


def test_parts_of_communities_are_connected():
    from meshwork.plans import communities

    path = [(i, i + 1) for i in range(9)]
    a, b = (np.array(z) for z in zip(*sorted([*path, *[(v, u) for u, v in path]]), strict=True))
    edges = object.__new__(communities.Packed)
    edges.rows, edges.local = None, [communities._piece(a[:7], b[:7], np.ones(7)), communities._piece(a[7:], b[7:], np.ones(len(a) - 7))]
    assert communities.connected_parts(edges, np.array([1, 1, 1, 2, 2, 1, 1, 2, 2, 2], np.int32)).tolist() == [0, 0, 0, 3, 3, 5, 5, 7, 7, 7]


def test_louvain_sweeps_over_packed_edges(spark, monkeypatch):
    """Also a graph of middling size, which went through plain Python on the driver before."""
    g, want = planted(spark)
    monkeypatch.setattr(kernels, "louvain", None)
    assert C.SEQUENTIAL_EDGES <= 200_000
    monkeypatch.setattr(C, "SEQUENTIAL_EDGES", 1_000)
    assert partition(C.louvain_communities(g, True)) == {frozenset(v for v in want if want[v] == k) for k in range(6)}


def test_partitions_cut_no_lineage_in_sweeps(spark, monkeypatch):
    """Whatever the number of sweeps; before, each of up to 60 left two checkpoints and their plans with the driver."""
    from meshwork.plans import communities, durable

    g, want = planted(spark)
    monkeypatch.setattr(C, "SEQUENTIAL_EDGES", 0)
    monkeypatch.setattr(communities, "PIECE", 300)
    cuts = []
    for module in (C, communities):
        monkeypatch.setattr(module, "checkpointed", lambda df: cuts.append(1) or durable.checkpointed(df))
    [found] = C.louvain_partitions(g, True)
    assert partition(found) == {frozenset(v for v in want if want[v] == k) for k in range(6)}
    assert len(cuts) <= 8


def test_a_dense_matrix_by_strips(spark, tmp_path):
    """Equal to the rows; before, each row ran through all columns, which took many times the room on disk."""
    rng = np.random.default_rng(5)
    g = Graph.of(spark, specs.directed_create_missing().but(self_loops=True), [(int(u), int(v), float(rng.integers(1, 9))) for u, v in {(a, b) for a, b in rng.integers(0, 90, (400, 2)).tolist()}], nodes=[*range(100)], kind="int")
    want = g.get_adjacency_matrix_ndarray(True)
    for side in (1, 7, 128):
        got = np.full((100, 100), np.nan)
        for r in g.dense_columns(True, side).collect():
            assert len(r["values"]) == min(side, 100 - r["first"])
            got[r["first"] : r["first"] + side, r.j] = r["values"]
        assert np.array_equal(got, want)
    g = Graph.of(spark, specs.directed_create_missing(), [(u, u + 1, 1.0) for u in range(1999)], kind="int")
    by_column = g.dense_columns(True).select("first", "j", F.posexplode("values").alias("k", "value")).select((F.col("first") + F.col("k")).alias("i"), "j", "value")
    by_row = g.get_adjacency_matrix_vec_vec(True).select("i", F.posexplode("row").alias("j", "value")).select("i", F.col("j").cast("long").alias("j"), "value")
    room = []
    for k, rows in enumerate((by_column, by_row)):
        rows.write.parquet(str(tmp_path / str(k)))
        room.append(sum(f.stat().st_size for f in (tmp_path / str(k)).glob("*.parquet")))
    assert room[0] < room[1] / 2


@pytest.mark.parametrize("half", [1, 2])
def test_paths_are_spelt_out_where_they_are_found(spark, monkeypatch, half):
    """With paths of several lengths between a pair, some paths at a time, for names in another order than nodes; nothing is shuffled after the searches."""
    c = random_graph(25, 0.15, 6)
    d, sigma, steps = kernels.path_steps(c, True, 2)
    alike = []
    for most in (3, 1 << 16):
        monkeypatch.setattr(kernels, "PATHS_AT_ONCE", most)
        lots = list(kernels.spelt_paths(2, steps, sigma, np.isfinite(d) & (d > 0), np.arange(25)[::-1]))
        alike.append([np.concatenate(z).tolist() for z in zip(*lots, strict=True)])
        assert alike[-1][1] == sigma[alike[-1][0]].tolist() and (len(lots) > 3) == (most == 3)
    assert alike[0] == alike[1]
    edges = [(f"{int(u) * 7 % 25}", f"{int(v) * 7 % 25}", float(w) / half) for u, v, w in zip(c.src, c.dst, c.weight, strict=True)]
    g = Graph.of(spark, specs.directed_create_missing().but(self_loops=True), edges)
    found = P.get_all_shortest_paths_involving(g, "7", True)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    every = {(r.source, r.target): (r.distance, r.paths) for r in P.all_pairs(g, True, with_paths=True).collect()}
    want = {k: x for k, x in every.items() if k[0] != "7" != k[1] and any("7" in p for p in x[1])}
    got = {(r.source, r.target): (r.distance, r.paths) for r in found.collect()}
    assert got == want and max(len({len(p) for p in x[1]}) for x in want.values()) > 1 and max(len(x[1]) for x in want.values()) > 3


def alike(a, b):
    return a.n == b.n and len(a.classes) == len(b.classes) and all(x[0] == y[0] and all(np.array_equal(p, q) for p, q in zip(x[1:], y[1:], strict=True)) for x, y in zip(a.classes, b.classes, strict=True)) and all(np.array_equal(p, q) for k in ("outward", "inward") for p, q in zip(getattr(a, k), getattr(b, k), strict=True))


def test_searches_go_by_sweeps_beyond_the_bound_of_other_kernels(spark, monkeypatch):
    """Their edges are sorted by tasks; before, the driver sorted all, and beyond the bound messages of 1,024 sources an edge were shuffled."""
    c = random_graph(40, 0.1, 2)
    g = Graph.of(spark, specs.directed_create_missing().but(self_loops=True), [(int(u), int(v), float(w)) for u, v, w in zip(c.src, c.dst, c.weight, strict=True)], nodes=[*range(40)], kind="int")
    for weighted in (False, True):
        assert alike(P.sweeps(g, weighted), kernels.Sweeps(P.csr(g, weighted), weighted))
    jobs = (lambda: C.closeness_centrality(g), lambda: C.closeness_centrality(g, True), lambda: C.betweenness_centrality(g), lambda: C.betweenness_centrality(g, True), lambda: P.all_pairs(g), lambda: P.all_pairs(g, True))
    get = lambda rows: sorted((*r[:-1], round(r[-1], 9)) for r in rows.collect())
    want = [get(f()) for f in jobs]
    group = C.group_betweenness_centrality(g, [1, 2])
    monkeypatch.setattr(P, "KERNEL_EDGES", g.adj.count() // 2)
    for name in ("csr", "length_rounds"):
        monkeypatch.setattr(P, name, None)
    for name in ("Grid", "count_rounds"):
        monkeypatch.setattr(C, name, None)
    assert not P.small_enough(g) and [get(f()) for f in jobs] == want
    assert C.group_betweenness_centrality(g, [1, 2]) == pytest.approx(group)


@pytest.mark.parametrize("weighted", [False, True])
def test_edges_are_laid_out_a_stretch_at_a_time(weighted, monkeypatch):
    """Before, all that left a front at once, some 40 bytes an edge."""
    c = random_graph(60, 0.2, 7)
    g, own, sizes = kernels.Sweeps(c, weighted), np.arange(60), []
    monkeypatch.setattr(kernels, "STRETCH", 50)
    edges = kernels._edges
    monkeypatch.setattr(kernels, "_edges", lambda *a: sizes.append(len((found := edges(*a))[0])) or found)
    onward = kernels.Sweeps.onward
    monkeypatch.setattr(kernels.Sweeps, "onward", lambda self, k, rows: (sizes.append(len(x[0])) or x for x in onward(self, k, rows)))
    assert all(np.array_equal(*x) for x in zip(kernels.reach_totals(c, weighted, own), kernels.reach_totals(g, weighted, own), strict=True))
    for s in own:
        assert np.allclose(kernels.dependencies(c, weighted, s), kernels.dependencies_from(g, s))
    assert max(sizes) <= max(100, len(c.dst) // 8 + 1) < len(c.dst) / 2
