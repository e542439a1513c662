"""Delta-stepping and levels over edges cut at hubs, against the kernels and brute force."""

import numpy as np
import pytest

from meshwork import specs
from meshwork.functions import kernels
from meshwork.operators import paths as P
from meshwork.operators.graph import Graph
from meshwork.plans import edges as E


def rows(df):
    return {(r.source, r.target): r.distance for r in df.collect()}


@pytest.fixture(scope="module")
def hubs(spark):
    """A hub with an edge to every node, a chain of light and heavy edges, zero weights and a node that nothing reaches."""
    rng = np.random.default_rng(2)
    e = [(0, v, float(rng.integers(5, 9))) for v in range(1, 14)] + [(v, v + 1, float(rng.choice([0.0, 1.0, 7.5]))) for v in range(1, 13)] + [(v, 0, 2.0) for v in range(11, 14)]
    return Graph.of(spark, specs.directed_create_missing(), e, nodes=[*range(15)], kind="int")


def test_delta_stepping_with_target_and_cutoff(hubs, monkeypatch):
    whole = rows(P.multi_source(hubs, [0, 9], True, with_paths=False))
    short = rows(P.multi_source(hubs, [0, 9], True, cutoff=6.5, with_paths=False))
    near = rows(P.multi_source(hubs, [0, 9], True, target=8, with_paths=False, include_settled=True))
    assert short == {k: d for k, d in whole.items() if d <= 6.5} and len(short) < len(whole)
    assert near == {k: d for k, d in whole.items() if d <= whole[k[0], 8]} and len(near) < len(whole)
    monkeypatch.setattr(P, "KERNEL_EDGES", 0)
    monkeypatch.setattr(E, "PIECE_ROWS", 4)
    assert rows(P.multi_source(hubs, [0, 9], True, with_paths=False)) == whole
    assert rows(P.multi_source(hubs, [9], True, cutoff=6.5, with_paths=False)) == {k: d for k, d in short.items() if k[0] == 9}
    assert rows(P.multi_source(hubs, [0, 9], True, target=8, with_paths=False)) == {k: d for k, d in whole.items() if k[1] == 8}
    assert rows(P.multi_source(hubs, [14], True, with_paths=False)) == {(14, 14): 0.0}


def test_kernels_stop_where_they_are_told():
    rng = np.random.default_rng(7)
    for weighted in (False, True):
        for _ in range(30):
            u, v = rng.integers(0, 25, 60), rng.integers(0, 25, 60)
            g = kernels.Csr(25, u, v, rng.integers(0, 4, 60).astype(float))
            s, t, most = int(rng.integers(25)), int(rng.integers(25)), float(rng.integers(0, 5))
            full = kernels.distances(g, weighted, s)
            assert np.array_equal(kernels.distances(g, weighted, s, most), np.where(full <= most, full, np.inf))
            assert np.array_equal(kernels.distances(g, weighted, s, stop=t), np.where(full <= full[t], full, np.inf))


def test_a_hub_is_cut_and_rounds_do_not_shuffle_edges(spark, hubs, monkeypatch):
    monkeypatch.setattr(E, "PIECE_ROWS", 4)
    split = E.SplitEdges(hubs.adj)
    sizes = {(r.src, r.salt): r["count"] for r in split.table.read().groupBy("src", "salt").count().collect()}
    assert sum(n for (s, _), n in sizes.items() if s == 0) == 13 and len([1 for s, _ in sizes if s == 0]) > 1 and max(sizes.values()) < 12
    front = spark.createDataFrame([(0, 1.5), (5, 2.5)], "name int, d double")
    got = sorted((r.name, r.d, r.dst) for r in split.out_of(front, "name").collect())
    assert got == sorted([(0, 1.5, v) for v in range(1, 14)] + [(5, 2.5, 6)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split.out_of(front, "name")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index("FileScan parquet")].splitlines()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan[-1]
    split.drop()


def test_levels_of_a_star_take_two_rounds(spark, monkeypatch):
    """100,000 leaves of one hub lie in many pieces, and levels are appended once each."""
    monkeypatch.setattr(E, "PIECE_ROWS", 5_000)
    leaves = spark.range(1, 100_001).selectExpr("0L AS u", "id AS v", "id AS seq")
    g = Graph.build(spark.createDataFrame([(0, 0)], "seq long, name long"), leaves, specs.directed_create_missing())
    split = E.SplitEdges(g.adj)
    most = split.table.read().groupBy("src", "salt").count().agg({"count": "max"}).first()[0]
    split.drop()
    assert most < 8_000
    assert {(r.level, r["count"]) for r in P.breadth_first_search(g, 0).groupBy("level").count().collect()} == {(0, 1), (1, 100_000)}


def test_paths_through_a_node_are_those_of_all_pairs_that_hold_it(spark):
    rng = np.random.default_rng(3)
    e = [(int(u), int(v), float(rng.integers(1, 4))) for u in range(11) for v in rng.permutation(11)[:2] if u != v]
    g = Graph.of(spark, specs.directed_create_missing().but(dedupe="first"), e, nodes=[*range(12)], kind="int")
    every = P.all_pairs(g, True, with_paths=True).where(P.contains_path_through_node("paths", 4)).collect()
    got = P.get_all_shortest_paths_involving(g, 4, True).collect()
    key = lambda r: (r.source, r.target, r.distance, r.paths)
    assert sorted(map(key, got)) == sorted(map(key, every)) and got
