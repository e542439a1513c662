"""Searches over edges in pieces against the kernels of small graphs and against brute force."""

import numpy as np
import pytest

from meshwork import specs
from meshwork.functions import kernels
from meshwork.operators import centrality as C
from meshwork.operators import paths as P
from meshwork.operators.graph import Graph
from meshwork.plans import grid


def random_edges(n, p, seed, top=4):
    rng = np.random.default_rng(seed)
    return [(u, v, float(rng.integers(1, top))) for u in range(n) for v in range(n) if u != v and (u == 7 or rng.random() < p)]


@pytest.fixture
def small_grid(monkeypatch):
    """Many ranges, pieces and blocks, and no graph small enough for a kernel."""
    for name, value in (("RANGE", 9), ("PIECE", 8), ("SOURCES", 9), ("CHUNK", 64)):
        monkeypatch.setattr(grid, name, value)
    monkeypatch.setattr(P, "KERNEL_EDGES", 0)


def values(df):
    return {r["name"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("weighted", [False, True])
def test_closeness_and_betweenness_over_pieces(spark, small_grid, monkeypatch, weighted):
    """A directed graph with a hub, a node that nothing reaches and one without edges."""
    if weighted:
        monkeypatch.setattr(grid, "SOURCES", 17)  # one block
    edges = [e for e in random_edges(16, 0.15, 5, 3) if e[1] != 3]
    g = Graph.of(spark, specs.directed_create_missing(), edges, nodes=[*range(17)], kind="int")
    close = values(C.closeness_centrality(g, weighted))
    between = values(C.betweenness_centrality(g, weighted, normalized=False))
    monkeypatch.setattr(P, "KERNEL_EDGES", 10**6)
    assert close == pytest.approx(values(C.closeness_centrality(g, weighted))) and len(close) == 17
    assert between == pytest.approx(values(C.betweenness_centrality(g, weighted, normalized=False))) and max(between.values()) > 10


def test_a_hub_lies_in_many_pieces(spark, small_grid):
    edges = spark.range(1, 90).selectExpr("0L AS a", "id AS b", "1.0D AS w")
    laid = grid.Grid(edges.unionByName(edges.selectExpr("b AS a", "a AS b", "w")), 90)
    most = laid.pieces.selectExpr("max(size(a)) AS k", "sum(size(a)) AS n").first()
    assert most.n == 178 and most.k < 40
    sums = {r.idx: (r.x, r.y) for r in grid.reach_sums(laid, False).collect()}
    assert sums == {i: (90.0, 89.0 if i == 0 else 1 + 2 * 88.0) for i in range(90)}


def test_more_sources_than_a_word_of_bits(spark, monkeypatch):
    monkeypatch.setattr(grid, "SOURCES", 2)  # blocks of 128 bits
    ring = spark.range(150).selectExpr("id AS a", "(id + 1) % 150 AS b", "1.0D AS w").where("a % 10 < 9")
    sums = {r.idx: (int(r.x), int(r.y)) for r in grid.reach_sums(grid.Grid(ring, 150), False).collect()}
    c = kernels.Csr(150, *(np.array(z) for z in zip(*[(i + 1, i) for i in range(149) if i % 10 < 9], strict=True)), np.ones(135))
    for s in range(150):
        d = kernels.levels(c, s)[0]
        assert sums[s] == ((d >= 0).sum(), d[d >= 0].sum())
