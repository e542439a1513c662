"""Square clustering and constraint, which find squares and triangles by rank, against sums over all pairs."""

import itertools
import math

import numpy as np
import pytest

from meshwork import specs
from meshwork.operators import structure as S
from meshwork.operators.graph import Graph


def values(df):
    return {r["name"]: r["value"] for r in df.collect()}


def square(near, v):
    """Over pairs of neighbours: common neighbours, and what there could be."""
    q = possible = 0
    for u, w in itertools.combinations(sorted(near[v]), 2):
        both = len((near[u] & near[w]) - {v})
        theta = both + 1 + (w in near[u])
        q, possible = q + both, possible + len(near[u]) - theta + len(near[w]) - theta + both
    return q / possible if possible > 0 else 0.0


def burt(m, names):
    """Constraint from the matrix of mutual weights, all pairs of nodes and all third ones."""
    p = {a: {b: m[a][b] / sum(m[a].values()) for b in m[a]} for a in names}
    return {a: sum((p[a][b] + sum(p[a].get(w, 0) * p[w].get(b, 0) for w in names if w not in (a, b))) ** 2 for b in p[a]) if p[a] else math.nan for a in names}


@pytest.fixture(scope="module")
def edges():
    """A hub, a second hub tied to it, random ties and a node without any."""
    rng = np.random.default_rng(9)
    pairs = {(0, v) for v in range(1, 20)} | {(1, v) for v in range(2, 15)} | {(u, v) for u, v in itertools.combinations(range(20), 2) if rng.random() < 0.2}
    return [(u, v, float(rng.integers(1, 6))) for u, v in sorted(pairs)]


def test_squares_and_constraint_equal_brute_force(spark, edges):
    g = Graph.of(spark, specs.undirected_create_missing().but(self_loops=True), [*edges, (3, 3, 9.0)], nodes=[*range(21)], kind="int")
    near = {v: set() for v in range(21)}
    m: dict = {v: {} for v in range(21)}
    for u, v, w in edges:
        near[u].add(v), near[v].add(u)
        m[u][v] = m[v][u] = w
    assert values(S.square_clustering(g)) == pytest.approx({v: square(near, v) for v in near})
    assert values(S.constraint(g, weighted=True)) == pytest.approx(burt(m, m), nan_ok=True)


def test_constraint_of_directed_graphs(spark, edges):
    rng = np.random.default_rng(4)
    turned = [(v, u, w) if rng.random() < 0.5 else (u, v, w) for u, v, w in edges] + [(5, 0, 2.0)]
    g = Graph.of(spark, specs.directed_create_missing().but(dedupe="last"), turned, kind="int")
    m: dict = {v: {} for v in range(20)}
    for u, v, w in {(u, v): (u, v, w) for u, v, w in turned}.values():
        m[u][v] = m[u].get(v, 0) + w
        m[v][u] = m[v].get(u, 0) + w
    out = {u for u, _, _ in turned}
    want = {k: x if k in out else math.nan for k, x in burt(m, m).items()}
    assert values(S.constraint(g, weighted=True)) == pytest.approx(want, nan_ok=True)


def test_no_pairs_of_a_hubs_neighbours(spark):
    """A star of 100,000 leaves has five thousand million pairs of neighbours; no step lists them."""
    leaves = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b", "1.0D AS p")
    ranked = S._ranked(leaves.unionByName(leaves.selectExpr("b AS a", "a AS b", "1e-5D AS p")))
    assert S._closed(ranked).count() == 200_000
    star = Graph.build(spark.createDataFrame([(0, 0)], "seq long, name long"), leaves.selectExpr("a AS u", "b AS v", "b AS seq"), specs.undirected_create_missing())
    assert S.square_clustering(star).where("value <> 0").isEmpty()


def test_neighbour_lists_in_chunks(spark, edges):
    g = Graph.of(spark, specs.undirected_create_missing(), edges, nodes=[*range(21)], kind="int")
    whole = {r.name: r.successors for r in g.get_successors_map().collect()}
    got: dict = {}
    for r in g.get_successors_chunks(4).orderBy("name", "chunk").collect():
        got.setdefault(r.name, []).append(r.successors)
    assert {k: sum(v, []) for k, v in got.items()} == whole and len(got[0]) == 5 and max(map(len, got[0])) <= 5
    assert g.get_predecessors_chunks(4).isEmpty()
