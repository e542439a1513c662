"""Strongly connected components against brute force: chains, cycles, trees, hubs and random graphs, with plain and with salted lookups."""

import random

import pytest

from meshwork.plans import edges as cut
from meshwork.plans import skew, strong


def by_hand(names, pairs):
    out = {n: set() for n in names}
    for a, b in pairs:
        out[a].add(b)

    def reached(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    ahead = {n: reached(n) for n in names}
    return {n: min(m for m in ahead[n] if n in ahead[m]) for n in names}


def components(spark, names, pairs):
    rows = strong.strong_components(spark.createDataFrame([(n,) for n in names], "name int"), spark.createDataFrame(pairs, "src int, dst int")).collect()
    assert len(rows) == len(names)
    return {r.name: r.component for r in rows}


def test_chains_cycles_and_trees(spark):
    pairs = [(i, i + 1) for i in range(12)]  # a chain
    pairs += [(100 + i, 100 + (i + 1) % 11) for i in range(11)]  # a cycle of chain nodes only
    pairs += [(200, 201), (201, 202), (202, 200), (200, 210), (210, 211), (211, 200), (202, 220), (220, 221), (221, 222)]  # chains that come back, and one that doesn't
    pairs += [(300, 301), (301, 300), (301, 302), (302, 303), (303, 304), (304, 303), (5, 5), (0, 1)]  # two cycles with a chain between, a loop, a repeat
    pairs += [(400 + i, 400 + (i - 1) // 2) for i in range(1, 15)]  # a tree
    names = sorted({x for e in pairs for x in e} | {999})
    assert components(spark, names, pairs) == by_hand(names, pairs)
    assert components(spark, [], []) == {} and components(spark, [1, 2], []) == {1: 1, 2: 2}


@pytest.mark.parametrize("hot", [False, True])
def test_random_graphs(spark, monkeypatch, hot):
    """With every bound at its least: hubs are cut, lookups salt what they can, and degrees alone never do."""
    if hot:
        monkeypatch.setattr(skew, "HOT_SHARE", 0.2)
        monkeypatch.setattr(cut, "PIECE_ROWS", 3)
        monkeypatch.setattr(strong, "ENOUGH", 1.0)
    rng = random.Random(3)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(27)]  # some large component, many chains
    pairs += [(200, 201 + i) for i in range(8)] + [(201 + i, 200) for i in range(0, 8, 2)]  # a hub
    names = sorted({x for e in pairs for x in e})
    assert components(spark, names, pairs) == by_hand(names, pairs)


def test_a_giant_component_needs_no_colours(spark, monkeypatch):
    """Before, every node sent its colour on whenever it changed, several times over all edges."""
    monkeypatch.setattr(strong, "_colours", None)
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(250)] + [(50, 1), (2, 51), (51, 52)]
    names = sorted({x for e in pairs for x in e})
    assert components(spark, names, pairs) == by_hand(names, pairs)
