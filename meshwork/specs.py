"""Policies of a graph."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class GraphSpecs:
    """``dedupe`` is error, first or last; ``missing_nodes`` create or error; ``loops_forbidden`` (where self_loops is false) error or drop."""

    directed: bool = True
    dedupe: str = "error"
    missing_nodes: str = "error"
    multi_edges: bool = False
    self_loops: bool = False
    loops_forbidden: str = "error"

    def but(self, **changes) -> GraphSpecs:
        return replace(self, **changes)


def directed() -> GraphSpecs:
    return GraphSpecs()


def directed_create_missing() -> GraphSpecs:
    return GraphSpecs(missing_nodes="create")


def undirected() -> GraphSpecs:
    return GraphSpecs(directed=False)


def undirected_create_missing() -> GraphSpecs:
    return GraphSpecs(directed=False, missing_nodes="create")


def multi_directed() -> GraphSpecs:
    return GraphSpecs(multi_edges=True, self_loops=True)


def multi_undirected() -> GraphSpecs:
    return GraphSpecs(directed=False, multi_edges=True, self_loops=True)
