"""Rows of nodes and edges for graphs made by hand."""

from __future__ import annotations

import math

NAN = math.nan


def node(name, attributes=None) -> tuple:
    return (name, attributes)


def edge(u, v, weight: float = NAN, attributes=None) -> tuple:
    """Without a weight the edge is unweighted, which is NaN."""
    return (u, v, float(weight), attributes)


def ordered(e: tuple) -> tuple:
    return reversed_edge(e) if e[0] > e[1] else e


def reversed_edge(e: tuple) -> tuple:
    return (e[1], e[0], *e[2:])
