"""Louvain and Leiden for graphs beyond one task: edges are packed once a level and stay where they are, nodes are arrays on the driver.

A sweep broadcasts some 22 bytes a node (communities, their masses, who moved last) to the pieces of edges, and only the nodes that it
looked at come back. A level of few edges is swept on the driver by the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions import kernels
from meshwork.plans.durable import checkpointed
from meshwork.plans.workers import trimmed

#: Edges of a piece (about: a node's edges lie in one), which is also how many stay on the driver: 12 bytes an edge.
PIECE = 1 << 19
#: Sweeps of a level without a better partition before it ends, though nodes still want to move, and sweeps at most.
PATIENCE, MAX_SWEEPS = 8, 60
FIELDS = [("at", np.int32), ("start", np.int32), ("near", np.int32), ("w", np.float64)]


def _piece(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple:
    """(nodes, where their edges start, the other ends, weights) of edges sorted by ``a``."""
    start = np.flatnonzero(np.diff(a, prepend=-1))
    return tuple(np.ascontiguousarray(x, kind) for (_, kind), x in zip(FIELDS, (a[start], start, b, w), strict=True))


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list) -> pa.RecordBatch:
            piece = _piece(*(np.concatenate(z) for z in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in piece], [c for c, _ in FIELDS])

        held, size = [], 0
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy() for c in ("a", "b", "w"))
            if size >= most and len(a):
                cut = np.searchsorted(a, held[-1][0][-1], side="right")  # a node's edges lie in one piece
                held.append((a[:cut], b[:cut], w[:cut]))
                if cut == len(a):
                    continue
                yield row(held)
                a, b, w, held, size = a[cut:], b[cut:], w[cut:], [], 0
            if len(a):
                held, size = [*held, (a, b, w)], size + len(a)
        if held:
            yield row(held)

    return trimmed(run)


class Packed:
    """Edges (a, b, w) without loops, each in both directions, once a pair."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        rows = checkpointed(edges.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "w"))
        count = rows.count()
        if count <= PIECE:
            t = rows.toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
            self.rows, self.local = None, [_piece(*(t.column(c).to_numpy() for c in ("a", "b", "w")))] if count else []
            return
        parts = max(self.spark.sparkContext.defaultParallelism, -(-count // PIECE))
        rows = rows.repartition(parts, "a").sortWithinPartitions("a", "b")
        self.local, self.rows = None, checkpointed(rows.mapInArrow(_pack(PIECE), ", ".join(f"{c} binary" for c, _ in FIELDS)))

    def each(self, job, shared: tuple) -> list[tuple]:
        """``job(piece, *shared)``, a tuple of arrays, of every piece."""
        if self.rows is None:
            return [job(piece, *shared) for piece in self.local]
        out = [(kinds, [np.frombuffer(x.as_buffer(), k) for x, k in zip(columns, kinds.split(), strict=True)]) for kinds, *columns in _rows(self._mapped(job, shared))]
        return [tuple(arrays) for _, arrays in out]

    def _mapped(self, job, shared: tuple) -> pa.Table:
        held = self.spark.sparkContext.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches):
                found = job(piece, *held.value)
                columns = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(x.dtype.str for x in found)]), pa.array([[c[0].as_py() for c in columns]], pa.list_(pa.binary()))], ["kinds", "found"])

        table = self.rows.mapInArrow(run, "kinds string, found array<binary>").toArrow()
        held.destroy()
        return table

    def merged(self, part: np.ndarray) -> Packed:
        """The edges between parts, ``part`` by node; weights of a pair are summed."""
        if self.rows is None:
            out = [kernels.merged_edges(piece, part) for piece in self.local]
            a, b, w = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 3
            new = object.__new__(Packed)
            new.spark, new.rows, new.local = self.spark, None, [_piece(a, b, w)] if len(a) else []
            return new
        held = self.spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kernels.merged_edges(piece, held.value)], ["a", "b", "w"])

        new = Packed(self.rows.mapInArrow(trimmed(run), "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w")))
        held.destroy()
        return new


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for r in batches:
        for row in range(len(r)):
            yield tuple(np.frombuffer(r.column(c)[row].as_buffer(), kind) for c, kind in FIELDS)


def _rows(table: pa.Table) -> Iterator[tuple]:
    for kinds, found in zip(table.column("kinds"), table.column("found"), strict=True):
        yield kinds.as_py(), *found


def connected_parts(edges: Packed, c: np.ndarray) -> np.ndarray:
    """The least node of the connected part of each node's community: least labels hook onto each other, then point to their roots."""
    label = np.arange(len(c), dtype=np.int32)
    while True:
        least = label.copy()
        for at, x in edges.each(kernels.least_inside, (c, label)):
            least[at] = np.minimum(least[at], x)
        if np.array_equal(least, label):
            return label
        np.minimum.at(label, label.copy(), least)
        label = np.minimum(label, least)
        while not np.array_equal(higher := label[label], label):
            label = higher


def level(edges: Packed, mass: np.ndarray, cost: float, loops: float, total: float, seed: int) -> tuple[np.ndarray, float, float]:
    """The best partition found by sweeps from single nodes: (communities, twice its quality, twice that of single nodes).

    A sweep looks at the nodes that moved, have a neighbour that did, or wait for their turn; half of them, at random, have it. When
    none is left all are looked at once more. Inside a piece nodes move one group after the other, and see each other do so.
    """
    n = len(mass)
    c, inner, waits, moved = np.arange(n, dtype=np.int32), np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
    best = top = start = None
    idle = 0
    for sweep in range(MAX_SWEEPS + 1):
        whole = bool(waits.all())
        masses = np.bincount(c, mass, n)
        turn = np.random.default_rng((seed, sweep)).random(n) < 0.5
        wants = np.zeros(n, bool)
        to = c.copy()
        for nodes, where, w in edges.each(kernels.moves, (c, masses, mass, cost, waits, moved, turn)):
            inner[nodes] = w
            wants[nodes] = where != c[nodes]
            to[nodes] = where
        # twice the sum over communities of inner weight less half the cost of their mass squared, before the sweep
        now = inner.sum() + loops - cost * float((masses * masses).sum())
        if start is None:
            best, top, start = c, now, now
        elif now > top + 1e-9 * abs(total):
            best, top, idle = c, now, 0
        else:
            idle += 1
        if (whole and not wants.any()) or idle >= PATIENCE:
            break
        moved = wants & turn
        waits = wants if wants.any() else np.ones(n, bool)
        c = np.where(moved, to, c)
    return best, top, start


def communities(edges: Packed, mass: np.ndarray, cost: float, loops: float, total: float, connected: bool = False, seed: int = 0) -> np.ndarray:
    """The community of each node: levels of sweeps and merges until a level finds nothing better. ``total`` is the sum of all degrees."""
    flat = np.arange(len(mass))
    while True:
        c, top, start = level(edges, mass, cost, loops, total, seed)
        if top <= start + 1e-9 * abs(total):
            return flat
        # inner weight of the level becomes loops: what the quality holds besides the masses
        loops = top + cost * float((np.bincount(c, mass, len(mass)) ** 2).sum())
        if connected:
            c = connected_parts(edges, c)
        names, part = np.unique(c, return_inverse=True)
        part = part.astype(np.int32)
        edges, mass, flat = edges.merged(part), np.bincount(part, mass, len(names)), part[flat]
