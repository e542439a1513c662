"""Per-source and sequential graph kernels in numpy, run inside Spark tasks."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from meshwork.errors import GraphError

#: A move must gain more than this, so that rounding doesn't move nodes to and fro.
GAIN = 1e-7


class Csr:
    """Out-neighbours by node index."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.n, self.dst, self.weight = n, dst[order].astype(np.int64), weight[order]
        self.start = np.searchsorted(src[order], np.arange(n + 1))

    @cached_property
    def stride(self) -> float:
        """How far beyond the nearest pending node a step of :func:`nearest` reaches: the mean weight."""
        return float(self.weight.mean()) if len(self.weight) else 0.0

    @cached_property
    def src(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.start))

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges out of the nodes: (position in ``nodes``, position in ``dst`` and ``weight``)."""
        first, count = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(np.arange(len(nodes)), count)
        return at, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)

    def out_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges out of the nodes: (position in ``nodes``, neighbour)."""
        at, edge = self.edges_of(nodes)
        return at, self.dst[edge]


def levels(g: Csr, s: int, most: float = np.inf, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """Hop distances (-1: unreached), numbers of shortest paths, and per level its edges (from, to); no level beyond ``most`` or that of ``stop``."""
    dist, sigma = np.full(g.n, -1, np.int64), np.zeros(g.n)
    dist[s], sigma[s] = 0, 1.0
    front, d, steps = np.array([s]), 0, []
    while len(front) and d + 1 <= most and (stop is None or dist[stop] < 0):
        at, to = g.out_of(front)
        src = front[at]
        d += 1
        dist[to[dist[to] < 0]] = d
        keep = dist[to] == d
        src, to = src[keep], to[keep]
        if not len(to):
            break
        sigma += np.bincount(to, sigma[src], g.n)
        steps.append((src, to))
        front = np.unique(to)
    return dist, sigma, steps


def nearest(g: Csr, s: int, most: float = np.inf, stop: int | None = None) -> np.ndarray:
    """Weighted distances (inf: unreached), by steps over all pending nodes within a stride of the nearest; weights aren't negative.

    Nothing beyond ``most`` or the distance of ``stop`` is reached, and the search ends there.
    """
    dist = np.full(g.n, np.inf)
    dist[s] = 0.0
    pending = np.array([s])
    while len(pending):
        d = dist[pending]
        if d.min() > min(most, np.inf if stop is None else dist[stop]):
            break
        now = d <= d.min() + g.stride
        at, edge = g.edges_of(pending[now])
        to, far = g.dst[edge], d[now][at] + g.weight[edge]
        less = far < dist[to]
        to = to[less]
        np.minimum.at(dist, to, far[less])
        waits = np.zeros(g.n, bool)
        waits[pending[~now]] = True
        waits[to] = True
        pending = np.flatnonzero(waits)
    dist[dist > min(most, np.inf if stop is None else dist[stop])] = np.inf
    return dist


def tight_levels(g: Csr, s: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Weighted distances, numbers of shortest paths, and the edges on shortest paths in rounds (from, to); weights are positive.

    A node's edges come in the round after the last one that reaches it.
    """
    dist = nearest(g, s)
    on = np.flatnonzero((dist[g.src] + g.weight == dist[g.dst]) & np.isfinite(dist[g.src]))
    src, to = g.src[on], g.dst[on]
    start, waits, sigma = np.searchsorted(src, np.arange(g.n + 1)), np.bincount(to, minlength=g.n), np.zeros(g.n)
    sigma[s], front, steps = 1.0, np.array([s]), []
    while len(front):
        first, count = start[front], start[front + 1] - start[front]
        edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        if not len(edge):
            break
        a, b = src[edge], to[edge]
        sigma += np.bincount(b, sigma[a], g.n)
        waits -= np.bincount(b, minlength=g.n)
        steps.append((a, b))
        front = np.unique(b)
        front = front[waits[front] == 0]
    return dist, sigma, steps


def distances(g: Csr, weighted: bool, s: int, most: float = np.inf, stop: int | None = None) -> np.ndarray:
    """From s; inf where unreached, and beyond ``most`` or the distance of ``stop``."""
    if weighted:
        return nearest(g, s, most, stop)
    d = levels(g, s, most, stop)[0].astype(float)
    return np.where(d < 0, np.inf, d)


def dependencies(g: Csr, weighted: bool, s: int) -> np.ndarray:
    """What the source adds to each node's betweenness."""
    delta = np.zeros(g.n)
    _, sigma, steps = (tight_levels if weighted else levels)(g, s)
    for src, to in reversed(steps):
        delta += np.bincount(src, sigma[src] / sigma[to] * (1 + delta[to]), g.n)
    delta[s] = 0
    return delta


# ---- blocks of sources ----

#: Graphs whose weights are whole numbers, this many different ones at most, are searched from many sources at once.
MOST_WEIGHTS = 64
#: Bytes of an array (nodes x sources) of a block; edges that a step over a block takes at a time.
BLOCK_BYTES, EDGES_AT_ONCE = 1 << 26, 1 << 13
#: Edges whose ends are laid out at a time, where most of a graph's are.
STRETCH = 1 << 20


class Sweeps:
    """The edges of a graph by weight, in the order of their targets and of their sources, for searches from a block of sources."""

    def __init__(self, g: Csr, weighted: bool):
        self.n, src = g.n, g.src.astype(np.int32)
        weight = g.weight if weighted else np.ones(len(g.dst))
        self.classes, self.outward, self.inward = [], [], []
        for w in np.unique(weight).tolist():
            at = np.flatnonzero(weight == w)
            a, b = src[at], g.dst[at].astype(np.int32)
            order = np.argsort(b, kind="stable")
            self.classes.append((w, a[order], b))  # where from, by target; where to, by source
            self.outward.append(np.searchsorted(a, np.arange(g.n + 1)))
            self.inward.append(np.searchsorted(b[order], np.arange(g.n + 1)))

    @classmethod
    def of(cls, n: int, classes: list[tuple]) -> Sweeps:
        """From (weight, edges' sources by target, edges' targets by source, edges out of each node, edges into each node)."""
        new = object.__new__(cls)
        new.n = n
        new.classes = [(w, near, to) for w, near, to, _, _ in classes]
        new.outward, new.inward = ([np.append(0, np.cumsum(c[k], dtype=np.int64)) for c in classes] for k in (3, 4))
        return new

    @staticmethod
    def fit(g: Csr, weighted: bool) -> bool:
        """Distances of whole numbers are exact and few, so that a step serves all sources that reach one."""
        if not weighted:
            return True
        kinds = np.unique(g.weight)
        return len(kinds) <= MOST_WEIGHTS and bool(np.all(kinds == np.floor(kinds))) and float(np.abs(kinds).sum()) * max(g.n, 1) < 2**53

    def width(self, most: int) -> int:
        """Values of a row of a block."""
        return max(1, min(most, BLOCK_BYTES // (8 * max(self.n, 1))))

    def onward(self, k: int, rows: np.ndarray):
        """Yields the edges of class ``k`` that leave ``rows``, as (from, to), ordered by ``to``, a stretch of all edges at a time."""
        near, to, start, into = *self.classes[k][1:], self.outward[k], self.inward[k]
        if (start[rows + 1] - start[rows]).sum() * 8 < len(near):
            a, b = _edges(start, rows, to)
            order = np.argsort(b, kind="stable")
            yield a[order], b[order]
            return
        there = None
        if len(rows) < self.n:
            there = np.zeros(self.n, bool)
            there[rows] = True
        for lo in range(0, len(near), STRETCH):
            hi = min(lo + STRETCH, len(near))
            first, last = np.searchsorted(into, lo, side="right") - 1, np.searchsorted(into, hi)
            a, b = near[lo:hi], np.repeat(np.arange(first, last, dtype=np.int32), np.diff(np.clip(into[first : last + 1], lo, hi)))
            if there is not None:
                at = np.flatnonzero(there[a])
                a, b = a[at], b[at]
            yield a, b


def _gathered(add: np.ufunc, values: np.ndarray, near: np.ndarray, far: np.ndarray, into: np.ndarray) -> None:
    """into[far] = add(into[far], values[near]), a stretch of edges at a time; ``far`` is sorted."""
    for i in range(0, len(near), EDGES_AT_ONCE):
        a, b = near[i : i + EDGES_AT_ONCE], far[i : i + EDGES_AT_ONCE]
        begin = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        to = b[begin]
        into[to] = add(into[to], add.reduceat(values[a], begin, axis=0))


def reached(g: Sweeps, sources: np.ndarray, most: float = np.inf, stop: int | None = None):
    """Yields (distance, nodes, bits) in the order of distances: which sources, a bit each, reach these nodes at that distance.

    A distance may come twice where weights are 0. Nothing beyond ``most`` comes, nor what is farther from a source than ``stop``.
    """
    words = -(-len(sources) // 64)
    first = np.zeros((g.n, words), np.uint64)
    at = np.arange(len(sources))
    np.bitwise_or.at(first, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    seen, wait, alive, last = np.zeros_like(first), {0.0: first}, np.full(words, ~np.uint64(0)), None
    ended = np.zeros(words, np.uint64)
    while wait and (d := min(wait)) <= most:
        if d != last:
            alive, last = alive & ~ended, d
        new = wait.pop(d) & ~seen & alive
        rows = np.flatnonzero(new.any(1))
        if not len(rows):
            continue
        seen |= new
        yield d, rows, new[rows]
        if stop is not None:
            ended = ended | new[stop]
        for k, (w, *_) in enumerate(g.classes):
            if d + w > most:
                continue
            for near, far in g.onward(k, rows):
                if len(near):
                    _gathered(np.bitwise_or, new, near, far, wait.setdefault(d + w, np.zeros_like(first)))


def pairs_of(sources: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (source, node) that the bits of :func:`reached` stand for."""
    row, bit = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, count=len(sources), bitorder="little"))
    return sources[bit], nodes[row]


def paths_from(g: Sweeps, s: int, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """Distances (inf: unreached), numbers of shortest paths, and the edges on them by the distance they lead to (from, to).

    Weights are positive; no path enters a node of ``closed``. What is reached at a distance is found from the nodes before it or from
    those that are still open, whichever have fewer edges: most edges of a dense graph lie between nodes of one distance and are not read.
    """
    dist, sigma, left = np.full(g.n, np.inf), np.zeros(g.n), np.ones(g.n, bool) if closed is None else ~closed
    dist[s], sigma[s], left[s] = 0.0, 1.0, False
    fronts, steps = {0.0: np.array([s])}, []
    wait = {w for w, *_ in g.classes}
    while wait:
        wait.remove(d := min(wait))
        found, rest = [], None
        for k, (w, *_) in enumerate(g.classes):
            if (front := fronts.get(d - w)) is None:
                continue
            rest = np.flatnonzero(left) if rest is None else rest
            out, into = g.outward[k], g.inward[k]
            if (out[front + 1] - out[front]).sum() <= (into[rest + 1] - into[rest]).sum():
                for a, b in _edge_lots(out, front, g.classes[k][2]):
                    keep = left[b]
                    found.append((a[keep], b[keep]))
            else:
                for b, a in _edge_lots(into, rest, g.classes[k][1]):
                    keep = dist[a] == d - w
                    found.append((a[keep], b[keep]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        if not len(a):
            continue
        sigma += np.bincount(b, sigma[a], g.n)
        new = np.zeros(g.n, bool)
        new[b] = True
        left[new], dist[new] = False, d
        fronts[d] = np.flatnonzero(new)
        steps.append((a, b))
        wait |= {d + w for w, *_ in g.classes}
    return dist, sigma, steps


def _edges(start: np.ndarray, nodes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the nodes, as (node, other end)."""
    first, count = start[nodes], start[nodes + 1] - start[nodes]
    edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return np.repeat(nodes, count), ends[edge].astype(np.int64)


def _edge_lots(start: np.ndarray, nodes: np.ndarray, ends: np.ndarray):
    """:func:`_edges`, those of some nodes at a time, about STRETCH."""
    total = np.cumsum(start[nodes + 1] - start[nodes])
    cuts = np.searchsorted(total, np.arange(STRETCH, total[-1] if len(total) else 0, STRETCH))
    for part in np.split(nodes, cuts) if len(cuts) else [nodes]:
        yield _edges(start, part, ends)


def dependencies_from(g: Sweeps, s: int) -> np.ndarray:
    """:func:`dependencies`, by :func:`paths_from`."""
    delta = np.zeros(g.n)
    _, sigma, steps = paths_from(g, s)
    for a, b in reversed(steps):
        delta += np.bincount(a, sigma[a] * ((1 + delta[b]) / sigma[b]), g.n)
    delta[s] = 0
    return delta


def settled(g: Csr | Sweeps, weighted: bool, sources: np.ndarray, most: float = np.inf, stop: int | None = None):
    """Yields (sources, targets, distances) of all pairs reached, some million at a time."""
    if isinstance(g, Csr):
        for s in sources.tolist():
            d = distances(g, weighted, s, most, stop)
            at = np.flatnonzero(np.isfinite(d))
            yield np.full(len(at), s), at, d[at]
        return
    for i in range(0, len(sources), block := 64 * g.width(4)):
        part = sources[i : i + block]
        for d, nodes, bits in reached(g, part, most, stop):
            for j in range(0, len(nodes), step := max(1, (1 << 20) // len(part))):
                s, t = pairs_of(part, nodes[j : j + step], bits[j : j + step])
                yield s, t, np.full(len(s), d)


def reach_totals(g: Csr | Sweeps, weighted: bool, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From how many of the sources each node is reached, and the sum of their distances to it."""
    r, total = np.zeros(g.n), np.zeros(g.n)
    if isinstance(g, Csr):
        for s in sources.tolist():
            d = distances(g, weighted, s)
            there = np.isfinite(d)
            r += there
            total[there] += d[there]
        return r, total
    for i in range(0, len(sources), block := 64 * g.width(16)):
        for d, nodes, bits in reached(g, sources[i : i + block]):
            n = np.bitwise_count(bits).sum(1)
            r[nodes] += n
            total[nodes] += d * n
    return r, total


def path_steps(g: Csr | Sweeps, weighted: bool, s: int, closed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """:func:`paths_from` for either form of a graph; of a Csr the edges at ``closed`` have to be gone."""
    if isinstance(g, Sweeps):
        return paths_from(g, s, closed)
    d, sigma, steps = (tight_levels if weighted else levels)(g, s)
    return np.where(d < 0, np.inf, d.astype(float)), sigma, steps


#: Paths that are spelt out at a time, where one target has no more.
PATHS_AT_ONCE = 1 << 16


def spelt_paths(s: int, steps: list, sigma: np.ndarray, wanted: np.ndarray, rank: np.ndarray):
    """Yields (targets, numbers of their paths, lengths of the paths, their nodes): the shortest paths from ``s`` to the nodes of ``wanted``.

    ``steps`` are the edges on shortest paths as searches return them, ``sigma`` the numbers of paths. A target's paths come together
    and in the order of ``rank``. Some targets go at a time, of PATHS_AT_ONCE paths or one; a begun path always has an end among them.
    """

    def leading(steps: list, ends: np.ndarray) -> list:
        needed, kept = ends.copy(), []
        for a, b in reversed(steps):
            at = np.flatnonzero(needed[b])
            needed[a[at]] = True
            kept.append((a[at], b[at]))
        return kept[::-1]

    steps, targets = leading(steps, wanted), np.flatnonzero(wanted)
    lot = np.cumsum(sigma[targets]) // PATHS_AT_ONCE
    for part in np.split(targets, np.flatnonzero(np.diff(lot)) + 1):
        ends = np.zeros(len(wanted), bool)
        ends[part] = True
        a, b = (np.concatenate(z) for z in zip(*leading(steps, ends), strict=True))
        order = np.lexsort((rank[b], a))
        a, b, rows, found = a[order], b[order], np.array([[s]], np.int32), []
        while len(rows):
            first = np.searchsorted(a, rows[:, -1])
            count = np.searchsorted(a, rows[:, -1], side="right") - first
            edge = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
            rows = np.concatenate([np.repeat(rows, count, axis=0), b[edge, None].astype(np.int32)], axis=1)
            if (hit := ends[rows[:, -1]]).any():
                found.append(rows[hit])
        lengths = np.concatenate([np.full(len(x), x.shape[1]) for x in found])
        most = int(lengths.max())
        rows = np.concatenate([np.pad(x, ((0, 0), (0, most - x.shape[1])), constant_values=-1) for x in found])
        to = np.concatenate([x[:, -1] for x in found])
        if len(found) == 1:  # of one length: in order already, but for the targets
            order = np.argsort(to, kind="stable")
        else:
            ranks = np.where(rows < 0, -1, rank[rows])
            order = np.lexsort((*(ranks[:, k] for k in reversed(range(most))), to))
        rows, lengths, to = rows[order], lengths[order], to[order]
        yield *np.unique(to, return_counts=True), lengths, rows[rows >= 0]


def louvain(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float) -> np.ndarray:
    """Labels by moving nodes, in index order, to the neighbour community of greatest gain, then merging."""
    label = np.arange(n)
    edges: dict[tuple[int, int], float] = {}
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
        edges[a, b] = edges.get((a, b), 0.0) + x
        if a != b:
            edges[b, a] = edges.get((b, a), 0.0) + x
    size = n
    while True:
        near: list[dict[int, float]] = [{} for _ in range(size)]
        degree = [0.0] * size
        for (a, b), x in edges.items():
            degree[a] += x if a != b else 2 * x
            if a != b:
                near[a][b] = x
        m = sum(degree)
        if m == 0:
            break
        com, total, moved_any, moved = list(range(size)), list(degree), False, True
        while moved:
            moved = False
            for i in range(size):
                ties: dict[int, float] = {}
                for j, x in near[i].items():
                    c = com[j]
                    ties[c] = ties.get(c, 0.0) + x
                own, k = com[i], degree[i]
                total[own] -= k
                cost = resolution * k / m
                best, top = own, ties.get(own, 0.0) - cost * total[own]
                for c in sorted(ties):
                    gain = ties[c] - cost * total[c]
                    if gain > top + GAIN:
                        best, top = c, gain
                total[best] += k
                if best != own:
                    com[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        com = np.array([names[c] for c in com])
        label = com[label]
        merged: dict[tuple[int, int], float] = {}
        for (a, b), x in edges.items():
            ca, cb = int(com[a]), int(com[b])
            # both directions of an inner edge are listed, so each counts half of a loop
            merged[ca, cb] = merged.get((ca, cb), 0.0) + (x if ca != cb or a == b else x / 2)
        edges, size = merged, len(names)
    return label


def leiden(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, quality: str, resolution: float, theta: float, gamma: float, seed: int) -> np.ndarray:
    """Labels by fast local moves, randomised refinement inside communities, and aggregation, until stable."""
    rng = np.random.default_rng(seed)
    flat = np.arange(n)
    weight_of = np.ones(n)
    a, b, x = u.astype(int), v.astype(int), w.astype(float)
    start = None
    for _ in range(100):
        k = len(weight_of)
        near: list[dict[int, float]] = [{} for _ in range(k)]
        degree = np.zeros(k)
        for i, j, y in zip(a.tolist(), b.tolist(), x.tolist(), strict=True):
            degree[i] += y
            degree[j] += y
            if i != j:
                near[i][j] = near[i].get(j, 0.0) + y
                near[j][i] = near[j].get(i, 0.0) + y
        m = degree.sum() / 2
        if m == 0:
            break
        mass = degree if quality == "modularity" else weight_of
        cost = resolution / (2 * m) if quality == "modularity" else resolution
        com = list(range(k)) if start is None else list(start)
        total = np.zeros(2 * k + 1)
        np.add.at(total, com, mass)
        queue, queued = list(rng.permutation(k)), [True] * k
        free = [c for c in range(2 * k) if total[c] == 0]
        while queue:
            i = int(queue.pop(0))
            queued[i] = False
            ties: dict[int, float] = {}
            for j, y in near[i].items():
                ties[com[j]] = ties.get(com[j], 0.0) + y
            own = com[i]
            total[own] -= mass[i]
            gain = lambda c: ties.get(c, 0.0) - cost * mass[i] * total[c]  # noqa: B023, E731
            best, top = own, gain(own)
            for c in [*sorted(ties), *([free[-1]] if free and total[own] > 0 else [])]:
                if gain(c) > top + 1e-12:
                    best, top = c, gain(c)
            if best != own:
                if total[own] == 0:
                    free.append(own)
                if free and best == free[-1]:
                    free.pop()
                for j in near[i]:
                    if com[j] != best and not queued[j]:
                        queue.append(j)
                        queued[j] = True
            com[i] = best
            total[best] += mass[i]
        if len(set(com)) == k:
            flat = np.unique(np.array(com), return_inverse=True)[1][flat]
            break
        # refinement: singletons of a community merge, at random by gain, with well-connected parts of it
        fine, fine_mass = list(range(k)), mass.astype(float).copy()
        com_mass = np.zeros(2 * k + 1)
        np.add.at(com_mass, com, mass)
        alone = [True] * k
        for i in map(int, rng.permutation(k)):
            inside = sum(y for j, y in near[i].items() if com[j] == com[i])
            if not alone[i] or inside < gamma * cost * mass[i] * (com_mass[com[i]] - mass[i]):
                continue
            ties = {}
            for j, y in near[i].items():
                if com[j] == com[i]:
                    ties[fine[j]] = ties.get(fine[j], 0.0) + y
            ties.pop(fine[i], None)
            gains = {c: y - cost * mass[i] * fine_mass[c] for c, y in ties.items()}
            good = {c: y for c, y in gains.items() if y >= 0}
            if good:
                keys = sorted(good)
                z = np.array([good[c] for c in keys]) / max(theta, 1e-9)
                p = np.exp(z - z.max())
                c = keys[rng.choice(len(keys), p=p / p.sum())]
                fine_mass[c] += mass[i]
                fine_mass[fine[i]] -= mass[i]
                alone[c] = False
                fine[i] = c
        names, part = np.unique(np.array(fine), return_inverse=True)
        start = [0] * len(names)
        seen = {c: t for t, c in enumerate(dict.fromkeys(com))}
        for i in range(k):
            start[part[i]] = seen[com[i]]
        flat = part[flat]
        weight_of = np.bincount(part, weight_of, len(names))
        a, b = part[a], part[b]
        if len(names) == k:
            flat = np.array(start)[flat]
            break
    else:
        flat = np.array(start)[flat]
    return flat


# ---- communities over pieces of edges: (nodes, where their edges start, the other ends, weights) ----

#: Groups of a piece's nodes that move one after the other; a move must gain more than this share of what is compared.
GROUPS, NOISE = 16, 1e-12


def moves(piece: tuple, c: np.ndarray, masses: np.ndarray, mass: np.ndarray, cost: float, waits: np.ndarray, moved: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes looked at, communities of greatest gain, weights to the own community as it is in ``c``).

    Looked at are nodes that wait or moved, or have a neighbour that moved. Those whose turn it is move at once in a copy of ``c``.
    """
    at, start, near, w = piece
    count, n = np.diff(np.append(start, len(near))), len(c)
    rows = np.flatnonzero(waits[at] | moved[at] | np.logical_or.reduceat(moved[near], start)) if len(at) else np.zeros(0, int)
    now, masses, to, inner = c.copy(), masses.copy(), c[at[rows]], np.zeros(len(rows))
    for part in np.array_split(np.arange(len(rows)), min(GROUPS, max(1, len(rows)))):
        if not len(part):
            continue
        k, nodes = count[rows[part]], at[rows[part]]
        p = np.repeat(np.arange(len(part)), k)
        edge = np.arange(k.sum()) + np.repeat(start[rows[part]] - np.cumsum(k) + k, k)
        ends, x = near[edge], w[edge]
        inner[part] = np.bincount(p, np.where(c[ends] == c[nodes][p], x, 0.0), len(part))
        key = p * n + now[ends]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ties, p, com = np.add.reduceat(x[order], first), key[first] // n, key[first] % n
        own, m = now[nodes], mass[nodes]
        stays = com == own[p]
        gain = ties - cost * m[p] * (masses[com] - np.where(stays, m[p], 0.0))
        stay = -cost * m * (masses[own] - m)  # of a node that has no neighbour in its community
        stay[p[stays]] = gain[stays]
        begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        top = np.maximum.reduceat(gain, begin)
        hit = np.flatnonzero(gain == top[p])
        hit = hit[np.append(True, p[hit][1:] != p[hit][:-1])]  # of equal ones the least community
        goes = top > stay + NOISE * np.maximum(1.0, np.abs(top))
        to[part] = np.where(goes, com[hit], own)
        go = goes & turn[nodes]
        np.subtract.at(masses, own[go], m[go])
        np.add.at(masses, com[hit][go], m[go])
        now[nodes[go]] = com[hit][go]
    return at[rows], to, inner


def least_inside(piece: tuple, c: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least label of their neighbours in their community, and of themselves)."""
    at, start, near, _ = piece
    own = np.repeat(at, np.diff(np.append(start, len(near))))
    return at, np.minimum(label[at], np.minimum.reduceat(np.where(c[near] == c[own], label[near], label[own]), start))


def merged_edges(piece: tuple, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges between different parts, sorted, the weights of a pair summed."""
    at, start, near, w = piece
    a, b = part[np.repeat(at, np.diff(np.append(start, len(near))))], part[near]
    keep = a != b
    key, w = a[keep].astype(np.int64) << 32 | b[keep], w[keep]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    sums = np.add.reduceat(w[order], first) if len(key) else np.zeros(0)
    return (key[first] >> 32).astype(np.int32), (key[first] & 0xFFFFFFFF).astype(np.int32), sums


def equal_partitions(n: int, neighbours: list[list[int]], k: int) -> np.ndarray:
    """Greedy breadth-first fill: parts of n // k + 1 nodes, each begun at the lowest unvisited index."""
    label, most, part, used, low = np.full(n, -1), n // k + 1, 0, 0, 0
    queue: list[int] = []
    while True:
        while low < n and label[low] >= 0:
            low += 1
        if not queue:
            if low >= n:
                return label
            queue = [low]
        i = queue.pop(0)
        if label[i] >= 0:
            continue
        if used == most:
            part, used, queue = part + 1, 0, []
            while low < n and label[low] >= 0:
                low += 1
            i = low
        label[i] = part
        used += 1
        queue += [j for j in neighbours[i] if label[j] < 0]


def krylov_gap(times, n: int, room: int, width: int = 4, tolerance: float = 1e-8, max_iter: int = 3_000) -> float:
    """Difference of the two greatest eigenvalues of a symmetric n * n matrix; ``times(x)`` are its products with the columns of x.

    Block Lanczos with full orthogonalisation. A basis that has filled its ``room`` (bytes) starts anew from its best vectors. A block
    of several vectors finds a greatest eigenvalue that stands more than once. It ends when the residuals bound the errors of both.
    """
    rng = np.random.default_rng(0)
    most = min(n, max(6 * width, min(60 * width, room // (8 * n))))
    v, t, k = np.zeros((n, most), order="F"), np.zeros((most, most)), 0
    new = np.linalg.qr(rng.standard_normal((n, min(width, n))))[0]
    for _ in range(max_iter):
        end = k + new.shape[1]
        v[:, k:end] = new
        y = times(new)
        t[:end, k:end] = v[:, :end].T @ y
        t[k:end, :end] = t[:end, k:end].T
        y = _without(v[:, :end], y)
        values, s = np.linalg.eigh(t[:end, :end])
        new, left = np.linalg.qr(y)
        if end == n:  # the basis is the whole space
            return float(values[-1] - values[-2])
        if end > 2:
            off = np.linalg.norm(left @ s[k:end], axis=0)  # residuals, which bound errors; squared, over the distance from the values outside a cluster
            error = 0.0
            for i in (end - 1, end - 2):
                alike = np.abs(values - values[i]) <= 4 * off[i]
                apart = np.abs(values - values[i])[~alike].min(initial=np.inf)
                error += min(off[i], off[alike].max() ** 2 / apart if np.isfinite(apart) else np.inf)
            if error <= tolerance * max(1.0, abs(values[-1])):
                return float(values[-1] - values[-2])
        dead = np.abs(np.diag(left)) <= 1e-12 * max(1.0, np.abs(values).max())  # nothing new in this direction: a random one takes its place
        new[:, dead] = rng.standard_normal((n, int(dead.sum())))
        new = np.linalg.qr(_without(v[:, :end], new))[0][:, : n - end]
        k = end
        if k + new.shape[1] > most:
            keep = most // 2
            v[:, :keep] = v[:, :k] @ s[:, -keep:]
            t[:], k = 0.0, keep
            t[range(keep), range(keep)] = values[-keep:]
    raise GraphError("PowerIterationFailedConvergence", f"not within {max_iter} iterations")


def _without(v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` less its parts along the orthonormal columns of ``v``; twice, for the sake of rounding."""
    for _ in range(2):
        y = y - v @ (v.T @ y)
    return y


def paths_down(mid: int, near: np.ndarray, tops: np.ndarray, parts: np.ndarray):
    """Paths from each of ``tops`` over ``mid`` to those of ``near`` (sorted) below the top: (tops, parts, numbers of ends, ends).

    Where a top has several parts, the ends are dealt to them by number, and the one of ``mid`` is there even without ends.
    """
    plain = parts == 1
    some = tops[plain]
    if len(some):
        count = np.searchsorted(near, some)
        start = np.cumsum(count) - count
        yield some, np.zeros(len(some), np.int32), count, near[np.arange(count.sum()) - np.repeat(start, count)]
    for top, k in zip(tops[~plain].tolist(), parts[~plain].tolist(), strict=True):
        lows = near[: np.searchsorted(near, top)]
        lows = lows[np.argsort(lows % k, kind="stable")]
        count = np.bincount(lows % k, minlength=k)
        used = np.flatnonzero((count > 0) | (np.arange(k) == mid % k)).astype(np.int32)
        yield np.full(len(used), top, np.int32), used, count[used], lows


class Squares:
    """Twice the squares (q) and twice the triangles (t) at each of n nodes."""

    def __init__(self, n: int):
        self.q, self.t = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self._met, self._tied = np.zeros(n, np.int32), np.zeros(n, bool)

    def add(self, top: int, mids: np.ndarray, counts: np.ndarray, lows: np.ndarray) -> None:
        """The paths from ``top``, its highest corner; two that end in one node are a square, one that ends in a neighbour is a triangle, met from both sides."""
        at = np.append(0, np.cumsum(counts))
        np.add.at(self._met, lows, 1)
        self._tied[mids] = True
        others, closed = self._met[lows] - np.int64(1), self._tied[lows]
        for into, each in ((self.q, others), (self.t, closed)):
            total = np.append(0, np.cumsum(each))
            np.add.at(into, mids, 2 * (total[at[1:]] - total[at[:-1]]))
            into[top] += total[-1]
        np.add.at(self.q, lows, others)
        self._met[lows] = 0
        self._tied[mids] = False
