"""Boundaries, cuts, triangles and clustering, structural holes, modularity: one relational plan each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.errors import GraphError
from meshwork.functions import kernels
from meshwork.operators.graph import Graph, dense_index
from meshwork.plans.durable import checkpointed
from meshwork.plans.skew import lookup
from meshwork.plans.workers import trimmed


def edge_boundary(g: Graph, first, second=None) -> DataFrame:
    """Edges from ``first`` to ``second`` (default: all other nodes); in undirected graphs either way."""
    g.ensure_nodes([*first, *(second or [])])
    in_first = lambda c: F.col(c).isin(*first)
    in_second = (lambda c: F.col(c).isin(*second)) if second is not None else (lambda c: ~F.col(c).isin(*first))
    ahead = in_first("u") & in_second("v")
    return g.edges.where(ahead if g.specs.directed else ahead | (in_second("u") & in_first("v")))


def cut_edges(g: Graph, first, second) -> DataFrame:
    """The edges between the two sets, in directed graphs of both directions."""
    cut = edge_boundary(g, first, second)
    return cut.unionByName(edge_boundary(g, second, first)) if g.specs.directed else cut


def cut_size(g: Graph, first, second, weighted: bool = False) -> float:
    """0 where no edge is cut."""
    return float(cut_edges(g, first, second).agg(F.sum("weight") if weighted else F.count(F.lit(1))).first()[0] or 0.0)


def _strengths(g: Graph, weighted: bool) -> DataFrame:
    """(a, b, s), both ways and without loops: A + A' for directed graphs, A for undirected; weighted by cbrt(w / max w)."""
    g.ensure_not_multi_edges()
    e = g.edges.where("u <> v")
    if weighted:
        g.ensure_weighted()
        top = g.edges.agg(F.max("weight")).first()[0] or 1.0
        e = e.withColumn("s", F.cbrt(F.col("weight") / top))
    else:
        e = e.withColumn("s", F.lit(1.0))
    two = e.select(F.col("u").alias("a"), F.col("v").alias("b"), "s").unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b"), "s"))
    return two.groupBy("a", "b").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")) if g.specs.directed else two.withColumn("k", F.lit(1).cast("long"))


def triangle_rows(s: DataFrame) -> DataFrame:
    """(x, y, z, p): each triangle once, p the product of its strengths.

    Edges point from the end of lower (degree, name) to the higher, so a hub's wedges are few. A node sends the list of its upper
    neighbours down its edges, and the lower end looks up which are its own too: no wedge is a row, and a name in a list takes a
    fraction of one.
    """
    degree = s.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    e = s.where("a < b").join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")))
    e = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "s")
    ups = e.groupBy("x").agg(F.collect_list(F.struct("y", "s")).alias("l")).select("x", F.col("l.y").alias("above"), F.col("l.s").alias("s2"))
    sent = e.select("x", "y", F.col("s").alias("s1")).join(ups.select(F.col("x").alias("y"), F.col("above").alias("far"), F.col("s2").alias("s3")).hint("shuffle_hash"), "y")
    both = sent.join(ups.hint("shuffle_hash"), "x").withColumn("z", F.explode(F.array_intersect("far", "above")))
    strength = lambda values, names: F.element_at(values, F.array_position(names, F.col("z")).cast("int"))
    return both.select("x", "y", "z", (F.col("s1") * strength("s2", "above") * strength("s3", "far")).alias("p"))


def _around(g: Graph, weighted: bool) -> DataFrame:
    """(name, t, d, r): twice the triangle strength at a node, total degree and reciprocal pairs, loops left out."""
    s = _strengths(g, weighted)
    t = triangle_rows(s)
    corners = t.select(F.explode(F.array("x", "y", "z")).alias("name"), "p").groupBy("name").agg((2 * F.sum("p")).alias("t"))
    degree = s.groupBy(F.col("a").alias("name")).agg(F.sum("k").alias("d"), F.count_if(F.col("k") == 2).alias("r"))
    rows = g.nodes.select("name").join(degree, "name", "left").join(corners, "name", "left")
    return rows.select("name", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("r", F.lit(0)).alias("r"))


def _only(rows: DataFrame, names) -> DataFrame:
    return rows if not names else rows.where(F.col("name").isin(*names))


def clustering(g: Graph, weighted: bool = False, names=None) -> DataFrame:
    """Computed on the whole graph; ``names`` selects rows of the result."""
    a = _around(g, weighted)
    possible = F.col("d") * (F.col("d") - 1)
    possible = 2 * (possible - 2 * F.col("r")) if g.specs.directed else possible
    return _only(a.select("name", F.when(F.col("t") == 0, 0.0).otherwise(F.try_divide("t", possible.cast("double"))).alias("value")), names)


def average_clustering(g: Graph, weighted: bool = False, names=None, count_zeros: bool = True) -> float:
    c = clustering(g, weighted, names)
    value = (c if count_zeros else c.where("value <> 0")).agg(F.avg("value")).first()[0]
    return float("nan") if value is None else value


def triangles(g: Graph, names=None) -> DataFrame:
    g.ensure_undirected()
    return _only(_around(g, False).select("name", F.round(F.col("t") / 2).cast("long").alias("value")), names)


def transitivity(g: Graph) -> float:
    g.ensure_undirected()
    t, p = _around(g, False).agg(F.sum("t"), F.sum(F.col("d") * (F.col("d") - 1))).first()
    return 0.0 if not t else t / p


def generalized_degree(g: Graph, names=None) -> DataFrame:
    """(name, multiplicity, cnt): how many of a node's edges lie in so many triangles."""
    g.ensure_undirected()
    s = _strengths(g, False)
    t = triangle_rows(s)
    sides = t.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")), F.struct(F.col("y").alias("a"), F.col("z").alias("b")))).alias("e"))
    per = sides.groupBy(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    e = s.where("a < b").select("a", "b").join(per, ["a", "b"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    rows = e.select(F.explode(F.array("a", "b")).alias("name"), F.col("m").alias("multiplicity")).groupBy("name", "multiplicity").agg(F.count(F.lit(1)).alias("cnt"))
    return _only(rows, names)


def _ranked(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, ...), both ways, with the ranks ra and rb of their ends: (degree, name). A hub's rows don't meet its degree in one task."""
    total = pairs.count()
    degree = pairs.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    for end, other in (("a", "b"), ("b", "a")):
        pairs = lookup(pairs, end, F.col(other), degree, "n", "d", total).withColumn(f"r{end}", F.struct(F.col("d"), F.col(end).alias("n"))).drop("d")
    return checkpointed(pairs)


def square_clustering(g: Graph, names=None) -> DataFrame:
    """Over pairs u < w of a node's (out-)neighbours; counted with signs, so no count can wrap.

    In undirected graphs a node's sums follow from its squares, its triangles and its neighbours' degrees. A square is found from
    its corner of highest (degree, name): of the paths of two steps down from there that end in one node, any two are a square.
    So no two neighbours of a hub are paired, unless they are of higher rank. Paths travel as lists of their ends.
    """
    if g.specs.directed:
        return _only(_square_pairs(g), names)
    rank, pairs = _by_rank(g)
    sums = _squares(pairs, rank.count()).groupBy("r").agg(F.sum("q").alias("q"), F.sum("t").alias("t"))
    around = pairs.groupBy(F.col("a").alias("r")).agg(F.count(F.lit(1)).alias("k"), F.sum("db").alias("ends"))
    found = rank.join(around, "r").join(sums, "r", "left").select("name", "k", "ends", F.expr("coalesce(q, 0) div 2").alias("q"), F.coalesce("t", F.lit(0)).alias("t2"))
    possible = F.col("possible")
    rows = found.select("name", "q", ((F.col("k") - 1) * F.col("ends") - F.col("q") - F.col("k") * (F.col("k") - 1) - F.col("t2")).alias("possible"))
    return _only(g.nodes.select("name").join(rows, "name", "left").select("name", F.when(possible > 0, F.col("q") / possible).otherwise(0.0).alias("value")), names)


def _by_rank(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(name, r): nodes with neighbours numbered by (degree, name); and the ties both ways by number (a, b, da, db), with both degrees."""
    pairs = g.adj.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    total = pairs.count()
    degree = pairs.groupBy(F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("d"))
    rank = checkpointed(dense_index(degree, ["d", "name"], "r").select("name", F.col("r").cast("int").alias("r"), "d"))
    for end, other in (("a", "b"), ("b", "a")):
        table = rank.select(F.col("name").alias("n"), F.col("r").alias(f"r{end}"), F.col("d").alias(f"d{end}"))
        pairs = lookup(pairs, end, F.col(other), table, "n", f"d{end}", total)
    return rank.select("name", "r"), checkpointed(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "da", "db"))


#: Neighbours in a list at most, and paths from a node that one group of :func:`_squares` holds (4 bytes each, and more while it counts).
LIST_NODES, GROUP_PATHS = 100_000, 10_000_000
#: Paths of a task, which are sorted by their tops in memory.
TASK_PATHS = 50_000_000


def _path_lists(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(top, part, mid, lows): the paths down from each node, one list for each of its lower neighbours; and how many there are at most.

    A node of many paths has several parts, to which the ends are dealt, as is the neighbour itself, whose row is there even if empty.
    """
    down = pairs.where("a > b").groupBy(F.col("a").alias("top")).agg(F.sum("db").alias("n"))
    most = down.agg(F.sum("n")).first()[0] or 0
    hubs = checkpointed(down.where(F.col("n") > GROUP_PATHS).select("top", F.expr(f"cast(1 + (n - 1) div {GROUP_PATHS} as int)").alias("parts")))  # at most ``most`` / GROUP_PATHS rows
    up = pairs.where("a < b").join(F.broadcast(hubs), F.col("b") == F.col("top"), "left")
    ups = up.groupBy(F.col("a").alias("mid")).agg(F.collect_list(F.struct("b", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("u")).select("mid", F.col("u.b").alias("tops"), F.col("u.parts").alias("parts"))
    piece = F.pmod(F.xxhash64("b"), F.expr(f"1 + (da - 1) div {LIST_NODES}"))
    lists = pairs.groupBy(F.col("a").alias("mid"), piece.alias("piece")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    rows = lists.join(ups.hint("shuffle_hash"), "mid").select("mid", "near", "tops", "parts")

    def fan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for i, mid in enumerate(b.column("mid").to_numpy()):
                near, tops, parts = (b.column(c)[i].values.to_numpy() for c in ("near", "tops", "parts"))
                for top, part, counts, lows in kernels.paths_down(mid, near, tops, parts):
                    held.append((top, part, np.full(len(top), mid, np.int32), counts, lows))
                    size += len(lows) + len(top)
                    if size >= 1 << 20:
                        yield lists_of(held)
                        held, size = [], 0
            if held:
                yield lists_of(held)

    def lists_of(held: list) -> pa.RecordBatch:
        top, part, mid, counts, lows = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(lows))
        return pa.RecordBatch.from_arrays([pa.array(top), pa.array(part), pa.array(mid), ends], ["top", "part", "mid", "lows"])

    return rows.mapInArrow(fan, "top int, part int, mid int, lows array<int>"), most


def _squares(pairs: DataFrame, n: int) -> DataFrame:
    """(r, q, t): twice the squares and the triangles at each node, in partial sums of the tasks, each of which holds 21 bytes a node."""
    lists, most = _path_lists(pairs)
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // TASK_PATHS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = kernels.Squares(n), []
        key = None
        for b in batches:
            if not len(b):
                continue
            top, part, mid = (b.column(c).to_numpy() for c in ("top", "part", "mid"))
            lists = b.column("lows")
            counts, lows = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            cut = np.flatnonzero((np.diff(top) != 0) | (np.diff(part) != 0)) + 1
            first, at = np.append(0, cut), np.append(0, np.cumsum(counts))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(top)], strict=True):
                if held and key != (top[lo], part[lo]):
                    sums.add(key[0], *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                key = (top[lo], part[lo])
                held.append((mid[lo:hi], counts[lo:hi], lows[at[lo] : at[hi]]))
        if held:
            sums.add(key[0], *(np.concatenate(x) for x in zip(*held, strict=True)))
        for lo in range(0, n, 1 << 20):
            some = lo + np.flatnonzero(sums.q[lo : lo + (1 << 20)] | sums.t[lo : lo + (1 << 20)])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums.q[some]), pa.array(sums.t[some])], ["r", "q", "t"])

    return lists.repartition(parts, "top", "part").sortWithinPartitions("top", "part").mapInArrow(trimmed(count), "r int, q long, t long")


def _square_pairs(g: Graph) -> DataFrame:
    """The sums pair by pair, for directed graphs, where a square's corners aren't alike."""
    a = g.adj.where("src <> dst").select("src", "dst")
    degree = a.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    with_k = a.join(degree.withColumnRenamed("n", "dst"), "dst", "left").select("src", "dst", F.coalesce("k", F.lit(0)).alias("k"))
    left, right = with_k.select(F.col("src").alias("v"), F.col("dst").alias("x"), F.col("k").alias("kx")), with_k.select(F.col("src").alias("v"), F.col("dst").alias("y"), F.col("k").alias("ky"))
    pairs = left.join(right, "v").where("x < y")
    # common neighbours of each pair of nodes, v among them or not
    common = a.select(F.col("src").alias("x"), "dst").join(a.select(F.col("src").alias("y"), "dst"), "dst").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    back = a.select(F.col("src").alias("x"), F.col("dst").alias("v"), F.lit(1).alias("bx"))
    p = pairs.join(common, ["x", "y"], "left").join(back, ["x", "v"], "left").join(back.select(F.col("x").alias("y"), "v", F.col("bx").alias("by")), ["y", "v"], "left")
    tied = a.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1).alias("tie"))
    p = p.join(tied, ["x", "y"], "left")
    shared = F.coalesce("c", F.lit(0)) - F.coalesce(F.col("bx") * F.col("by"), F.lit(0))
    theta = shared + 1 + F.coalesce("tie", F.lit(0))
    sums = p.groupBy(F.col("v").alias("name")).agg(F.sum(shared).alias("q"), F.sum(F.col("kx") - theta + F.col("ky") - theta + shared).alias("all"))
    rows = g.nodes.select("name").join(sums, "name", "left")
    return rows.select("name", F.when(F.col("all") > 0, F.col("q") / F.col("all")).otherwise(0.0).alias("value"))


def constraint(g: Graph, names=None, weighted: bool = False, strict: bool = False) -> DataFrame:
    """Burt's constraint; NaN for nodes without (out-)edges.

    In directed unweighted graphs a neighbour counts 2 in the denominator even if tied one way, unless ``strict``.
    """
    if names:
        g.ensure_nodes(names)
    a = g.unit_adj(weighted).where("src <> dst")
    mutual = a
    if g.specs.directed:
        mutual = a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    m = mutual.groupBy("src", "dst").agg(F.sum("weight").alias("m"))
    base = m.withColumn("m2", F.lit(2.0)) if g.specs.directed and not weighted and not strict else m.withColumn("m2", F.col("m"))
    shares = base.groupBy("src").agg(F.sum("m2").alias("all"), F.count(F.lit(1)).alias("n"))
    p = lookup(m, "src", F.col("dst"), shares.withColumnRenamed("src", "k"), "k", "n", m.count()).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("m") / F.col("all")).alias("p"))
    c = _closed(_ranked(p)).groupBy("a", "b").agg(F.sum("p").alias("p")).groupBy(F.col("a").alias("name")).agg(F.sum(F.col("p") * F.col("p")).alias("value"))
    out = g.nodes.select("name").join(c, "name", "left").join(g.adj.select(F.col("src").alias("name")).distinct().withColumn("has", F.lit(True)), "name", "left")
    return _only(out.select("name", F.when(F.col("has"), F.coalesce("value", F.lit(float("nan")))).otherwise(F.lit(float("nan"))).alias("value")), names)


def _closed(p: DataFrame) -> DataFrame:
    """(a, b, p): the share of each tie, and for each triangle on it the product of the shares round its third node.

    ``p`` has ties both ways. A triangle is found once, from its node of lowest rank, so a hub's pairs of neighbours are few.
    """
    end = lambda c, r: F.struct(F.col(c).alias("n"), F.col(r).alias("r"))
    there = p.where("ra < rb").select("a", end("b", "rb").alias("y"), F.col("p").alias("out"))
    back = p.where("ra > rb").select(F.col("b").alias("a"), F.col("a").alias("n"), F.col("p").alias("in"))
    up = checkpointed(there.join(back, (there["a"] == back["a"]) & (F.col("y.n") == F.col("n"))).select(there["a"].alias("x"), "y", "out", "in"))
    two = up.select("x", "y", F.col("out").alias("xy"), F.col("in").alias("yx")).join(up.select("x", F.col("y").alias("z"), F.col("out").alias("xz"), F.col("in").alias("zx")), "x").where("y.r < z.r")
    third = up.select(F.col("x").alias("ny"), F.col("y.n").alias("nz"), F.col("out").alias("yz"), F.col("in").alias("zy"))
    three = two.join(third, (F.col("y.n") == F.col("ny")) & (F.col("z.n") == F.col("nz")))
    part = lambda a, b, first, second: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(first) * F.col(second)).alias("p"))
    parts = F.array(part("x", "ny", "xz", "zy"), part("ny", "x", "yz", "zx"), part("x", "nz", "xy", "yz"), part("nz", "x", "zy", "yx"), part("ny", "nz", "yx", "xz"), part("nz", "ny", "zx", "xy"))
    return p.select("a", "b", "p").unionByName(three.select(F.explode(parts).alias("t")).select("t.a", "t.b", "t.p"))


def is_partition(g: Graph, communities: DataFrame) -> bool:
    """communities(community, name): each node exactly once and nothing else."""
    names = communities.select("name")
    return names.count() == g.number_of_nodes() and g.nodes.join(names, "name", "left_anti").isEmpty()


def modularity(g: Graph, communities: DataFrame, weighted: bool = False, resolution: float = 1.0) -> float:
    if not is_partition(g, communities):
        raise GraphError("NotAPartition", "communities must hold each node exactly once")
    e = g.edges.withColumn("w", F.col("weight") if weighted else F.lit(1.0))
    of = communities.select("name", "community")
    cu, cv = of.select(F.col("name").alias("u"), F.col("community").alias("cu")), of.select(F.col("name").alias("v"), F.col("community").alias("cv"))
    e = e.join(cu, "u").join(cv, "v").select("cu", "cv", "w")
    flows = e.select(F.col("cu").alias("c"), F.col("w").alias("o"), F.lit(0.0).alias("i"), F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0).alias("l")).unionByName(
        e.select(F.col("cv").alias("c"), F.lit(0.0).alias("o"), F.col("w").alias("i"), F.lit(0.0).alias("l")))
    per = flows.groupBy("c").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("l").alias("l"))
    m = per.agg(F.sum("o")).first()[0]
    if not m:
        return float("nan")
    if g.specs.directed:
        term = F.col("l") / m - resolution * F.col("o") * F.col("i") / m**2
    else:
        d = F.col("o") + F.col("i")
        term = F.col("l") / m - resolution * d * d / (2 * m) ** 2
    return per.agg(F.sum(term)).first()[0]


def compute_modularity(g: Graph, communities: DataFrame, weighted: bool = False) -> float:
    """Modularity at resolution 1 of communities(community, name), direction left aside; nodes in no community add nothing.

    A community's share is its inner edges over all edges less the square of its share of all degrees.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    of = communities.select("name", "community")
    e = g.edges.select("u", "v", w.alias("w"))
    m = e.agg(F.sum("w")).first()[0]
    if not m:
        return float("nan")
    e = e.join(of.select(F.col("name").alias("u"), F.col("community").alias("cu")), "u", "left").join(of.select(F.col("name").alias("v"), F.col("community").alias("cv")), "v", "left")
    inner = F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)
    ends = e.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), F.col("w"), inner.alias("l")), F.struct(F.col("cv").alias("c"), F.col("w"), F.lit(0.0).alias("l")))).alias("x"))
    per = ends.where("x.c is not null").groupBy("x.c").agg(F.sum("x.w").alias("d"), F.sum("x.l").alias("l"))
    return per.agg(F.sum(F.col("l") / m - F.pow(F.col("d") / (2 * m), F.lit(2.0)))).first()[0] or 0.0
