"""Strongly connected components: ends cut off, chains contracted by pointer jumping, then many pivots at once.

A turn settles nodes without an edge in or without one out, and takes out every chain (nodes with one edge in and one out): its
place is taken by an edge between its ends, and it is settled last, as part of its ends' component if they share one. What is
left is searched both ways from the node of most edges, which settles a giant component with each edge used once a way. If that was
no giant, what is left is coloured: each node gets the pivot of least random rank that reaches it, and whatever reaches the pivot back
inside its colour is the pivot's component. No component crosses colours, so the edges between colours go.
Tables between rounds are written and read again, so that their sizes are known and not estimated from join to join.
No join has a hub's edges in one task: neighbours of chains are unique, other lookups settle hot keys by a bounded broadcast,
and fronts travel to edges that are cut at hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.durable import written
from meshwork.plans.edges import Bucketed, SplitEdges
from meshwork.plans.skew import lookup

#: Pivots are chosen in a turn that has settled or contracted less than this share of its nodes by degrees alone.
ENOUGH = 0.1
#: A component with at least this share of a turn's nodes is a giant; the turn ends when it is found.
GIANT = 0.5


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component) for every name of ``nodes``; component is its least member. Loops and repeated edges do no harm.

    ``edges`` (src, dst) run between names of ``nodes``. No nodes give no rows.
    """
    edges = written(edges.where("src <> dst").select("src", "dst").distinct())
    left, settled, chains, turn = written(nodes.select("name")), [], [], 0
    n = left.count()
    while n:
        turn += 1
        node = written(_degrees(left, edges))
        ends = node.where("nin = 0 or nout = 0").select("name", F.col("name").alias("component"))
        chain, cycles = _chains(node.where("nin = 1 and nout = 1"))
        settled += [ends, cycles]
        chains.append(chain)
        kept = written(node.where("nin > 0 and nout > 0 and (nin > 1 or nout > 1)"))
        over = chain.where("first").select(F.col("p").alias("src"), F.col("q").alias("dst")).where("src <> dst")
        inner = _between(edges, kept, F.lit(True)).select("src", "dst")
        # the ends of chains may be settled; those edges lead out of what is left
        edges = written(inner.unionByName(_between(over, _degrees(kept.select("name"), over), F.lit(True)).select("src", "dst")).distinct())
        left, before, n = kept.select("name"), n, kept.count()
        if n > (1 - ENOUGH) * before:
            before = n
            for search in (_giant, _pivots):
                found, edges = search(_degrees(left, edges), edges, turn)
                settled.append(found)
                left = written(left.join(found, "name", "left_anti"))
                n = left.count()
                if n <= (1 - GIANT) * before:
                    break
    if not settled:
        return left.select("name", F.col("name").alias("component"))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    done = written(done)
    for chain in reversed(chains):
        done = written(done.unionByName(_of_chains(chain, done)))
    least = done.groupBy("component").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("n"))
    return lookup(done, "component", F.col("name"), least, "component", "n", done.count()).select("name", F.col("least").alias("component"))


def _degrees(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, nin, nout, pred, succ); pred and succ are the least neighbours, the only ones where the degree is 1."""
    into = edges.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("nin"), F.min("src").alias("pred"))
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("nout"), F.min("dst").alias("succ"))
    both = names.join(into, "name", "left").join(out, "name", "left")
    return both.select("name", F.coalesce("nin", F.lit(0)).alias("nin"), F.coalesce("nout", F.lit(0)).alias("nout"), "pred", "succ")


def _between(edges: DataFrame, node: DataFrame, tag) -> DataFrame:
    """Edges with both ends among ``node`` (name, nin, nout) and one ``tag``; s and d are the tags of the ends."""
    total = edges.count()
    tails = written(node.select(F.col("name").alias("__s"), tag.alias("s"), F.col("nout").alias("__ws")))
    heads = written(node.select(F.col("name").alias("__d"), tag.alias("d"), F.col("nin").alias("__wd")))
    rows = lookup(edges.select("src", "dst"), "src", F.col("dst"), tails, "__s", "__ws", total).where("s is not null")
    return lookup(rows.select("src", "dst", "s"), "dst", F.col("src"), heads, "__d", "__wd", total).where("s = d").select("src", "dst", "s")


def _chains(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of chains (name, p, q, first) with the neighbours p before and q behind their chain, and nodes of cycles (name, component).

    ``first`` marks the node that follows p. Only nodes with one neighbour on either side come in, so links are one to one.
    """
    x = written(x.select("name", "pred", "succ"))
    # a successor that several have isn't one of x, so keys are unique before they meet
    one = x.groupBy(F.col("succ").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a")).where("n = 1").select("a", "b")
    links = written(one.join(x.select(F.col("name").alias("b")), "b"))
    behind = x.join(links.select(F.col("a").alias("name"), F.col("b").alias("to")), "name", "left").select("name", "to", F.col("succ").alias("end"))
    before = x.join(links.select(F.col("b").alias("name"), F.col("a").alias("to")), "name", "left").select("name", "to", F.col("pred").alias("end"))
    first = before.select("name", F.col("to").isNull().alias("first"))
    size = x.count()
    q, p = _jump(behind, size), _jump(before, size)
    cycles = q.where("open").select("name", F.col("least").alias("component"))
    chain = q.where("not open").select("name", F.col("end").alias("q")).join(p.select("name", F.col("end").alias("p")), "name").join(first, "name")
    return written(chain.select("name", "p", "q", "first")), written(cycles)


def _jump(state: DataFrame, size: int) -> DataFrame:
    """(name, end, least, open): the end of each node's last link, by pointer jumping; rows still open run in a circle.

    A node that is 2^k links ahead of another is so of no other, and a row that has come to its end meets itself, so at most
    two rows share a key.
    """
    state, reach = written(state.withColumn("least", F.col("name"))), 1
    while reach <= size and not state.where("to is not null").isEmpty():
        further = state.select(F.col("name").alias("key"), F.col("to").alias("to2"), F.col("end").alias("end2"), F.col("least").alias("least2"))
        met = state.select("name", "least", F.coalesce("to", "name").alias("key")).join(further, "key")
        state = written(met.select("name", F.col("to2").alias("to"), F.col("end2").alias("end"), F.least("least", "least2").alias("least")))
        reach *= 2
    return state.select("name", "end", "least", F.col("to").isNotNull().alias("open"))


def _giant(node: DataFrame, edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The component (name, component) of the node of most edges, and the edges that are left without it."""
    node = written(node)
    pivot = written(node.orderBy((F.col("nin") * F.col("nout")).desc(), "name").limit(1).select("name"))
    edges = edges.withColumn("weight", F.lit(1.0))
    both = _reached(edges, pivot).join(_reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), pivot), "name", "left_semi")
    found = written(both.crossJoin(F.broadcast(pivot.withColumnRenamed("name", "component"))))
    rest = node.select("name").join(found, "name", "left_anti")
    return found, written(_between(edges, _degrees(rest, edges), F.lit(True)).select("src", "dst"))


def _reached(edges: DataFrame, front: DataFrame) -> DataFrame:
    """The names that ``front`` reaches, its own among them. Each node sends once."""
    split, seen = SplitEdges(edges), Bucketed(front.sparkSession, ["name"], "reached")
    while not front.isEmpty():
        seen.append(front)
        step = split.out_of(front, "name").select(F.col("dst").alias("name")).distinct()
        front = written(step.join(seen.read(), "name", "left_anti"))
    out = written(seen.read())
    split.drop()
    seen.drop()
    return out


def _pivots(node: DataFrame, edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Components of this turn's pivots (name, component), and the edges that are left inside colours."""
    node = written(node)
    colour = written(_colours(node.select("name"), edges, turn))
    inner = written(_between(edges, node.join(colour, "name"), F.col("c.pivot")).select("src", "dst"))
    reached = _reached(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight")), colour.where("name = c.pivot").select("name"))
    found = written(colour.join(reached, "name", "left_semi").select("name", F.col("c.pivot").alias("component")))
    rest = node.select("name").join(found, "name", "left_anti")
    return found, written(_between(inner, _degrees(rest, inner), F.lit(True)).select("src", "dst"))


def _colours(names: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """(name, c struct<rank, pivot>): the least rank that reaches each node. Only nodes whose colour has changed send it on."""
    split = SplitEdges(edges.withColumn("weight", F.lit(1.0)))
    log = Bucketed(names.sparkSession, ["name"], "colours")
    front = written(names.select("name", F.struct(F.xxhash64("name", F.lit(turn)).alias("rank"), F.col("name").alias("pivot")).alias("c")))
    while not front.isEmpty():
        log.append(front)
        sent = split.out_of(front, "name").groupBy(F.col("dst").alias("name")).agg(F.min("c").alias("new"))
        held = log.read().groupBy("name").agg(F.min("c").alias("c"))
        front = written(sent.join(held, "name").where("new < c").select("name", F.col("new").alias("c")))
    out = written(log.read().groupBy("name").agg(F.min("c").alias("c")))
    split.drop()
    log.drop()
    return out


def _of_chains(chain: DataFrame, done: DataFrame) -> DataFrame:
    """(name, component) of chains: that of their ends if it is one, else each node is its own."""
    total = chain.count()
    for end, tag in (("p", "cp"), ("q", "cq")):
        counts = chain.groupBy(F.col(end).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        table = written(counts.join(done, "name").select(F.col("name").alias("__e"), F.col("component").alias(tag), F.col("n").alias(f"__n{end}")))
        chain = written(lookup(chain, end, F.col("name"), table, "__e", f"__n{end}", total))
    return chain.select("name", F.when(F.col("cp") == F.col("cq"), F.col("cp")).otherwise(F.col("name")).alias("component"))
