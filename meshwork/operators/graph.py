"""The property graph: two DataFrames under policies, with lookups, degrees, conversions, sub-graphs and matrices.

nodes(idx, name[, attributes]) and edges(seq, u, v, weight[, attributes]); an unweighted edge has weight NaN. Everything is
a DataFrame plan; only building a graph validates eagerly, in one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.errors import GraphError
from meshwork.plans.durable import checkpointed
from meshwork.plans.skew import lookup
from meshwork.specs import GraphSpecs

NAN = float("nan")
#: Values of the dense adjacency matrix that a task makes.
DENSE_VALUES = 1 << 27


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number rows 0.. in the given order without a one-task sort: range-sorted partitions, then offsets of partition sizes."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpointed(rows.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    starts = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__s"))
    return rows.join(F.broadcast(starts), "__p").withColumn(name, (F.col("__s") + F.col("__k").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__p", "__k", "__s")


def _text(attributes: dict | None) -> dict | None:
    return None if attributes is None else {str(k): None if v is None else str(v) for k, v in attributes.items()}


def _node_rows(spark: SparkSession, nodes: list, kind: str) -> DataFrame:
    rows = [(i, *((x[0], _text(x[1])) if isinstance(x, tuple) else (x, None))) for i, x in enumerate(nodes)]
    given = any(r[2] is not None for r in rows) or any(isinstance(x, tuple) for x in nodes)
    out = spark.createDataFrame(rows, f"seq long, name {kind}, attributes map<string,string>")
    return out if given else out.drop("attributes")


def _edge_rows(spark: SparkSession, edges: list, kind: str) -> DataFrame:
    rows = [(i, x[0], x[1], float(x[2]) if len(x) > 2 else NAN, _text(x[3]) if len(x) > 3 else None) for i, x in enumerate(edges)]
    out = spark.createDataFrame(rows, f"seq long, u {kind}, v {kind}, weight double, attributes map<string,string>")
    return out if any(len(x) > 3 for x in edges) else out.drop("attributes")


class Graph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, specs: GraphSpecs):
        self.nodes, self.edges, self.specs = nodes, edges, specs
        self.spark: SparkSession = nodes.sparkSession

    # ---- construction ----
    @staticmethod
    def new(spark: SparkSession, specs: GraphSpecs, kind: str = "string") -> Graph:
        return Graph(spark.createDataFrame([], f"idx long, name {kind}"), spark.createDataFrame([], f"seq long, u {kind}, v {kind}, weight double"), specs)

    @staticmethod
    def of(spark: SparkSession, specs: GraphSpecs, edges: list = (), nodes: list = (), kind: str = "string") -> Graph:
        """From Python rows: edges (u, v[, weight[, attributes]]), nodes by name or as (name, attributes); attributes are dicts."""
        return Graph.build(_node_rows(spark, nodes, kind), _edge_rows(spark, edges, kind), specs)

    @staticmethod
    def build(nodes: DataFrame, edges: DataFrame, specs: GraphSpecs) -> Graph:
        """Apply the policies: loops, missing nodes, orientation, duplicates. ``seq`` gives the order of insertion of both.

        An edge's first failing check decides its error, and the edge of smallest seq decides the graph's.
        """
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(NAN))
        if "seq" not in edges.columns:
            edges = edges.withColumn("seq", F.monotonically_increasing_id())
        if "seq" not in nodes.columns:
            nodes = nodes.withColumn("seq", F.monotonically_increasing_id())
        loop = F.col("u") == F.col("v")
        bad = []
        if not specs.self_loops:
            if specs.loops_forbidden == "drop":
                edges = edges.where(~loop)
            else:
                bad.append(edges.where(loop).select("seq", F.lit(0).alias("step"), F.lit("SelfLoopsFound").alias("kind")))
        if specs.missing_nodes == "error":
            names = nodes.select("name").distinct()
            for end in ("u", "v"):
                bad.append(edges.join(names, edges[end] == names["name"], "left_anti").select("seq", F.lit(1).alias("step"), F.lit("NodeNotFound").alias("kind")))
        if not specs.directed:
            edges = edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})
        if not specs.multi_edges:
            pair = Window.partitionBy("u", "v")
            if specs.dedupe == "error":
                later = edges.withColumn("k", F.row_number().over(pair.orderBy("seq"))).where("k > 1")
                bad.append(later.select("seq", F.lit(2).alias("step"), F.lit("DuplicateEdge").alias("kind")))
            else:
                order = F.col("seq").asc() if specs.dedupe == "first" else F.col("seq").desc()
                edges = edges.withColumn("__k", F.row_number().over(pair.orderBy(order))).where("__k = 1").drop("__k")
        if bad:
            found = bad[0]
            for b in bad[1:]:
                found = found.unionByName(b)
            first = found.agg(F.min_by(F.struct("kind", "seq"), F.struct("seq", "step")).alias("x")).first().x
            if first is not None:
                raise GraphError(first.kind, f"edge number {first.seq}")
        # the last of repeated nodes gives the attributes, the first the index
        listed = nodes.select("name", F.lit(0).alias("g"), F.col("seq").alias("s"), F.lit(0).alias("e"), *([F.col("attributes")] if "attributes" in nodes.columns else []))
        ends = edges.select(F.col("u").alias("name"), F.lit(1).alias("g"), F.col("seq").alias("s"), F.lit(0).alias("e")).unionByName(
            edges.select(F.col("v").alias("name"), F.lit(1).alias("g"), F.col("seq").alias("s"), F.lit(1).alias("e")))
        every = listed.unionByName(ends, allowMissingColumns=True)
        agg = [F.min(F.struct("g", "s", "e")).alias("o")]
        if "attributes" in nodes.columns:
            agg.append(F.max_by(F.struct("attributes"), F.when(F.col("g") == 0, F.col("s"))).getField("attributes").alias("attributes"))
        numbered = dense_index(every.groupBy("name").agg(*agg), ["o"]).drop("o")
        return Graph(numbered.select("idx", "name", *([F.col("attributes")] if "attributes" in nodes.columns else [])), edges, specs)

    def _with(self, more_nodes: DataFrame | None = None, more_edges: DataFrame | None = None) -> Graph:
        nodes = self.nodes.withColumnRenamed("idx", "seq")
        if more_nodes is not None:
            top = (nodes.agg(F.max("seq")).first()[0] or 0) + 1
            nodes = nodes.unionByName(more_nodes.withColumn("seq", F.col("seq") + top), allowMissingColumns=True)
        edges = self.edges
        if more_edges is not None:
            top = (edges.agg(F.max("seq")).first()[0] or 0) + 1
            edges = edges.unionByName(more_edges.withColumn("seq", F.col("seq") + top), allowMissingColumns=True)
        return Graph.build(nodes, edges, self.specs)

    @property
    def _kind(self) -> str:
        return self.nodes.schema["name"].dataType.simpleString()

    def add_nodes(self, nodes: list) -> Graph:
        """Names or (name, attributes). A node that is there gets the attributes given, null if none are, and keeps its index."""
        return self._with(more_nodes=_node_rows(self.spark, nodes, self._kind))

    def add_node(self, node) -> Graph:
        return self.add_nodes([node])

    def add_edges(self, edges: list) -> Graph:
        """Rows (u, v[, weight[, attributes]])."""
        return self._with(more_edges=_edge_rows(self.spark, edges, self._kind))

    def add_edge(self, edge: tuple) -> Graph:
        return self.add_edges([edge])

    def add_edge_tuples_weighted(self, edges: list) -> Graph:
        return self.add_edges([(u, v, w) for u, v, w in edges])

    def add_edge_tuples(self, edges: list) -> Graph:
        return self.add_edges([(u, v) for u, v in edges])

    def add_edge_tuple(self, u, v) -> Graph:
        return self.add_edge_tuples([(u, v)])

    # ---- derived frames ----
    @cached_property
    def pairs(self) -> DataFrame:
        """One row per distinct (u, v): the first weight, or the last where duplicates keep the last."""
        pick = F.max_by if self.specs.dedupe == "last" else F.min_by
        return self.edges.groupBy("u", "v").agg(pick("weight", "seq").alias("weight")) if self.specs.multi_edges else self.edges.select("u", "v", "weight")

    @cached_property
    def adj(self) -> DataFrame:
        """(src, dst, weight): successors if directed, else neighbours; one row per neighbour."""
        one = self.pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")
        return one if self.specs.directed else one.unionByName(one.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    @cached_property
    def both(self) -> DataFrame:
        """(src, dst): successors and predecessors, distinct."""
        a = self.adj.select("src", "dst")
        return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if self.specs.directed else a

    def unit_adj(self, weighted: bool) -> DataFrame:
        """adj with weights as they are, or all 1."""
        if weighted:
            self.ensure_weighted()
            return self.adj
        return self.adj.withColumn("weight", F.lit(1.0))

    # ---- guards ----
    def ensure_directed(self) -> None:
        if not self.specs.directed:
            raise GraphError("WrongMethod", "for directed graphs only")

    def ensure_undirected(self) -> None:
        if self.specs.directed:
            raise GraphError("WrongMethod", "for undirected graphs only")

    def ensure_not_multi_edges(self) -> None:
        if self.specs.multi_edges:
            raise GraphError("WrongMethod", "not for graphs with parallel edges")

    def ensure_weighted(self) -> None:
        if not self.edges_have_weight():
            raise GraphError("EdgeWeightNotSpecified", "every edge needs a weight")

    def ensure_nodes(self, names) -> None:
        if not self.has_nodes(names):
            raise GraphError("NodeNotFound", f"not all of {list(names)[:5]} are nodes")

    # ---- lookups ----
    def get_all_nodes(self) -> DataFrame:
        return self.nodes

    def get_all_node_names(self) -> DataFrame:
        return self.nodes.select("name")

    def get_all_edges(self) -> DataFrame:
        return self.edges

    def get_node(self, name) -> DataFrame:
        return self.nodes.where(F.col("name") == F.lit(name))

    def get_node_by_index(self, i: int) -> DataFrame:
        return self.nodes.where(F.col("idx") == i)

    def has_node(self, name) -> bool:
        return not self.get_node(name).isEmpty()

    def has_nodes(self, names) -> bool:
        names = set(names)
        return not names or self.nodes.where(F.col("name").isin(*names)).count() == len(names)

    def _between(self, u, v) -> DataFrame:
        self.ensure_nodes([u, v])
        a, b = (u, v) if self.specs.directed or u <= v else (v, u)
        found = self.edges.where((F.col("u") == F.lit(a)) & (F.col("v") == F.lit(b)))
        if found.isEmpty():
            raise GraphError("EdgeNotFound", f"({u}, {v})")
        return found

    def get_edge(self, u, v) -> DataFrame:
        self.ensure_not_multi_edges()
        return self._between(u, v)

    def get_edges(self, u, v) -> DataFrame:
        if not self.specs.multi_edges:
            raise GraphError("WrongMethod", "for graphs with parallel edges only")
        return self._between(u, v)

    def get_edges_for_node(self, name) -> DataFrame:
        """In- and out-edges; a directed loop is both."""
        self.ensure_nodes([name])
        out, into = self.edges.where(F.col("u") == F.lit(name)), self.edges.where(F.col("v") == F.lit(name))
        return out.unionByName(into) if self.specs.directed else self.edges.where((F.col("u") == F.lit(name)) | (F.col("v") == F.lit(name)))

    def get_edges_for_nodes(self, names) -> DataFrame:
        self.ensure_nodes(names)
        return self.edges.where(F.col("u").isin(*names) | F.col("v").isin(*names))

    def get_in_edges_for_nodes(self, names) -> DataFrame:
        self.ensure_directed()
        self.ensure_nodes(names)
        return self.edges.where(F.col("v").isin(*names))

    def get_in_edges_for_node(self, name) -> DataFrame:
        return self.get_in_edges_for_nodes([name])

    def get_out_edges_for_nodes(self, names) -> DataFrame:
        self.ensure_directed()
        self.ensure_nodes(names)
        return self.edges.where(F.col("u").isin(*names))

    def get_out_edges_for_node(self, name) -> DataFrame:
        return self.get_out_edges_for_nodes([name])

    def _nodes_of(self, names: DataFrame) -> DataFrame:
        return self.nodes.join(names.distinct(), "name", "left_semi")

    def get_neighbor_nodes(self, name) -> DataFrame:
        self.ensure_nodes([name])
        return self._nodes_of(self.both.where(F.col("src") == F.lit(name)).select(F.col("dst").alias("name")))

    def get_successor_nodes(self, name) -> DataFrame:
        self.ensure_directed()
        self.ensure_nodes([name])
        return self._nodes_of(self.adj.where(F.col("src") == F.lit(name)).select(F.col("dst").alias("name")))

    def get_predecessor_nodes(self, name) -> DataFrame:
        self.ensure_directed()
        self.ensure_nodes([name])
        return self._nodes_of(self.adj.where(F.col("dst") == F.lit(name)).select(F.col("src").alias("name")))

    def get_successor_node_names(self, name) -> DataFrame:
        return self.get_successor_nodes(name).select("name")

    def get_predecessor_node_names(self, name) -> DataFrame:
        return self.get_predecessor_nodes(name).select("name")

    def get_successors_map(self) -> DataFrame:
        return self.adj.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))

    def get_predecessors_map(self) -> DataFrame:
        """Empty for undirected graphs."""
        rows = self.adj if self.specs.directed else self.adj.limit(0)
        return rows.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("predecessors"))

    def _chunks(self, near: str, far: str, most: int, column: str) -> DataFrame:
        rows = self.adj.select(F.col(near).alias("name"), F.col(far).alias("other"))
        total, n = rows.count(), self.number_of_nodes()
        degrees = rows.groupBy(F.col("name").alias("k")).agg(F.count(F.lit(1)).alias("d"))
        seen = rows.groupBy(F.col("other").alias("o")).agg(F.count(F.lit(1)).alias("m"))
        ids = self.nodes.select("name", "idx").join(seen, F.col("name") == F.col("o")).select("o", "idx", "m")
        rows = lookup(lookup(rows, "name", F.col("other"), degrees, "k", "d", total), "other", F.col("name"), ids, "o", "m", total)
        chunk = F.expr(f"(idx * (1 + (d - 1) div {most})) div {max(n, 1)}")
        return rows.groupBy("name", chunk.alias("chunk")).agg(F.sort_array(F.collect_set("other")).alias(column))

    def get_successors_chunks(self, most: int = 10_000) -> DataFrame:
        """(name, chunk, successors): the map in pieces, so that no row or task holds a hub's whole list.

        A node of d successors has 1 + (d - 1) div ``most`` chunks, each of which holds those of a range of node indices.
        """
        return self._chunks("src", "dst", most, "successors")

    def get_predecessors_chunks(self, most: int = 10_000) -> DataFrame:
        """The same of predecessors; empty for undirected graphs."""
        rows = self._chunks("dst", "src", most, "predecessors")
        return rows if self.specs.directed else rows.limit(0)

    def get_successors_or_neighbors(self, name) -> DataFrame:
        return self.get_successor_nodes(name) if self.specs.directed else self.get_neighbor_nodes(name)

    def edges_have_weight(self) -> bool:
        return self.edges.where(F.isnan("weight")).isEmpty()

    # ---- counts ----
    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        """Distinct pairs; parallel edges count once."""
        return self.edges.select("u", "v").distinct().count()

    def size(self, weighted: bool = False) -> float:
        return float(self.edges.agg(F.sum("weight") if weighted else F.count(F.lit(1))).first()[0] or 0.0)

    def get_density(self) -> float:
        n, m = self.number_of_nodes(), self.number_of_edges()
        return 0.0 if m == 0 or n < 2 else m / (n * (n - 1)) * (1 if self.specs.directed else 2)

    # ---- degrees ----
    def _per_node(self, ends: list[str], weighted: bool) -> DataFrame:
        what = F.col("weight") if weighted else F.lit(1)
        rows = self.edges.select(F.explode(F.array(*ends)).alias("name"), what.alias("x"))
        kind = "double" if weighted else "long"
        sums = rows.groupBy("name").agg(F.sum("x").cast(kind).alias("value"))
        return self.nodes.select("name").join(sums, "name", "left").withColumn("value", F.coalesce("value", F.lit(0).cast(kind)))

    def _ends(self, loops_count_both: bool) -> list:
        """Both ends of an edge; with ``loops_count_both`` a directed loop is an in-edge and an out-edge, and each adds 2."""
        if not (loops_count_both and self.specs.directed):
            return ["u", "v"]
        return ["u", "v", *[F.when(F.col("u") == F.col("v"), F.col(c)) for c in ("u", "v")]]

    def get_degree_for_all_nodes(self, loops_count_both: bool = False) -> DataFrame:
        """A loop adds 2, in directed graphs too (one in, one out); with ``loops_count_both`` a directed loop adds 4."""
        return self._per_node(self._ends(loops_count_both), False)

    def get_weighted_degree_for_all_nodes(self, loops_count_both: bool = False) -> DataFrame:
        return self._per_node(self._ends(loops_count_both), True)

    def _directional(self, end: str, weighted: bool) -> DataFrame:
        self.ensure_directed()
        return self._per_node([end], weighted)

    def get_in_degree_for_all_nodes(self) -> DataFrame:
        return self._directional("v", False)

    def get_out_degree_for_all_nodes(self) -> DataFrame:
        return self._directional("u", False)

    def get_weighted_in_degree_for_all_nodes(self) -> DataFrame:
        return self._directional("v", True)

    def get_weighted_out_degree_for_all_nodes(self) -> DataFrame:
        return self._directional("u", True)

    def _one(self, name, ends: list[str], weighted: bool):
        """Of one node, or None if it isn't there or the graph has no directions to tell apart."""
        if (len(ends) == 1 and not self.specs.directed) or not self.has_node(name):
            return None
        what = F.col("weight") if weighted else F.lit(1)
        row = self.edges.select(F.explode(F.array(*ends)).alias("name"), what.alias("x")).where(F.col("name") == F.lit(name)).agg(F.sum("x")).first()[0]
        return (float if weighted else int)(row or 0)

    def get_node_degree(self, name, loops_count_both: bool = False):
        return self._one(name, self._ends(loops_count_both), False)

    def get_node_in_degree(self, name):
        return self._one(name, ["v"], False)

    def get_node_out_degree(self, name):
        return self._one(name, ["u"], False)

    def get_node_weighted_degree(self, name, loops_count_both: bool = False):
        return self._one(name, self._ends(loops_count_both), True)

    def get_node_weighted_in_degree(self, name):
        return self._one(name, ["v"], True)

    def get_node_weighted_out_degree(self, name):
        return self._one(name, ["u"], True)

    # ---- conversions ----
    def reverse(self) -> Graph:
        self.ensure_directed()
        swap = {"u": F.col("v").alias("u"), "v": F.col("u").alias("v")}
        return Graph(self.nodes, self.edges.select(*[swap.get(c, F.col(c)) for c in self.edges.columns]), self.specs)

    def set_all_edge_weights(self, weight: float) -> Graph:
        return Graph(self.nodes, self.edges.withColumn("weight", F.lit(float(weight))), self.specs)

    def to_single_edges(self) -> Graph:
        """Parallel edges sum up; a missing weight stays missing. Attributes go."""
        if not self.specs.multi_edges:
            raise GraphError("WrongMethod", "for graphs with parallel edges only")
        e = self.edges.groupBy("u", "v").agg(F.min("seq").alias("seq"), F.sum("weight").alias("weight")).select("seq", "u", "v", "weight")
        return Graph(self.nodes, e, self.specs.but(multi_edges=False))

    def to_undirected(self, collapse: str | None = None) -> Graph:
        """(u, v) and (v, u) become one edge with the max, min or sum of the weights; with None all weights go."""
        self.ensure_directed()
        known = F.when(~F.isnan("weight"), F.col("weight"))
        agg = {None: F.lit(NAN), "max": F.coalesce(F.max(known), F.lit(-1.7976931348623157e308)), "min": F.coalesce(F.min(known), F.lit(1.7976931348623157e308)), "sum": F.sum("weight")}
        if collapse not in agg:
            raise GraphError("InvalidArgument", f"collapse is max, min, sum or None, not {collapse}")
        value = agg[collapse]
        e = self.edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("seq").alias("seq"), *([] if collapse is None else [value.alias("weight")]))
        e = e if collapse is not None else e.withColumn("weight", value)
        return Graph(self.nodes, e.select("seq", F.col("a").alias("u"), F.col("b").alias("v"), "weight"), self.specs.but(directed=False, multi_edges=False))

    def _induced(self, names: DataFrame) -> Graph:
        keep = names.select("name").distinct()
        e = self.edges.join(keep.withColumnRenamed("name", "u"), "u", "left_semi").join(keep.withColumnRenamed("name", "v"), "v", "left_semi")
        return Graph(self.nodes.join(keep, "name", "left_semi").select(*self.nodes.columns), e.select(*self.edges.columns), self.specs)

    def get_subgraph(self, names) -> Graph:
        """``names`` is a list or a DataFrame with a column name."""
        if isinstance(names, DataFrame):
            if not names.join(self.nodes, "name", "left_anti").isEmpty():
                raise GraphError("NodeNotFound", "not all names are nodes")
            return self._induced(names)
        self.ensure_nodes(names)
        return self._induced(self.nodes.where(F.col("name").isin(*names)))

    def get_ego_graph(self, name) -> Graph:
        return self._induced(self.get_neighbor_nodes(name).select("name").unionByName(self.get_node(name).select("name")))

    # ---- matrices ----
    def get_adjacency_matrix_sprs(self, weighted: bool, symmetric: bool = False) -> DataFrame:
        """(i, j, value) by node index; of undirected graphs one triangle, as stored, unless ``symmetric``."""
        self.ensure_not_multi_edges()
        value = F.col("weight") if weighted else F.lit(1.0)
        rows = (self.adj.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight") if symmetric else self.pairs).withColumn("value", value)
        a, b = self.nodes.select(F.col("idx").alias("i"), F.col("name").alias("u")), self.nodes.select(F.col("idx").alias("j"), F.col("name").alias("v"))
        return rows.join(a, "u").join(b, "v").select("i", "j", "value")

    def get_adjacency_matrix_vec_vec(self, weighted: bool) -> DataFrame:
        """(i, row): each node's dense row of length n."""
        return self.dense_pieces(weighted, max(1, self.number_of_nodes())).select("i", F.col("values").alias("row"))

    def dense_pieces(self, weighted: bool, most: int = 1 << 16) -> DataFrame:
        """(i, first, values): the dense n * n matrix row by row, each row in pieces of ``most`` values, for any number of nodes.

        What the forms below hold on the driver; ``i * n + first`` is a piece's place in the vector. Rows become dense in the task that
        hands them on, some million values at a time, and the number of tasks follows n * n, not the number of edges.
        """
        n = self.number_of_nodes()
        rows, parts = self._sparse_rows(weighted, n)
        cuts = np.arange(0, n, most)
        ends = np.append(cuts[1:], n)

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_once = max(1, (1 << 20) // max(n, 1))
            for b in batches:
                for lo in range(0, len(b), at_once):
                    part = b.slice(lo, at_once)
                    m = np.zeros((len(part), n))
                    at = np.repeat(np.arange(len(part)), part.column("j").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                    m[at, part.column("j").flatten().to_numpy()] = part.column("value").flatten().to_numpy()
                    offsets = np.append(0, (np.arange(len(part))[:, None] * n + ends).ravel()).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))
                    i = np.repeat(part.column("i").to_numpy(), len(cuts))
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(cuts, len(part))), values], ["i", "first", "values"])

        return rows.repartition(parts, "i").mapInArrow(dense, "i long, first long, values array<double>")

    def _sparse_rows(self, weighted: bool, n: int) -> tuple[DataFrame, int]:
        """(i, j, value), the last two as lists, of each node, and into how many tasks their dense rows go."""
        coo = self.get_adjacency_matrix_sprs(weighted, symmetric=True)
        held = coo.groupBy("i").agg(F.collect_list(F.struct("j", "value")).alias("e"))
        rows = self.nodes.select(F.col("idx").alias("i")).join(held, "i", "left").select("i", F.col("e.j").alias("j"), F.col("e.value").alias("value"))
        return rows, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n * n // DENSE_VALUES))

    def dense_columns(self, weighted: bool, side: int = 128) -> DataFrame:
        """(first, j, values): the dense matrix in strips of ``side`` rows, each column by column; ``values`` are those of the rows from ``first`` on.

        Spelt out, ``j`` stays the same for ``side`` rows and ``i`` runs round in a short circle, which Parquet stores in a fraction of
        what it takes row by row, where ``j`` runs through n values.
        """
        n = self.number_of_nodes()
        rows, parts = self._sparse_rows(weighted, n)

        def strip(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = held[0].column("i")[0].as_py()
            count, step = min(side, n - first), max(1, (1 << 20) // side)
            lengths = np.concatenate([b.column("j").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for b in held])
            i = np.repeat(np.concatenate([b.column("i").to_numpy() for b in held]) - first, lengths)
            j, value = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in ("j", "value"))
            for lo in range(0, n, step):
                m, there = np.zeros((min(step, n - lo), count)), (j >= lo) & (j < lo + step)
                m[j[there] - lo, i[there]] = value[there]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, count, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), first)), pa.array(np.arange(lo, lo + len(m))), values], ["first", "j", "values"])

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:  # in the order of i, and a strip has all of its rows
                of = b.column("i").to_numpy() // side
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(b)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and held[0].column("i")[0].as_py() // side != of[lo]:
                        yield from strip(held)
                        held = []
                    if hi > lo:
                        held.append(b.slice(lo, hi - lo))
            if held:
                yield from strip(held)

        return rows.repartition(parts, F.expr(f"i div {side}")).sortWithinPartitions("i").mapInArrow(dense, "first long, j long, values array<double>")

    def get_adjacency_matrix_ndarray(self, weighted: bool):
        """A dense numpy array on the driver: n * n values, so for graphs of some thousand nodes."""
        out = np.zeros((self.number_of_nodes(),) * 2)
        for r in self.get_adjacency_matrix_sprs(weighted, symmetric=True).toLocalIterator():
            out[r.i, r.j] = r.value
        return out

    get_adjacency_matrix_nalgebra = get_adjacency_matrix_ndarray

    def get_adjacency_matrix_vec(self, weighted: bool) -> list[float]:
        return self.get_adjacency_matrix_ndarray(weighted).ravel().tolist()
