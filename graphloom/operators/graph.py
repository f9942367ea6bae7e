"""The property graph and its operators: upsert, closure, neighbours, degrees, k-hop, induced views."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import present
from graphloom.session import bucketed_table

#: Metadata is a JSON object as text, so that keys may differ from row to row.
NODE_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()), T.StructField("ord", T.LongType())]
)
EDGE_SCHEMA = T.StructType(
    [T.StructField("edge_idx", T.LongType()), T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("metadata", T.StringType())]
)
DEFAULT_TYPE = "Entity"


def as_nodes(df: DataFrame) -> DataFrame:
    """``df`` in the node schema; missing columns take their defaults."""
    defaults = {"type": F.lit(DEFAULT_TYPE), "text": F.lit(None), "embedding": F.lit(None), "metadata": F.lit("{}"), "ord": F.monotonically_increasing_id()}
    return df.select(*[(F.col(f.name) if f.name in df.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA])


def as_edges(df: DataFrame) -> DataFrame:
    """``df`` in the edge schema; missing columns take their defaults."""
    defaults = {"relation": F.lit(""), "weight": F.lit(1.0), "metadata": F.lit("{}"), "edge_idx": F.monotonically_increasing_id()}
    return df.select(*[(F.col(f.name) if f.name in df.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in EDGE_SCHEMA])


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the values of its last row, at the position of its first."""
    value = F.max_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(key).agg(value.alias("_v"), F.min(order).alias("_o")).select(*[F.col("_o").alias(c) if c == order else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: its first row."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_v")).select(*[F.col(f"_v.{c}").alias(c) for c in rows.columns])


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes, directed edges (parallel ones and self-loops allowed), named indexes, and the edges stored by their ends if they are."""

    nodes: DataFrame
    edges: DataFrame
    indexes: dict = field(default_factory=dict)
    by_ends: DataFrame | None = None

    @staticmethod
    def empty(spark: SparkSession) -> PropertyGraph:
        return PropertyGraph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

    def upsert_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """Nodes replaced whole by later ones of the same id, which keep the earlier position."""
        placed = self.nodes.withColumn("_seq", F.struct(F.lit(0), "ord")).unionByName(as_nodes(nodes).withColumn("_seq", F.struct(F.lit(1), F.col("ord"))))
        merged = placed.groupBy("id").agg(F.max_by(F.struct(*NODE_SCHEMA.names), "_seq").alias("v"), F.min_by("ord", "_seq").alias("o"))
        return replace(self, nodes=merged.select(*[F.col("o").alias("ord") if c == "ord" else F.col(f"v.{c}") for c in NODE_SCHEMA.names]))

    def append_edges(self, edges: DataFrame) -> PropertyGraph:
        """Edges appended as they are; endpoints that are not nodes become bare ones, sources before targets."""
        new = as_edges(edges)
        return replace(self, nodes=closed(self.nodes, new), edges=self.edges.unionByName(new), by_ends=None)

    def stored(self) -> PropertyGraph:
        """The graph with its edges written once, each under both of its ends, bucketed by them.

        What joins or groups edges by an end then moves none of them: ``ends``, ``k_hop``, ``incident``,
        ``neighbors``, ``induced``.  The edges themselves are those whose end is their source."""
        return replace(self, by_ends=bucketed_table(_ends_of(self.edges), "edges-by-ends", "id", gather=True))

    def ends(self) -> DataFrame:
        """id, other, outward, and the columns of edges: every edge under its source (outward) and under its target."""
        return self.by_ends if self.by_ends is not None else _ends_of(self.edges)

    def outward(self) -> DataFrame:
        """The edges, by source: from the stored table if there is one."""
        return self.edges if self.by_ends is None else self.by_ends.filter("outward").select(F.col("id").alias("source"), F.col("other").alias("target"), "edge_idx", "relation", "weight", "metadata").select(*EDGE_SCHEMA.names)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def neighbors(self, ids: DataFrame) -> DataFrame:
        """Outgoing edges of the ids (column id), in insertion order when sorted by edge_idx."""
        return self.outward().join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")

    def attach(self, name: str, index) -> PropertyGraph:
        return replace(self, indexes={**self.indexes, name: index})

    def index(self, name: str):
        return self.indexes.get(name)

    def list_indexes(self) -> list[str]:
        return sorted(k for k, v in self.indexes.items() if v is not None)

    def search(self, name: str, queries, k: int = 5, top_k: int | None = None, **options) -> DataFrame:
        index = self.index(name)
        if index is None:
            raise ValueError(f"index {name!r} is not attached")
        return index.search(queries, top_k if top_k is not None else k, **options)


def _ends_of(edges: DataFrame) -> DataFrame:
    end = lambda a, b, out: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(out).alias("outward"))
    return edges.select(F.explode(F.array(end("source", "target", True), end("target", "source", False))).alias("e"), "edge_idx", "relation", "weight", "metadata").select("e.*", "edge_idx", "relation", "weight", "metadata")


def incident(graph: PropertyGraph) -> DataFrame:
    """id, out_edges, in_edges: edge_idx of every node's edges in order; a self-loop is in both."""
    ends = graph.ends().groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("outward") == out, F.col("edge_idx")))).alias(name) for name, out in (("out_edges", True), ("in_edges", False))])
    none = F.array().cast("array<bigint>")
    return graph.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("out_edges", none).alias("out_edges"), F.coalesce("in_edges", none).alias("in_edges"))


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and the bare nodes that stand for endpoints missing among them."""
    ends = edges.select(F.explode(F.array(F.struct((F.col("edge_idx") * 2).alias("ord"), F.col("source").alias("id")), F.struct((F.col("edge_idx") * 2 + 1).alias("ord"), F.col("target").alias("id")))).alias("e")).select("e.id", "e.ord")
    missing = ends.groupBy("id").agg(F.min("ord").alias("ord")).join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(as_nodes(missing))


def degrees(graph: PropertyGraph, among: DataFrame | None = None) -> DataFrame:
    """id, degree: in plus out, parallel edges counted, self-loops twice; nodes without edges have 0.

    ``among`` (column id): only these are counted, and only they are returned."""
    each = graph.edges.select(F.explode(F.array("source", "target")).alias("id"))
    if among is not None:
        chosen = among.select("id").distinct()
        ends = each.join(chosen, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
        return chosen.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    ends = each.groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes.select("id").join(ends, "id", "full_outer").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def out_neighbors(graph: PropertyGraph, of: DataFrame) -> DataFrame:
    """source, target: the distinct outgoing pairs of the ids ``of`` (column id); only their edges are compared."""
    return graph.neighbors(of).select("source", "target").distinct()


def adjacency(graph: PropertyGraph) -> DataFrame:
    """id, neighbours: distinct undirected neighbours as a sorted array."""
    both = graph.edges.select(F.col("source").alias("id"), F.col("target").alias("n")).union(graph.edges.select(F.col("target"), F.col("source")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed where a shared folder is set, so that plans which use it often do not make it again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def k_hop(graph: PropertyGraph, seeds: DataFrame, hops: int, by: Sequence[str] = ()) -> DataFrame:
    """id, hop: everything within ``hops`` undirected steps of the seeds (column id), which may be no nodes.

    With ``by``, columns of the seeds such as a session, every group of seeds is followed on its own.
    Each step joins only the frontier with the edges; its result is checkpointed when a shared
    folder is set, so lineage does not grow with the hops."""
    both = graph.ends().select(F.col("id").alias("a"), F.col("other").alias("b"))
    seen = seeds.select(*by, "id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, max(0, int(hops)) + 1):
        step = both.join(frontier.select(*by, F.col("id").alias("a")), "a").select(*by, F.col("b").alias("id")).distinct()
        frontier = step.join(seen.select(*by, "id"), [*by, "id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop > 1:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def induced(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The nodes among ``ids`` (column id), and the edges with both ends there."""
    chosen = ids.select("id").distinct()
    edges = graph.outward().join(chosen.withColumnRenamed("id", "source"), "source", "left_semi").join(chosen.withColumnRenamed("id", "target"), "target", "left_semi")
    return PropertyGraph(graph.nodes.join(chosen, "id", "left_semi"), edges.select(*EDGE_SCHEMA.names))


def view_seeds(overlay_nodes: DataFrame, overlay_edges: DataFrame) -> DataFrame:
    """Seeds of a session view: overlay nodes, or the overlay edges' endpoints where there are no nodes."""
    ends = overlay_edges.select("session_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    own = overlay_nodes.select("session_id", "id").distinct()
    return own.unionByName(ends.join(own.select("session_id").distinct(), "session_id", "left_anti"))


def labels(nodes: DataFrame) -> DataFrame:
    """id, label, group, title: entity name for attribute bundles, text where an original label is kept, else the id."""
    meta = lambda key: F.get_json_object("metadata", f"$.{key}")
    bundle = F.when(format_key(meta("_source_style")) == "attribute_bundle_graph", present(meta("entity_name")))
    shown = F.when(F.array_contains(F.json_object_keys("metadata"), "original_label"), present(F.col("text")))
    return nodes.select("id", F.coalesce(bundle, shown, F.col("id")).alias("label"), F.col("type").alias("group"), F.col("id").alias("title"))


#: Format names as callers give them, and the names here.
FORMAT_ALIASES = {
    "component": "component_graph",
    "component_graph": "component_graph",
    "fastinsight": "component_graph",
    "attribute_bundle": "attribute_bundle_graph",
    "attribute_bundle_graph": "attribute_bundle_graph",
    "lightrag": "attribute_bundle_graph",
    "topology_semantic": "topology_semantic_graph",
    "topology_semantic_graph": "topology_semantic_graph",
    "hipporag": "topology_semantic_graph",
    "subgraph_union": "subgraph_union_graph",
    "subgraph_union_graph": "subgraph_union_graph",
    "g_retriever": "subgraph_union_graph",
    "gretriever": "subgraph_union_graph",
    "expla_graphs": "expla_graphs",
    "freebasekg": "freebasekg",
    "tog": "tog",
}


def canonical_format(name: str) -> str:
    key = str(name).strip().lower().replace("-", "_").replace(" ", "_")
    return FORMAT_ALIASES.get(key, key)


def format_key(name: Column) -> Column:
    """``canonical_format`` as a column."""
    key = F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FORMAT_ALIASES.items() for x in kv])[key], key)


class GraphRegistry:
    """Named graphs with one of them active; the first registered one starts as active."""

    def __init__(self):
        self.graphs: dict[str, tuple[PropertyGraph, str, str]] = {}
        self.active: str | None = None

    def unique_name(self, name: str) -> str:
        n, out = 1, name
        while out in self.graphs:
            n += 1
            out = f"{name}_{n}"
        return out

    def register(self, name: str, graph: PropertyGraph, graph_type: str = "", label: str = "") -> str:
        self.graphs[name] = (graph, canonical_format(graph_type) if graph_type else "", label or name)
        self.active = self.active or name
        return name

    def switch(self, name: str) -> PropertyGraph:
        if name not in self.graphs:
            raise KeyError(name)
        self.active = name
        return self.graphs[name][0]

    def listed(self) -> list[dict]:
        return [{"name": n, "label": label, "graph_type": kind, "active": n == self.active, "indexes": g.list_indexes()} for n, (g, kind, label) in self.graphs.items()]


def new_session_id() -> str:
    return uuid.uuid4().hex[:12]
