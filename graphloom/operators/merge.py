"""Entity resolution and merging: triples to nodes and edges, first and last wins, append-unique."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import content_id, first_present, norm_key, present, strip
from graphloom.operators.graph import first_wins

DEFAULT_RELATION = "related"


def parsed_triples(text: Column) -> Column:
    """Triples (head, relation, tail) of ``(h; r; t)(h; r; t)``; each needs a head and a tail."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)\((.*?)\)"), F.lit(1))
    parts = F.transform(bodies, lambda b: F.transform(F.split(b, ";", 3), lambda p: strip(p)))
    whole = F.filter(parts, lambda p: (F.size(p) == 3) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(2)) != ""))
    return F.transform(whole, lambda p: F.struct(p[0].alias("head"), p[1].alias("relation"), p[2].alias("tail")))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("head", "relation", "tail")]))
def fact_triple(content: pd.Series) -> pd.DataFrame:
    """A fact written as a Python literal of three items; null fields for anything else."""

    def one(raw):
        try:
            value = ast.literal_eval(raw)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return (None, None, None)
        return tuple(map(str, value)) if isinstance(value, (list, tuple)) and len(value) == 3 else (None, None, None)

    return pd.DataFrame([one(x) for x in content], columns=["head", "relation", "tail"])


def append_unique(value: str, order: str) -> Column:
    """Aggregate: distinct non-null values in the order of their first appearance."""
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.array_distinct(F.transform(listed, lambda x: x[value]))


def first_known(value: str, order: str) -> Column:
    """Aggregate: the first non-null value."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def triples_to_graph(triples: DataFrame, prefix: str = "node", *id_parts: Column, normalised: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of triples (head, relation, tail, ord).

    Nodes are merged by normalised text and keep the text first seen; edges by (source, relation,
    target) and carry the normalised relation, or the stripped one, ``related`` where empty.  ``id_parts`` stand before
    the text in what an id is the hash of."""
    clean = triples.select(strip(F.col("head")).alias("head"), strip(F.coalesce("relation", F.lit(""))).alias("relation"), strip(F.col("tail")).alias("tail"), "ord").filter("head != '' and tail != ''")
    node_id = lambda text: content_id(prefix, *id_parts, norm_key(text))
    ends = clean.select(F.explode(F.array(F.struct((F.col("ord") * 2).alias("ord"), F.col("head").alias("text")), F.struct((F.col("ord") * 2 + 1).alias("ord"), F.col("tail").alias("text")))).alias("e")).select(node_id(F.col("e.text")).alias("id"), F.col("e.text").alias("text"), F.col("e.ord").alias("ord"))
    nodes = first_wins(ends, ["id"], "ord")
    edges = clean.select(node_id(F.col("head")).alias("source"), node_id(F.col("tail")).alias("target"), F.coalesce(present(norm_key(F.col("relation")) if normalised else F.col("relation")), F.lit(DEFAULT_RELATION)).alias("relation"), F.col("ord").alias("edge_idx"))
    return nodes, first_wins(edges, ["source", "relation", "target"], "edge_idx")


def merge_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """One edge per (source, relation, target): the largest weight, the first position, ``keep`` appended uniquely."""
    return edges.groupBy("source", "relation", "target").agg(F.max("weight").alias("weight"), F.min("edge_idx").alias("edge_idx"), *[append_unique(c, "edge_idx").alias(f"{c}s") for c in keep])


def resolve_names(names: DataFrame, entities: DataFrame, name: str = "name", prefix: str = "entity") -> DataFrame:
    """``names`` with ``resolved``: the first entity of the same normalised text, else a content id.

    ``entities``: id, text, ord.  ``placeholder`` marks names that no entity has."""
    known = entities.select(norm_key(F.col("text")).alias("_key"), "id", "ord").groupBy("_key").agg(F.min_by("id", "ord").alias("_id"))
    keyed = names.withColumn("_key", norm_key(F.col(name)))
    return keyed.join(known, "_key", "left").withColumns({"placeholder": F.col("_id").isNull(), "resolved": F.coalesce("_id", content_id(prefix, F.col("_key")))}).drop("_key", "_id")


def topology_edges(topology: DataFrame, facts: DataFrame, openie: DataFrame, texts: DataFrame) -> DataFrame:
    """Topology edges (source, target, weight, ord) with a relation.

    The first fact's relation between the two, else the last open-extraction triple's between
    their texts, else ``related``.  ``facts``: source, target, relation, ord.  ``openie``: head,
    relation, tail, ord.  ``texts``: id, text."""
    by_fact = facts.groupBy("source", "target").agg(F.min_by("relation", "ord").alias("_fact"))
    by_text = openie.select(norm_key(F.col("head")).alias("_h"), norm_key(F.col("tail")).alias("_t"), "relation", "ord").groupBy("_h", "_t").agg(F.max_by("relation", "ord").alias("_open"))
    key = texts.select("id", norm_key(F.col("text")).alias("key"))
    named = topology.join(by_fact, ["source", "target"], "left").join(key.select(F.col("id").alias("source"), F.col("key").alias("_h")), "source", "left").join(key.select(F.col("id").alias("target"), F.col("key").alias("_t")), "target", "left")
    return named.join(by_text, ["_h", "_t"], "left").select("source", "target", first_present(F.col("_fact"), F.col("_open"), F.lit(DEFAULT_RELATION)).alias("relation"), "weight", "ord")


def merge_subgraph_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of many graphs merged by (type, normalised text), and the map of local to global ids.

    ``rows``: gid, local_id, type, text, embedding, metadata, ord.  A node without text stays its
    graph's own, ``gid:local``.  The embedding is the first there is; other metadata is the first's."""
    kind = F.coalesce(present(strip(F.col("type"))), F.lit("Entity"))
    key = F.when(norm_key(F.col("text")) != "", content_id("node", F.lower(kind), norm_key(F.col("text")))).otherwise(F.concat_ws(":", "gid", "local_id"))
    keyed = rows.withColumn("id", key).withColumn("type", kind)
    merged = keyed.groupBy("id").agg(
        F.min_by("type", "ord").alias("type"),
        F.min_by("text", "ord").alias("text"),
        first_known("embedding", "ord").alias("embedding"),
        F.min_by("metadata", "ord").alias("metadata"),
        F.min("ord").alias("ord"),
        append_unique("gid", "ord").alias("graph_ids"),
        append_unique("local_id", "ord").alias("original_node_ids"),
    )
    local = keyed.groupBy("gid", "local_id").agg(F.max_by("id", "ord").alias("global_id"))
    return merged, local


def merge_subgraph_edges(rows: DataFrame, local: DataFrame) -> DataFrame:
    """Edges of many graphs with global ends, merged by (source, relation, target).

    ``rows``: gid, source, target (local ids), relation, weight, edge_idx.  Ends that no node row
    declares are ``gid:local``."""
    end = lambda side: local.select("gid", F.col("local_id").alias(side), F.col("global_id").alias(f"_{side}"))
    located = rows.join(end("source"), ["gid", "source"], "left").join(end("target"), ["gid", "target"], "left")
    named = located.select("gid", *[F.coalesce(f"_{s}", F.concat_ws(":", "gid", s)).alias(s) for s in ("source", "target")], "relation", "weight", "edge_idx", F.col("edge_idx").cast("string").alias("original_edge_id"))
    return merge_edges(named.withColumnRenamed("gid", "graph_id"), "graph_id", "original_edge_id")


def chunk_links(mentions: DataFrame) -> DataFrame:
    """``mentions`` and ``mentioned_in`` edges of (chunk_id, entity_id, ord), once per pair and direction."""
    both = mentions.select(F.explode(F.array(F.struct(F.col("chunk_id").alias("source"), F.col("entity_id").alias("target"), F.lit("mentions").alias("relation"), (F.col("ord") * 2).alias("edge_idx")), F.struct(F.col("entity_id").alias("source"), F.col("chunk_id").alias("target"), F.lit("mentioned_in").alias("relation"), (F.col("ord") * 2 + 1).alias("edge_idx")))).alias("e")).select("e.*")
    return first_wins(both, ["source", "target", "relation"], "edge_idx")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Base64 of zlib of little-endian float16 as float lists; null where anything fails."""
    import base64
    import zlib

    import numpy as np

    for series in batches:
        out = []
        for raw in series:
            try:
                out.append(np.frombuffer(zlib.decompress(base64.b64decode(raw)), "<f2").astype("float32").tolist())
            except (TypeError, ValueError, zlib.error):
                out.append(None)
        yield pd.Series(out, dtype=object)


