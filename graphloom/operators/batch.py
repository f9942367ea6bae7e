"""Retrieval for a table of queries: every step is one plan keyed by query_id.

``queries``: query_id, query (text), vector (may be missing).  Found nodes are cut to the best of
each query before they are numbered or listed, so a hub's neighbours never lie in one list; Spark
applies that cut on both sides of the shuffle.  What fails for a query becomes its ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import chunk, ordered_distinct, strip
from graphloom.operators.graph import PropertyGraph, cut
from graphloom.operators.retrieve import NO_CONTEXT, SLIDE, HybridRetriever, LexicalReranker, Reranker, dot, error_policy
from graphloom.operators.textindex import TrigramIndex

#: Nodes that a query's context takes, at most.
MOST_CHUNKS = 10


def embedded(queries: DataFrame, embedder: Callable[[str], Sequence[float]], policy: str = "raise") -> DataFrame:
    """``queries`` (query_id, query) with vector and error: a query that cannot be embedded has no vector, and under the raise policy an error."""
    strict = error_policy(policy) == "raise"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, errors = [], []
            for query in batch.column("query").to_pylist():
                try:
                    vectors.append([float(x) for x in embedder(query)])
                    errors.append(None)
                except Exception as error:
                    vectors.append(None)
                    errors.append(f"ERROR: {type(error).__name__}: {error}" if strict else None)
            yield pa.record_batch([batch.column("query_id"), batch.column("query"), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["query_id", "query", "vector", "error"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, query string, vector array<double>, error string")


def best(rows: DataFrame, most: int, *order: Column, name: str = "place") -> DataFrame:
    """The first ``most`` rows of each query in the order, numbered from 0."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn(name, rank).filter(F.col(name) <= most).withColumn(name, F.col(name) - 1)


def seeds(graph: PropertyGraph, queries: DataFrame, top_k: int, index_name: str = "node_vector", texts: TrigramIndex | None = None) -> DataFrame:
    """query_id, pos, id, score, kind: vector seeds of the queries with a vector, where the index is attached; keyword seeds of the others.

    ``texts``: the index for keywords; made of the graph's nodes if it is not given but needed."""
    index = graph.index(index_name)
    has_vector = F.col("vector").isNotNull() & (F.size("vector") > 0) if index is not None and "vector" in queries.columns else F.lit(False)
    found = []
    if index is not None and "vector" in queries.columns:
        hits = index.search(queries.filter(has_vector).select("query_id", "vector"), top_k)
        found.append(hits.select("query_id", (F.col("rank") - 1).alias("pos"), "id", (1 - F.col("distance")).alias("score"), F.lit("vector").alias("kind")))
    asked = queries.filter(~has_vector).select("query_id", "query")
    if not found or not asked.isEmpty():
        words = (texts or TrigramIndex.build(graph.nodes)).search(asked, top_k)
        found.append(words.select("query_id", "pos", "id", "score", F.lit("keyword").alias("kind")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def one_hop_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Outgoing edges of the seeds with every parallel edge: query_id, pos, edge_idx, source, target, relation, weight."""
    return edges.join(found.select("query_id", "pos", F.col("id").alias("source")), "source").select("query_id", "pos", "edge_idx", "source", "target", "relation", "weight")


def one_hop_nodes(nodes: DataFrame, found: DataFrame, expanded: DataFrame, most: int) -> DataFrame:
    """query_id, place, id, text, score: seeds, then the targets of their edges, each once at its first place; the first ``most`` of each query."""
    at = lambda step, pos, edge: F.struct(F.lit(step).alias("a"), pos.cast("long").alias("b"), edge.cast("long").alias("c")).alias("at")
    own = found.select("query_id", "id", at(0, F.col("pos"), F.lit(0)), "score")
    more = expanded.select("query_id", F.col("target").alias("id"), at(1, F.col("pos"), F.col("edge_idx")), F.lit(None).cast("double").alias("score"))
    once = own.unionByName(more).groupBy("query_id", "id").agg(F.min("at").alias("at"), F.max("score").alias("score"))
    known = once.join(nodes.select("id", "text"), "id")
    return best(known, most, F.col("at")).select("query_id", "place", "id", strip(F.coalesce("text", F.lit(""))).alias("text"), "score")


def contexts(queries: DataFrame, nodes: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """query_id, chunks of every query: ``[id] text`` of its first nodes with text, without repeats."""
    said = nodes.select("query_id", "place", chunk(F.col("id"), F.col("text")).alias("chunk")).filter("chunk is not null")
    first = said.groupBy("query_id", "chunk").agg(F.min("place").alias("place"))
    listed = best(first, most, F.col("place")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("l"))
    chunks = ordered_distinct(F.transform("l", lambda x: x["chunk"]))
    return queries.select("query_id").join(listed, "query_id", "left").select("query_id", F.coalesce(chunks, F.array().cast("array<string>")).alias("chunks"))


# --- collection in rounds ------------------------------------------------------------------------


def collect(graph: PropertyGraph, queries: DataFrame, hits: DataFrame, reranker: Reranker | None = None, *, gcn: bool = False, gcn_alpha: float = 0.7, beta: float = 1.0) -> DataFrame:
    """query_id, place, id, text, score, probability, origin (VS or GS), gs_score: the hits of every query grown over the graph.

    ``queries``: query_id, query, vector.  ``hits``: query_id, pos, id, text.  A query begins with its
    first ``SLIDE`` hits; a round adds its best candidates until it has as many nodes as it had
    hits, or no candidate is left.  A round takes all open queries at once: it joins only the
    nodes that the last round added with the edges, adds them to the counts of adjacent nodes,
    and is written, so plans do not grow.  Rounds are at most the largest number of hits by ``SLIDE``."""
    reranker = reranker or LexicalReranker()
    limits = hits.groupBy("query_id").agg(F.count("*").alias("most"))
    vectors = queries.select("query_id", F.col("vector").alias("asked"))
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id"))
    degree = cut(ends.groupBy("id").agg(F.count("*").alias("degree")))
    start = hits.filter(F.col("pos") < SLIDE)
    held = cut(start.select("query_id", "id", F.col("pos").cast("long").alias("seq"), F.lit("VS").alias("origin"), F.lit(None).cast("double").alias("gs_score")))
    fresh, adjacent = held, None
    while True:
        near = graph.edges.join(fresh.select("query_id", F.col("id").alias("source")), "source").select("query_id", "source", "target").distinct()
        counted = near.groupBy("query_id", F.col("target").alias("id")).agg(F.count("*").alias("adjacent"))
        adjacent = cut(counted if adjacent is None else adjacent.unionByName(counted).groupBy("query_id", "id").agg(F.sum("adjacent").alias("adjacent")))
        sizes = held.groupBy("query_id").agg(F.count("*").alias("r_max")).join(limits, "query_id").filter("r_max < most")
        open_rows = adjacent.join(sizes, "query_id").join(held.select("query_id", "id"), ["query_id", "id"], "left_anti")
        rows = open_rows.join(degree, "id").join(graph.nodes.select("id", "embedding"), "id").join(vectors, "query_id")
        shared = F.least("degree", "r_max")
        rank = F.when(F.col("r_max") > 1, 1.0 - F.col("r_max") / (F.col("r_max") - 1.0)).otherwise(0.0)
        bridge = F.when(shared > 1, (F.col("adjacent") - 1.0) / (shared - 1.0)).otherwise(0.0)
        score = F.lit(float(beta)) * (rank + bridge) + F.coalesce(dot(F.col("embedding"), F.col("asked")), F.lit(0.0))
        scored = rows.select("query_id", "id", "degree", "r_max", "most", score.alias("gs_score"))
        added = best(scored, SLIDE, F.desc("gs_score"), F.col("degree"), F.col("id")).filter(F.col("place") < F.col("most") - F.col("r_max"))
        fresh = cut(added.select("query_id", "id", (F.col("r_max") + F.col("place")).cast("long").alias("seq"), F.lit("GS").alias("origin"), "gs_score"))
        if fresh.isEmpty():
            break
        held = cut(held.unionByName(fresh))
    texts = held.join(graph.nodes.select("id", "text"), "id", "left").join(hits.select("query_id", "id", F.col("text").alias("hit_text")), ["query_id", "id"], "left")
    texts = texts.select("query_id", "id", "seq", "origin", "gs_score", F.coalesce(F.when(F.col("origin") == "VS", F.col("hit_text")).otherwise(F.col("text")), F.lit("")).alias("text")).join(queries.select("query_id", "query"), "query_id")
    if gcn:
        pair = lambda side: held.select("query_id", F.col("id").alias(side))
        inside = graph.edges.select("source", "target").join(pair("source"), "source").join(pair("target"), ["query_id", "target"], "left_semi").filter("source != target")
        texts = texts.join(inside.groupBy("query_id", F.col("source").alias("id")).agg(F.collect_set("target").alias("links")), ["query_id", "id"], "left")
    else:
        texts = texts.withColumn("links", F.lit(None).cast("array<string>"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def rerank(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        ids = table.column("id").to_pylist()
        values = reranker.features(table.column("query")[0].as_py(), table.column("text").to_pylist())
        if gcn and len(ids) > 1:
            at = {i: n for n, i in enumerate(ids)}
            around = [[n, *[at[t] for t in links or []]] for n, links in enumerate(table.column("links").to_pylist())]
            values = (1.0 - gcn_alpha) * values + gcn_alpha * np.array([values[a].mean(0) for a in around])
        scores = np.asarray(reranker.logits(values), float)
        order = np.argsort(-scores, kind="stable")
        out = table.select(["query_id", "id", "text", "origin", "gs_score"]).take(pa.array(order))
        score = scores[order]
        for name, column in (("place", pa.array(range(len(ids)), pa.int64())), ("score", pa.array(score)), ("probability", pa.array(1.0 / (1.0 + np.exp(-score))))):
            out = out.append_column(name, column)
        return out.select(["query_id", "place", "id", "text", "score", "probability", "origin", "gs_score"])

    return texts.groupBy("query_id").applyInArrow(rerank, f"query_id {kind}, place long, id string, text string, score double, probability double, origin string, gs_score double")


# --- retrievers ----------------------------------------------------------------------------------


def _found(graph: PropertyGraph, queries: DataFrame, top_k: int, index_name: str, texts: TrigramIndex | None, method: str, most: int, **options) -> DataFrame:
    top_k = top_k if top_k > 0 else 1
    if method == "collect":
        hits = graph.search(index_name, queries.select("query_id", "vector"), options.pop("diving_top_k", 100))
        content = hits.join(graph.nodes.select("id", "text"), "id", "left").select("query_id", (F.col("rank") - 1).alias("pos"), "id", F.coalesce("document", "text").alias("text"))
        return collect(graph, queries, cut(content), **options).filter(F.col("place") < most)
    found = cut(seeds(graph, queries, top_k, index_name, texts))
    told = graph.nodes.filter(strip(F.col("text")) != "")
    if method == "vector":
        return found.join(told.select("id", "text"), "id").select("query_id", F.col("pos").alias("place"), "id", "text", "score")
    return one_hop_nodes(told, found, one_hop_edges(graph.edges, found), most)


#: Retrievers that answer tables of queries.
METHODS = ("one-hop", "vector", "collect")


def retrieved(graph: PropertyGraph, queries: DataFrame, method: str = "one-hop", *, top_k: int = 5, most: int = MOST_CHUNKS, index_name: str = "node_vector", texts: TrigramIndex | None = None, **options) -> DataFrame:
    """query_id, chunks, error of every query: its context by one of ``METHODS``.  A query that has an error, or neither words nor a vector, is not run.

    ``most``: chunks of a query.  Nodes without text give none and are left out before the cut."""
    if "error" not in queries.columns:
        queries = queries.withColumn("error", F.lit(None).cast("string"))
    if "vector" not in queries.columns:
        queries = queries.withColumn("vector", F.lit(None).cast("array<double>"))
    usable = (strip(F.coalesce("query", F.lit(""))) != "") | (F.coalesce(F.size("vector"), F.lit(0)) > 0)
    queries = queries.withColumn("error", F.coalesce("error", F.when(~usable, "ERROR: ValueError: neither words nor a vector")))
    if method not in METHODS:
        why = "NotImplementedError: hybrid retrieval is not defined" if method == HybridRetriever.name else f"KeyError: {method!r}"
        return queries.select("query_id", F.array().cast("array<string>").alias("chunks"), F.coalesce("error", F.lit(f"ERROR: {why}")).alias("error"))
    good = queries.filter("error is null")
    nodes = _found(graph, good, top_k, index_name, texts, method, most, **options)
    return contexts(queries, nodes, most).join(queries.select("query_id", "error"), "query_id")


def experiment(graphs: Mapping[str, PropertyGraph], methods: Sequence[str], queries: DataFrame, *, top_k: int = 10, answer: Callable[[Column, Column], Column] | None = None, **options) -> DataFrame:
    """graph, retriever, query_id, query, outputs: every graph with every retriever and all queries, in one plan.

    ``answer``: a column expression of question and chunks; by default the chunks, one a line.  A
    query's error is its output."""
    parts = []
    for name, graph in graphs.items():
        for method in methods:
            got = retrieved(graph, queries, method, top_k=top_k, **options).join(queries.select("query_id", "query"), "query_id")
            known = F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(F.array(F.lit(NO_CONTEXT)))
            said = answer(F.col("query"), known) if answer else F.array_join(known, "\n")
            parts.append(got.select(F.lit(name).alias("graph"), F.lit(method).alias("retriever"), "query_id", "query", F.coalesce("error", said).alias("outputs")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
