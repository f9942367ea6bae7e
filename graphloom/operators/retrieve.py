"""Retrieval over a property graph: seeds, expansion, reranked collection and context."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import chunk, first_line, ordered_distinct, strip
from graphloom.operators.graph import PropertyGraph, degrees, out_neighbors
from graphloom.operators.vector import coerced

#: Fixed value: what stands for an empty context.
NO_CONTEXT = "No retrieval context was found."


def error_policy(value) -> str:
    """``fallback`` for fallback and soft, else ``raise``."""
    return "fallback" if str(value or "").strip().lower() in ("fallback", "soft") else "raise"


def embed_query(query: str, embedder: Callable[[str], Sequence[float]] | None, policy: str = "raise") -> list[float]:
    """The query's vector; empty without an embedder or, under the fallback policy, when it fails."""
    if embedder is None:
        return []
    try:
        return [float(x) for x in embedder(query)]
    except Exception as error:
        if error_policy(policy) == "fallback":
            return []
        raise RuntimeError(f"embedding failed: {type(error).__name__}: {error}") from error


def hashed_embedder(dimension: int = 64) -> Callable[[str], list[float]]:
    """A deterministic offline embedder: signed hashes of words, scaled to length 1."""

    def embed(text: str) -> list[float]:
        if not str(text).strip():
            raise ValueError("cannot embed empty text")
        out = np.zeros(dimension)
        for word in str(text).lower().split():
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            out[h % dimension] += 1.0 if h >> 63 else -1.0
        return (out / (np.linalg.norm(out) or 1.0)).tolist()

    return embed


def keyword_seeds(nodes: DataFrame, query: str, top_k: int) -> DataFrame:
    """pos, id, score: nodes whose id and text contain most of the query's words.

    Every word occurrence of the query that is a substring of ``id text`` in lower case is a hit;
    the score is hits by words; ties go to the smaller ord."""
    words = [w.lower() for w in str(query).split()]
    haystack = F.lower(F.concat_ws(" ", "id", F.coalesce("text", F.lit(""))))
    hits = sum((F.contains(haystack, F.lit(w)).cast("int") for w in words), F.lit(0))
    found = nodes.select("id", "ord", hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "ord").limit(max(0, int(top_k)))
    pos = F.row_number().over(Window.orderBy(F.desc("hits"), "ord")) - 1
    return found.select(pos.alias("pos"), "id", (F.col("hits") / F.lit(float(max(1, len(words))))).alias("score"))


def vector_seeds(graph: PropertyGraph, vector: Sequence[float], top_k: int, index_name: str = "node_vector", **options) -> DataFrame:
    """pos, id, score (1 - distance) in rank order."""
    hits = graph.search(index_name, list(vector), top_k, **options)
    return hits.select((F.col("rank") - 1).alias("pos"), "id", (1 - F.col("distance")).alias("score"))


def seeds(graph: PropertyGraph, query: str, vector, top_k: int, index_name: str = "node_vector", **options) -> tuple[DataFrame, str]:
    """Vector seeds, or keyword seeds where there is no vector or no such index; and which they are."""
    known = coerced(vector) if vector is not None else None
    if known and graph.index(index_name) is not None:
        return vector_seeds(graph, known, top_k, index_name, **options), "vector"
    return keyword_seeds(graph.nodes, query, top_k), "keyword"


def one_hop_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Outgoing edges of the seeds in seed order, with every parallel edge: pos, edge_idx, source, target, relation, weight."""
    return edges.join(found.select("pos", F.col("id").alias("source")), "source").select("pos", "edge_idx", "source", "target", "relation", "weight")


def one_hop_nodes(nodes: DataFrame, found: DataFrame, expanded: DataFrame) -> DataFrame:
    """Seeds and then the targets of their edges, each once at its first place: place, id, text, score."""
    own = found.select(F.struct(F.lit(0).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("at"), "id", "score")
    more = expanded.select(F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.col("edge_idx").alias("c")).alias("at"), F.col("target").alias("id"), F.lit(None).cast("double").alias("score"))
    once = own.unionByName(more).groupBy("id").agg(F.min("at").alias("at"), F.max("score").alias("score"))
    ranked = once.join(nodes.select("id", "text"), "id").withColumn("place", F.row_number().over(Window.orderBy("at")) - 1)
    return ranked.select("place", "id", strip(F.coalesce("text", F.lit(""))).alias("text"), "score")


def context(nodes: DataFrame, place: str = "place") -> DataFrame:
    """One row, chunks: ``[id] text`` of the nodes in order, without repeats and empty texts."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(place), chunk(F.col("id"), F.col("text")).alias("chunk"))))
    return nodes.agg(ordered_distinct(F.filter(F.transform(listed, lambda x: x["chunk"]), lambda c: c.isNotNull())).alias("chunks"))


def prompt(query: Column, chunks: Column, top_k: int = 10) -> Column:
    """The experiment's prompt: the first chunks with text, one per line, and the question."""
    known = F.slice(F.filter(chunks, lambda c: strip(c) != ""), 1, top_k)
    body = F.when(F.size(known) > 0, F.array_join(known, "\n")).otherwise(F.lit(NO_CONTEXT))
    return F.concat(F.lit("Answer the question using the context.\n\nContext:\n"), body, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


# --- multi-stage collection ------------------------------------------------------------------


def candidates(graph: PropertyGraph, retrieved: DataFrame) -> DataFrame:
    """id, degree: out-neighbours of the retrieved (column id) that are nodes and not retrieved."""
    near = out_neighbors(graph, retrieved).select(F.col("target").alias("id")).distinct()
    fresh = near.join(graph.nodes.select("id"), "id", "left_semi").join(retrieved.select("id"), "id", "left_anti")
    return degrees(graph, fresh)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; 0 where the lengths differ or either is null."""
    product = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def stex(graph: PropertyGraph, retrieved: DataFrame, vector: Sequence[float], beta: float = 1.0, rank_mode: str = "constant") -> DataFrame:
    """id, degree, adjacent, gs_score of every candidate: beta * (rank + bridge) + similarity.

    rank: 1 - (best - 1) / (r_max - 1), where best is r_max + 1 throughout, or with
    ``rank_mode="position"`` the smallest position (from 1) of an adjacent retrieved node.
    bridge: (adjacent - 1) / (min(degree, r_max) - 1).  Both are 0 where they would divide by 0.
    ``retrieved``: id, and pos for the position mode."""
    r_max = retrieved.agg(F.count("*").alias("r_max"))
    best = F.min(F.col("pos") + 1) if rank_mode == "position" else F.max(F.lit(0))
    near = out_neighbors(graph, retrieved).join(retrieved.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("adjacent"), best.cast("double").alias("best"))
    # One row: the number of retrieved nodes.
    rows = candidates(graph, retrieved).join(near, "id").join(graph.nodes.select("id", "embedding"), "id").join(F.broadcast(r_max), F.lit(True))
    first = F.col("best") if rank_mode == "position" else F.col("r_max") + 1.0
    rank = F.when(F.col("r_max") > 1, 1.0 - (first - 1.0) / (F.col("r_max") - 1.0)).otherwise(0.0)
    most = F.least("degree", "r_max")
    bridge = F.when(most > 1, (F.col("adjacent") - 1.0) / (most - 1.0)).otherwise(0.0)
    similar = F.coalesce(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), F.lit(0.0))
    return rows.select("id", "degree", "adjacent", (F.lit(float(beta)) * (rank + bridge) + similar).alias("gs_score"))


class Reranker(ABC):
    """Scores (query, content) pairs; ``features`` may be smoothed over the graph before ``logits``."""

    @abstractmethod
    def features(self, query: str, contents: Sequence[str]) -> np.ndarray: ...

    @abstractmethod
    def logits(self, features: np.ndarray) -> np.ndarray: ...


class LexicalReranker(Reranker):
    """Deterministic and offline: word overlap, coverage and length features under fixed weights."""

    def features(self, query: str, contents: Sequence[str]) -> np.ndarray:
        asked = set(str(query).lower().split())
        out = np.zeros((len(contents), 3))
        for i, content in enumerate(contents):
            words = str(content or "").lower().split()
            have = set(words)
            out[i] = (len(asked & have) / max(1, len(asked)), len(asked & have) / max(1, len(have)), 1.0 / (1.0 + len(words)))
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ np.array([4.0, 2.0, 1.0]) - 1.0


def smoothed(features: DataFrame, edges: DataFrame, alpha: float = 0.7) -> DataFrame:
    """id, features: (1 - alpha) * F + alpha * mean of F over a node itself and its distinct out-neighbours among the rows."""
    inside = edges.select("source", "target").distinct().join(features.select(F.col("id").alias("source")), "source", "left_semi").join(features.select(F.col("id").alias("target")), "target", "left_semi").filter("source != target")
    links = inside.unionByName(features.select(F.col("id").alias("source"), F.col("id").alias("target")))
    parts = links.join(features.select(F.col("id").alias("target"), F.posexplode("features").alias("i", "x")), "target").groupBy(F.col("source").alias("id"), "i").agg(F.avg("x").alias("mean"))
    own = features.select("id", F.posexplode("features").alias("i", "x"))
    mixed = own.join(parts, ["id", "i"]).withColumn("y", F.lit(1.0 - alpha) * F.col("x") + F.lit(alpha) * F.col("mean"))
    return mixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("v")).select("id", F.transform("v", lambda e: e["y"]).alias("features"))


SLIDE = 10


def collect(graph: PropertyGraph, query: str, vector: Sequence[float], hits: DataFrame, reranker: Reranker, *, gcn: bool = False, gcn_alpha: float = 0.7, beta: float = 1.0, rank_mode: str = "constant") -> DataFrame:
    """id, title, text, score, probability, origin (VS or GS), gs_score, place: hits grown over the graph.

    The first ``SLIDE`` hits are scored; then rounds add the best candidates by ``stex`` and score
    all again, until there are as many as hits or no candidate is left.  A round's retrieved set
    is bounded by the number of hits, so it lives on the driver; candidates are found and scored
    as plans over the whole graph."""
    spark = graph.nodes.sparkSession
    start = hits.orderBy("pos").select("id", "text").collect()
    most = len(start)
    rows = [{"id": r["id"], "text": r["text"] or "", "origin": "VS", "gs_score": None} for r in start[:SLIDE]]

    def score() -> None:
        if not rows:
            return
        values = reranker.features(query, [r["text"] for r in rows])
        if gcn and len(rows) > 1:
            frame = spark.createDataFrame([(r["id"], v.tolist()) for r, v in zip(rows, values, strict=True)], "id string, features array<double>")
            even = {r["id"]: r["features"] for r in smoothed(frame, graph.edges, gcn_alpha).collect()}
            values = np.array([even[r["id"]] for r in rows])
        for r, x in zip(rows, reranker.logits(values).tolist(), strict=True):
            r["score"], r["probability"] = x, 1.0 / (1.0 + float(np.exp(-x)))
        rows.sort(key=lambda r: -r["score"])

    score()
    while len(rows) < most:
        held = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "pos long, id string")
        best = stex(graph, held, vector, beta, rank_mode).orderBy(F.desc("gs_score"), "degree", "id").limit(min(SLIDE, most - len(rows)))
        found = best.join(graph.nodes.select("id", "text"), "id").orderBy(F.desc("gs_score"), "degree", "id").collect()
        if not found:
            break
        rows += [{"id": r["id"], "text": r["text"] or "", "origin": "GS", "gs_score": r["gs_score"]} for r in found]
        score()
    return spark.createDataFrame([(i, r["id"], r["text"], r["score"], r["probability"], r["origin"], r["gs_score"]) for i, r in enumerate(rows)], "place long, id string, text string, score double, probability double, origin string, gs_score double")


# --- retrievers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Retrieval:
    """What a retriever found, as frames: seeds, nodes (place, id, text, score), edges and one row of chunks."""

    method: str
    query: str
    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame | None
    chunks: DataFrame
    metadata: dict = field(default_factory=dict)


class Retriever(ABC):
    name = ""

    @abstractmethod
    def retrieve(self, graph: PropertyGraph, query: str, *, vector=None, top_k: int = 5, index_name: str = "node_vector", **options) -> Retrieval: ...


class VectorRetriever(Retriever):
    """Seeds joined to their nodes; without a vector or index, keyword seeds."""

    name = "vector"

    def retrieve(self, graph, query, *, vector=None, top_k=5, index_name="node_vector", **options):
        found, kind = seeds(graph, query, vector, top_k if top_k > 0 else 1, index_name, **options)
        nodes = found.join(graph.nodes.select("id", "text"), "id").select(F.col("pos").alias("place"), "id", strip(F.coalesce("text", F.lit(""))).alias("text"), "score")
        return Retrieval(self.name, query, found, nodes, None, context(nodes), {"seeds": kind, "keyword_fallback_used": kind == "keyword"})


class OneHopRetriever(Retriever):
    """Seeds and the targets of all their outgoing edges."""

    name = "one-hop"

    def retrieve(self, graph, query, *, vector=None, top_k=5, index_name="node_vector", **options):
        found, kind = seeds(graph, query, vector, top_k if top_k > 0 else 1, index_name, **options)
        expanded = one_hop_edges(graph.edges, found)
        nodes = one_hop_nodes(graph.nodes, found, expanded)
        return Retrieval(self.name, query, found, nodes, expanded, context(nodes), {"seeds": kind, "keyword_fallback_used": kind == "keyword"})


class HybridRetriever(Retriever):
    name = "hybrid"

    def retrieve(self, graph, query, **options):
        raise NotImplementedError("hybrid retrieval is not defined")


class CollectingRetriever(Retriever):
    """Vector hits, graph collection and reranking; only ``final_top_k`` cuts the result."""

    name = "collect"

    def __init__(self, reranker: Reranker | None = None):
        self.reranker = reranker or LexicalReranker()

    def retrieve(self, graph, query, *, vector=None, top_k=5, index_name="node_vector", seed_top_k=10, diving_top_k=100, final_top_k=10, attribute_bundle=False, **options):
        positive = lambda v, d: v if isinstance(v, int) and v > 0 else d
        keys = {k: options.pop(k) for k in ("gcn", "gcn_alpha", "beta", "rank_mode") if k in options}
        hits = graph.search(index_name, coerced(vector) or [], positive(diving_top_k, 100), **options)
        content = hits.join(graph.nodes.select("id", "text"), "id", "left").select((F.col("rank") - 1).alias("pos"), (first_line(F.coalesce("document", "text")) if attribute_bundle else F.col("id")).alias("id"), F.coalesce("document", "text").alias("text"), "distance")
        rows = collect(graph, query, vector or [], content, self.reranker, **keys)
        nodes = rows.filter(F.col("place") < positive(final_top_k, 10))
        shown = content.filter(F.col("pos") < positive(seed_top_k, 10)).select("pos", "id", (1 - F.col("distance")).alias("score"))
        return Retrieval(self.name, query, shown, nodes, None, context(nodes), {"top_k": top_k, "origins": nodes.groupBy("origin").count()})
