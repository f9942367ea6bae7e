"""Chat over a graph: retriever choice, retrieval, prompt, answer and timings."""

from __future__ import annotations

import time
from collections.abc import Callable

from graphloom.operators import retrieve as R
from graphloom.operators.chat import RETRIEVERS


class GraphPipeline:
    """Runs one request: retrieval is a plan, its chunks are collected, the generator writes the answer."""

    def __init__(self, retrievers: dict[str, R.Retriever] | None = None, embedder: Callable | None = None, generator: Callable[[str, list, list], str] | None = None):
        self.retrievers = retrievers or {r.name: r for r in (R.OneHopRetriever(), R.VectorRetriever(), R.CollectingRetriever(), R.HybridRetriever())}
        self.embedder = embedder
        self.generator = generator or (lambda question, history, chunks: "\n".join(chunks))

    def run(self, graph, request: dict) -> dict:
        begun = time.perf_counter()
        name = RETRIEVERS.get(str(request.get("retrieval", "one-hop")).strip().lower(), "one-hop")
        vector = R.embed_query(request["message"], self.embedder, request.get("embedding_error_policy", "raise"))
        found = self.retrievers[name].retrieve(graph, request["message"], vector=vector, top_k=request.get("top_k", 5), index_name=request.get("index_name", "node_vector"))
        chunks = found.chunks.first()["chunks"]
        retrieved = time.perf_counter()
        answer = self.generator(request["message"], request.get("history", []), chunks or [R.NO_CONTEXT])
        done = time.perf_counter()
        ms = lambda a, b: round((b - a) * 1000, 2)
        return {"answer": answer, "retrieval": name, "chunks": chunks, "nodes": [r.asDict() for r in found.nodes.orderBy("place").collect()], "metadata": {"retrieval_elapsed_ms": ms(begun, retrieved), "generation_elapsed_ms": ms(retrieved, done), "total_elapsed_ms": ms(begun, done)}}


def experiment(graphs: dict, retrievers: list[str], queries: list[str], pipeline: GraphPipeline, top_k: int = 10) -> list[dict]:
    """Every graph with every retriever and query; a failure becomes an ``ERROR:`` answer."""
    out = []
    for graph_name, graph in graphs.items():
        for retriever in retrievers:
            for query in queries:
                try:
                    answer = pipeline.run(graph, {"message": query, "retrieval": retriever, "top_k": top_k})["answer"]
                except Exception as error:
                    answer = f"ERROR: {type(error).__name__}: {error}"
                out.append({"graph": graph_name, "retriever": retriever, "query": query, "outputs": answer})
    return out
