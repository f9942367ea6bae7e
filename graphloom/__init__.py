"""Property-graph retrieval analytics as PySpark DataFrame plans.

The names in ``__all__`` are the public ones.  They are imported when first used, so that Python
workers which only need a helper of one module load nothing else.
"""

from importlib import import_module as _import_module

_PUBLIC = {
    "graphloom.session": ("build_session", "shared_dir", "table"),
    "graphloom.operators.graph": ("GraphRegistry", "PropertyGraph", "adjacency", "as_edges", "as_nodes", "closed", "degrees", "incident", "induced", "k_hop"),
    "graphloom.operators.vector": ("VectorIndex", "backfilled"),
    "graphloom.operators.textindex": ("TrigramIndex",),
    "graphloom.operators.retrieve": ("CollectingRetriever", "HybridRetriever", "LexicalReranker", "OneHopRetriever", "Reranker", "Retrieval", "Retriever", "VectorRetriever"),
    "graphloom.operators.batch": ("collect", "contexts", "embedded", "experiment", "retrieved"),
    "graphloom.operators.models": ("EmbeddingService", "generated", "reranked"),
    "graphloom.plans.pipeline": ("GraphPipeline",),
    "graphloom.sources.base": ("GraphSource", "GraphSourceError", "UnsupportedSourceError"),
    "graphloom.sources.formats": ("read_graph",),
    "graphloom.sources.sinks": ("export", "save", "write_batch"),
    "graphloom.sources.vectorstore": ("VectorStore",),
    "graphloom.streaming.sessions": ("folded", "progress_events", "record_events", "search_events"),
    "graphloom.streaming.trace": ("Trace",),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(_import_module(_HOME[name]), name)


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
