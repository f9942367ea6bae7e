"""Traces of retrieval: what each stage of a retrieval for a table of queries brought, as session events.

Every stage is written once, with its totals observed while it is written, and the next stage and
the events read what was written: tracing runs no plan a second time.  Lists in events are no
longer than a query's seeds or its context; an expansion, which may pass a hub, is only counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators import batch as Q
from graphloom.operators.graph import PropertyGraph
from graphloom.session import shared_dir
from graphloom.streaming.sessions import progress_events, record_events

#: Stages in order, with what is said of each after its number of rows is known.
STAGES = {"seeds": "Seeds: ", "edges": "Edges: ", "nodes": "Retrieval complete: "}


@dataclass
class Trace:
    """Stages as they were written (``rows``) and their observed totals: rows and distinct queries are exact
    in ``events``; ``totals`` are what the tasks reported, which may count a task twice that was run again."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    observed: dict[str, Observation] = field(default_factory=dict)

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows``, written under the name of their stage."""
        if name in self.rows:
            raise ValueError(f"stage {name} was traced before")
        spark = rows.sparkSession
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        seen = Observation()
        self.rows[name] = rows.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint()
        self.observed[name] = seen
        return self.rows[name]

    def totals(self) -> dict[str, int]:
        return {name: seen.get["rows"] for name, seen in self.observed.items()}

    def events(self, sessions: DataFrame, listed: dict[str, str]) -> DataFrame:
        """Updates of every session (query_id, session_id): what each stage brought and how far the retrieval is.

        ``listed``: for stages whose ids go into an event, the column of their order.  Stage k has the
        events 2k - 1 (its ids, if listed) and 2k (progress k of all).  A query that a stage brought
        nothing has an event with 0 rows."""
        parts = []
        for k, (name, rows) in enumerate(self.rows.items(), 1):
            found = [F.count(F.lit(1)).alias("n")]
            if name in listed:
                found.append(F.array_sort(F.collect_list(F.struct(F.col(listed[name]).alias("at"), "id"))).alias("ids"))
            of = sessions.join(rows.groupBy("query_id").agg(*found), "query_id", "left")
            n = F.coalesce("n", F.lit(0))
            if name in listed:
                ids = F.coalesce(F.transform("ids", lambda x: x["id"].cast("string")), F.array().cast("array<string>"))
                parts.append(record_events(of.select("session_id", F.lit(2 * k - 1).alias("event_id"), ids.alias("node_ids"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("message"))))
            said = F.concat(F.lit(STAGES.get(name, f"{name}: ")), n.cast("string"))
            parts.append(progress_events(of.select("session_id", F.lit(2 * k).alias("event_id"), F.lit(k).alias("current"), F.lit(len(self.rows)).alias("total"), said.alias("message"))))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def one_hop(graph: PropertyGraph, queries: DataFrame, *, top_k: int = 5, most: int = Q.MOST_CHUNKS, index_name: str = "node_vector", **options) -> tuple[DataFrame, Trace]:
    """Contexts of all queries (query_id, chunks), as an untraced one-hop retrieval gives them, and the trace."""
    trace = Trace()
    found = trace.stage("seeds", Q.seeds(graph, queries, max(top_k, 1), index_name, **options))
    edges = trace.stage("edges", Q.one_hop_edges(graph.edges, found))
    told = graph.nodes.filter(strip(F.coalesce("text", F.lit(""))) != "")
    nodes = trace.stage("nodes", Q.one_hop_nodes(told, found, edges, most))
    return Q.contexts(queries, nodes, most), trace


def one_hop_events(trace: Trace, sessions: DataFrame) -> DataFrame:
    """The session events of a traced one-hop retrieval."""
    return trace.events(sessions, {"seeds": "pos", "nodes": "place"})
