"""Traced retrieval: the same contexts as untraced, exact events, and no plan run twice."""

import random

import numpy as np
import pytest

from graphloom.operators import batch as Q
from graphloom.operators import graph as G
from graphloom.operators.vector import VectorIndex
from graphloom.streaming import sessions as S
from graphloom.streaming import trace as TR


def test_trace(spark):
    rng = random.Random(3)
    links = [(i, f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", "r") for i in range(120)]
    links += [(200 + i, "n00", f"n{i % 30:02d}", "hub") for i in range(400)]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = G.cut(G.as_nodes(spark.createDataFrame([(i, f"n{i:02d}", None if i % 7 == 3 else f"cat {i}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)], "ord long, id string, text string, embedding array<float>")))
    edges = G.cut(G.as_edges(spark.createDataFrame(links, "edge_idx long, source string, target string, relation string")))
    index = VectorIndex(n.selectExpr("id", "text as document", "metadata", "embedding", "ord"))
    graph = G.PropertyGraph(n, edges.mapInArrow(counting, edges.schema)).attach("node_vector", index)
    asked = spark.createDataFrame([(q, "words", np.random.default_rng(q).uniform(-1, 1, 4).tolist()) for q in range(4)] + [(9, "zebra", None)], "query_id long, query string, vector array<double>")
    want = {r["query_id"]: r["chunks"] for r in Q.retrieved(G.PropertyGraph(n, edges, graph.indexes), asked, "one-hop", top_k=3).collect()}

    read.value = 0
    contexts, trace = TR.one_hop(graph, asked, top_k=3)
    assert read.value == len(links)
    events = TR.one_hop_events(trace, asked.selectExpr("query_id", "concat('s', query_id) as session_id"))
    got = {(r["session_id"], r["event_id"]): r for r in events.collect()}
    assert {r["query_id"]: r["chunks"] for r in contexts.collect()} == want
    folded = {(r["session_id"], r["event_id"]): r for r in S.folded(events).collect()}
    assert read.value == len(links)  # neither events nor contexts read the edges again

    seeds = {q: [r["id"] for r in trace.rows["seeds"].filter(f"query_id = {q}").orderBy("pos").collect()] for q in (0, 1, 2, 3, 9)}
    assert trace.totals() == {name: rows.count() for name, rows in trace.rows.items()}
    for q, ids in seeds.items():
        assert len(ids) == (0 if q == 9 else 3)
        assert [x["id"] for x in got[f"s{q}", 1]["nodes"]] == ids
        out = sum(s in ids for _, s, _, _ in links)
        assert got[f"s{q}", 4]["progress"]["message"] == f"Edges: {out}"
        assert got[f"s{q}", 6]["progress"]["message"] == f"Retrieval complete: {len(got[f's{q}', 5]['nodes'])}"
        assert len(want[q]) <= len(got[f"s{q}", 5]["nodes"]) <= Q.MOST_CHUNKS
        assert folded[f"s{q}", 6]["revision"] == 5 and folded[f"s{q}", 6]["current"] == 3 and folded[f"s{q}", 6]["total"] == 3
    assert {r["stage"] for r in S.folded(events.filter("event_id = 6")).select(S.stage("message").alias("stage")).collect()} == {"retrieved"}
    with pytest.raises(ValueError):
        trace.stage("seeds", asked)
