"""Lines of an export: what is written where metadata is empty, and what is sorted."""

import json

from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, as_edges, as_nodes
from graphloom.sources import sinks
from graphloom.sources.base import merged_json

TEXTS = ["plain", None, "", 'quote " back \\ slash / é 😀   \x01 \t', "{}"]


def test_lines_say_the_same_without_metadata(spark):
    nodes = as_nodes(spark.createDataFrame([(f"n{i}", t, m, i) for i, t in enumerate(TEXTS) for m in ("{}", None, " {} ", '{"type": 1.50, "k": null}')], "id string, text string, metadata string, ord long"))
    edges = as_edges(spark.createDataFrame([("a", "b", w, m, i) for i, w in enumerate([1.0, 17.0, 0.1, 1e-9, 1e22, -0.0, 123456789.125, None]) for m in ("{}", None, '{"x": 1}')], "source string, target string, weight double, metadata string, edge_idx long"))
    for rows, made, fields in ((nodes, sinks.node_lines(nodes), ("id", "text", "type")), (edges, sinks.edge_lines(edges), ("source", "target", "relation", "weight"))):
        before = rows.select(merged_json(F.to_json(F.struct(*fields)), F.col("metadata")))
        want, got = ([json.loads(r[0]) for r in x.collect()] for x in (before, made.select("value")))
        assert got == want and [list(x) for x in got] == [list(x) for x in want]


def test_the_sort_does_not_make_lines(spark, tmp_path, monkeypatch):
    """Lines are made after the sort, which looks at its rows twice."""
    seen = []
    real = sinks.edge_lines
    monkeypatch.setattr(sinks, "edge_lines", lambda edges, lossy=False: seen.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges, lossy))
    edges = as_edges(spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "source string, target string, weight double"))
    sinks.export(PropertyGraph(as_nodes(spark.createDataFrame([("a",)], "id string")), edges), str(tmp_path / "x"))
    assert seen[0].startswith("Sort [edge_idx")
