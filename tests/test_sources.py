"""Small files of every format."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.sources import files, sinks
from graphloom.sources.formats import SOURCES, read_graph
from graphloom.sources.base import UnsupportedSourceError


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))


def shown(graph):
    nodes = [(r["id"], r["type"], r["text"]) for r in graph.nodes.orderBy("ord").collect()]
    edges = sorted((r["source"], r["relation"], r["target"], r["weight"]) for r in graph.edges.collect())
    return nodes, edges


def test_component(spark, tmp_path):
    lines(tmp_path / "nodes.jsonl", [{"id": "d1", "text": "alpha", "lang": "en"}, "", {"text": "no id"}, {"id": 2}, {"id": "d1", "text": "beta"}])
    lines(tmp_path / "edges.jsonl", [["d1", "2"], {"src": "d1", "target": "x", "weight": 9}, ["d1"]])
    nodes, edges = shown(read_graph(spark, "component", str(tmp_path), keep_source_reference=True))
    assert nodes[:2] == [("d1", "Chunk", "beta"), ("2", "Chunk", None)] and ("x", "Entity", None) in nodes
    assert edges == [("d1", "", "2", 1.0), ("d1", "", "x", 1.0)]
    assert SOURCES["component_graph"].can_read(str(tmp_path)) and not SOURCES["component_graph"].can_read(5)


def test_attribute_bundle(spark, tmp_path):
    good = base64.b64encode(zlib.compress(np.array([1, 2], "<f2").tobytes())).decode()
    (tmp_path / "vdb_entities.json").write_text(json.dumps({"data": [{"id": "", "__id__": "e1", "content": "x", "__vector__": good, "k": 1}, {"id": "e2", "vector": "bad"}, "skip"]}))
    (tmp_path / "vdb_relationships.json").write_text(json.dumps({"data": [{"src_id": "e1", "tgt_id": "e2", "weight": "abc"}, {"src_id": "e1"}, {"source": "e2", "target": "new", "relation": "R", "weight": 2}], "matrix": [[1.0, 0.0]]}))
    g = read_graph(spark, "attribute_bundle", str(tmp_path))
    nodes, edges = shown(g)
    assert {n[0] for n in nodes} == {"e1", "e2", "new"} and edges == [("e1", "RELATED", "e2", 1.0), ("e2", "R", "new", 2.0)]
    vectors = {r["id"]: r["embedding"] for r in g.nodes.collect()}
    assert vectors["e1"] == [1.0, 2.0] and vectors["e2"] is None
    assert json.loads(g.node("e1").first()["metadata"]) == {"k": 1}
    assert g.search("node_vector", [1.0, 2.0], 1).first()["id"] == "e1" and g.list_indexes() == ["edge_vector", "node_vector"]


def test_topology(spark, tmp_path):
    work = tmp_path / "work"
    for name, rows in (("entity", [("e1", "Alice"), ("e2", "alice"), ("e3", "Bob")]), ("fact", [("f1", "('alice', 'knows', 'bob')"), ("f2", "('bob', 'sees', 'carol')"), ("f3", "(1, 2)"), ("f4", "('alice', 'knows', 'bob')")])):
        folder = work / f"{name}_embeddings"
        folder.mkdir(parents=True)
        spark.createDataFrame([(i, c, [1.0, 0.0]) for i, c in rows], "hash_id string, content string, embedding array<float>").coalesce(1).write.parquet(str(folder / f"vdb_{name}.parquet"))
    spark.createDataFrame([("e1", "e3", 5.0), ("e3", "e1", 2.0)], "src string, dst string, weight double").write.parquet(str(work / "topology.parquet"))
    (tmp_path / "openie_results_ner_x.json").write_text(json.dumps({"docs": [{"idx": "c", "passage": "p", "extracted_entities": ["Alice", " "], "extracted_triples": [["Bob", "old", "Alice"], ["bob", "likes", "ALICE"], ["x", "y"]]}]}))
    nodes, edges = shown(read_graph(spark, "topology-semantic", str(tmp_path)))
    assert [n[0] for n in nodes[:3]] == ["e1", "e2", "e3"] and nodes[3][2] == "carol"
    assert ("e1", "knows", "e3", 5.0) in edges and ("e3", "likes", "e1", 2.0) in edges and len(edges) == 3
    only = read_graph(spark, "openie", str(tmp_path))
    assert only.edges.count() == 2 and only.nodes.count() == 2


def test_subgraph_union(spark, tmp_path):
    for part in ("nodes", "edges"):
        (tmp_path / part).mkdir()
    (tmp_path / "nodes/0.csv").write_text('node_id,node_attr\n0,"red, Cube"\n1,\n')
    (tmp_path / "nodes/1.csv").write_text("node_id,node_attr\n7,RED,  cube\n7,red,  cube\n".replace("RED,  cube", '"RED,  cube"').replace("red,  cube", '"red,  cube"'))
    (tmp_path / "nodes/9.csv").write_text("node_id,node_attr\n0,alone\n")
    (tmp_path / "edges/0.csv").write_text("src,edge_attr,dst,weight\n0,on,1,2\n0,on,1,5\n")
    (tmp_path / "edges/1.csv").write_text("src,edge_attr,dst\n7,on,8\n")
    spark.createDataFrame([("1", "x", 0, [0.5])], "gid string, kind string, row_idx long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    g = read_graph(spark, "subgraph union", str(tmp_path))
    nodes, edges = shown(g)
    assert {n[0] for n in nodes} >= {"0:1", "1:8"} and len(nodes) == 3
    cube = next(r for r in g.nodes.collect() if r["text"])
    assert cube["text"] == "red, Cube" and cube["embedding"] == [0.5] and json.loads(cube["metadata"])["graph_ids"] == ["0", "1"]
    assert sorted(e[3] for e in edges) == [1.0, 5.0]
    assert read_graph(spark, "subgraph_union", str(tmp_path), graph_id="1").edges.count() == 1


def test_triples(spark, tmp_path):
    (tmp_path / "train_dev.tsv").write_text("id\tgraph\n1\t(A; ; b)(a; x; B)\n2\t(a; X; b)\n3\t\n")
    nodes, edges = shown(read_graph(spark, "expla_graphs", str(tmp_path)))
    assert sorted(n[2] for n in nodes) == ["A", "b"] and sorted(e[1] for e in edges) == ["related", "x"]
    spark.createDataFrame([([["a", "r", "b"], ["a", "b"], ["a", "r", " "]],)], "graph array<array<string>>").write.parquet(str(tmp_path / "train.parquet"))
    _, edges = shown(read_graph(spark, "freebasekg", str(tmp_path)))
    assert len(edges) == 1


def test_explored_paths(spark, tmp_path):
    rel = lambda head: {"current_relation": {"qid": "Q1", "name": "one", "relation": "r", "head": head}, "right_entity": [{"name": "x", "related_paragraphs": ["p", "p", "q"]}]}
    (tmp_path / "t.json").write_text(json.dumps([{"search_entity_list": [{"depth": 1, "each_relation_right_entityList": [rel(True), rel(False)]}, {"depth": 2, "each_relation_right_entityList": [rel(True)]}]}]))
    g = read_graph(spark, "tog", str(tmp_path / "t.json"))
    nodes, edges = shown(g)
    assert {n[0] for n in nodes} == {"Q1", "name:x"} and [(e[0], e[2]) for e in edges] == [("Q1", "name:x"), ("name:x", "Q1")]
    meta = json.loads(g.edges.filter("source = 'Q1'").first()["metadata"])
    assert meta["depths"] == [1, 2]
    lines(tmp_path / "t.jsonl", [{"search_entity_list": []}, {"other": 1}])
    assert read_graph(spark, "tog", str(tmp_path / "t.jsonl")).nodes.count() == 0


def test_native_and_export(spark, tmp_path):
    lines(tmp_path / "nodes.jsonl", [{"id": "a", "text": "x", "k": [1, 2]}])
    lines(tmp_path / "edges.jsonl", [["a", "b"]])
    g = read_graph(spark, "component", str(tmp_path))
    sinks.save(g, str(tmp_path / "g"))
    again = read_graph(spark, "native", str(tmp_path / "g"))
    assert shown(again) == shown(g)
    with pytest.raises(FileNotFoundError):
        read_graph(spark, "native", str(tmp_path / "none"))
    with pytest.raises(UnsupportedSourceError):
        read_graph(spark, "what", "x")
    report = sinks.export(g, str(tmp_path / "out"), component=True)
    assert (report["nodes"], report["edges"]) == (2, 1) and shown(read_graph(spark, "component", str(tmp_path / "out")))[1] == shown(g)[1]
    with pytest.raises(FileExistsError):
        sinks.export(g, str(tmp_path / "out"))
    more = read_graph(spark, "component", str(tmp_path), into=PropertyGraph.empty(spark), mode="append")
    assert more.nodes.count() == 2


def test_files(spark, tmp_path):
    lines(tmp_path / "q.jsonl", [{"question": " what "}, "", {"other": "that"}, {"n": ""}])
    assert [r["query"] for r in files.queries(spark, str(tmp_path / "q.jsonl")).orderBy("ord").collect()] == ["what", "that"]
    lines(tmp_path / "g_m.jsonl", [{"query": "q", "outputs": "1"}, {"query": "q", "outputs": "2"}])
    assert files.answers(spark, str(tmp_path / "g_m.jsonl")).first()["answer"] == "2"
    with pytest.raises(FileNotFoundError):
        files.answer_files(str(tmp_path))
    lines(tmp_path / "r.jsonl", ["broken", {"custom_id": "judge-000000-for", "response": {"body": {"choices": [{"message": {"content": "c"}}]}}}])
    assert files.judge_results(spark, "p", str(tmp_path / "r.jsonl")).first()["content"] == "c"


def test_nan_is_null_at_any_depth(spark):
    from pyspark.sql import functions as F

    from graphloom.functions.text import json_nan_to_null, nan_to_null

    nan = float("nan")
    frame = spark.createDataFrame([(nan, [1.0, nan], {"a": nan}, (nan, [{"x": nan}]), "s"), (None, None, None, None, None)], "d double, l array<double>, m map<string,double>, s struct<a:double,b:array<map<string,double>>>, t string")
    got = frame.select(*[nan_to_null(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema]).collect()
    assert got[0].asDict(True) == {"d": None, "l": [1.0, None], "m": {"a": None}, "s": {"a": None, "b": [{"x": None}]}, "t": "s"}
    assert got[1].asDict(True) == {"d": None, "l": None, "m": None, "s": None, "t": None}
    texts = ['{"k":NaN,"t":"NaN \\" NaN","l":[NaN, 1]}', '{"NaN":1}', "[NaN]", '"NaN"', None]
    fixed = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_nan_to_null(F.col("t"))).collect()]
    assert fixed == ['{"k":null,"t":"NaN \\" NaN","l":[null, 1]}', '{"NaN":1}', "[null]", '"NaN"', None]


def test_request_metadata_as_one_document(spark, tmp_path):
    import json

    from graphloom.sources import files

    one = {"query": "q", "direction": "reverse", "answer_a_file": "g_b.jsonl", "answer_b_file": "g_a.jsonl", "model_a": "g_b", "model_b": "g_a"}
    (tmp_path / "m.json").write_text(json.dumps({"pair_id": "p", "requests": {"judge-000000-rev": one}}, indent=2))
    got = files.request_metadata(spark, str(tmp_path / "m.json"), document=True).first().asDict()
    assert got == {"custom_id": "judge-000000-rev", "pair_id": "p", **one}


def test_pretty_printed_bundles(spark, tmp_path):
    """A JSON document over many lines is one document."""
    import json

    from graphloom.sources.formats import read_graph

    (tmp_path / "vdb_entities.json").write_text(json.dumps({"data": [{"id": "a", "content": "x", "type": "T", "k": 1}, {"id": "b"}], "matrix": [[1.0], [2.0]]}, indent=2))
    (tmp_path / "vdb_relationships.json").write_text(json.dumps({"data": [{"src_id": "a", "tgt_id": "b"}]}, indent=2))
    graph = read_graph(spark, "attribute_bundle_graph", str(tmp_path))
    got = {r["id"]: r for r in graph.nodes.collect()}
    assert (got["a"]["type"], json.loads(got["a"]["metadata"]), list(got["b"]["embedding"])) == ("T", {"type": "T", "k": 1}, [2.0])
    assert graph.edges.count() == 1


def test_ledger(spark, tmp_path):
    from graphloom.sources import ledger as L

    path = str(tmp_path / "ledger")
    rows = lambda data: spark.createDataFrame(data, "batch_id string, status string, final_outputs_path string")
    L.append(rows([("1", "submitted", "f1"), ("2", "submitted", "f1"), ("3", "submitted", "f2"), ("4", "submitted", "f3")]), path)
    L.append(rows([("1", "completed", None), ("2", "completed", None), ("3", "completed", None)]), path)
    L.append(rows([("3", "failed", None), ("4", "completed", None)]), path)
    state = {r["batch_id"]: (r["status"], r["final_outputs_path"]) for r in L.ledger(spark, path).collect()}
    assert state == {"1": ("completed", "f1"), "2": ("completed", "f1"), "3": ("failed", "f2"), "4": ("completed", "f3")}
    present = spark.createDataFrame([("f3",)], "name string")
    taken = lambda force: sorted((r["final_outputs_path"], r["batch_id"]) for r in L.to_download(L.ledger(spark, path), present, force).collect())
    assert taken(False) == [("f1", "2")] and taken(True) == [("f1", "2"), ("f3", "4")]


def test_result_files_are_taken_once(spark, tmp_path):
    import json

    from graphloom.sources import ledger as L

    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    line = lambda i, c: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": c}}]}}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g a_vs_b_results.jsonl").write_text("\n".join([line("1", "x"), "{broken", line("2", "y")]))
    L.collect_results(spark, folder, table, checkpoint).awaitTermination()
    (tmp_path / "in" / "c_vs_d_results.jsonl").write_text(line("1", "z"))
    L.collect_results(spark, folder, table, checkpoint).awaitTermination()
    L.collect_results(spark, folder, table, checkpoint).awaitTermination()
    assert sorted(tuple(r)[:3] for r in spark.read.schema(L.RESULT).parquet(table).collect()) == [("c_vs_d", "1", "z"), ("g a_vs_b", "1", "x"), ("g a_vs_b", "2", "y")]


def test_upserts_by_copy_on_write(spark, tmp_path):
    from graphloom.sources.vectorstore import ConcurrentUpsert, VectorStore

    store = VectorStore(spark, str(tmp_path / "v"), 8)
    frame = lambda rows: spark.createDataFrame(rows, "id string, vector array<double>, ord long")
    held = lambda v=None: {r["id"]: r["vector"] for r in store.read(v).collect()}
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.upsert(frame([(f"i{k}", [float(k)], 0) for k in range(40)] + [("i1", [9.0], 5), (None, [1.0], 1)])) == 0
    before = held()
    assert len(before) == 40 and before["i1"] == [9.0]
    touched = set((tmp_path / "v" / "data").iterdir())
    assert store.upsert(frame([("i2", [7.0], 0)])) == 1
    new = next(iter(set((tmp_path / "v" / "data").iterdir()) - touched))
    assert len([p for p in new.iterdir() if p.name.startswith("bucket=")]) == 1  # only the touched bucket
    assert held(0) == before and held() == before | {"i2": [7.0]} == held(1)
    # A write that fails, and one that another writer was faster than, leave the last version.
    bad = frame([("i3", [0.0], 0)]).withColumn("vector", F.raise_error(F.lit("lost")).cast("array<double>"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    slow = VectorStore(spark, str(tmp_path / "v"), 8)
    slow.versions = lambda: [0]
    with pytest.raises(ConcurrentUpsert):
        slow.upsert(frame([("i4", [0.0], 0)]))
    assert held() == before | {"i2": [7.0]}
    assert store.upsert(spark.createDataFrame([("z", 1, "t")], "id string, ord long, note string")) == 2
    assert store.read().filter("id = 'z'").first().asDict() == {"id": "z", "vector": None, "note": "t"} and store.read().count() == 41
