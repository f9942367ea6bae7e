"""Queries that write files of every format from the driver's tables and read them back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.judge import answer_pairs, criteria_winners
from graphloom.operators.vector import backfilled, has_value
from graphloom.plans import testbed as B
from graphloom.plans.catalog import JUDGE, KG_EDGES, KG_NODES, RATES, query
from graphloom.session import shared_dir, table
from graphloom.sources import files, ledger as L, sinks
from graphloom.sources.formats import read_graph
from graphloom.sources.vectorstore import VectorStore


def folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads."""
    return f"{shared_dir(spark)}/files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def as_lines(rows: DataFrame, path: str, parts: int | None = None) -> None:
    rows = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) if rows.columns != ["value"] else rows
    (rows.coalesce(parts) if parts else rows).write.text(path)


def shown(graph, *metadata: str) -> DataFrame:
    """Nodes and edges in one table."""
    nodes = graph.nodes.select(F.lit("node").alias("part"), "id", F.col("type").alias("a"), F.col("text").alias("b"), F.lit(None).cast("double").alias("weight"), "metadata")
    edges = graph.edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), F.col("relation").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("weight"), "metadata")
    return nodes.unionByName(edges).withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("""SELECT 'c:' || c_custkey AS id, c_name AS text, 'Customer' AS type,
 '{"key":' || c_custkey || ',"flag":' || (c_nationkey % 2 = 0) || ',"digits":"' || c_custkey || '","list":[' || c_nationkey || ',"x",null,{"in":true}],"none":null}' AS metadata,
 c_nationkey % 2 = 0 AS found FROM customer""")
def metadata_roundtrip(spark, sf_dir):
    """Numbers, booleans, texts, lists, objects and nulls through the reader, the writer and the reader again, and a filter by a boolean."""
    path = folder(spark)
    c = table(spark, sf_dir, "customer")
    value = F.concat(F.lit('{"id":"c:'), "c_custkey", F.lit('","text":"'), "c_name", F.lit('","type":"Customer","key":'), "c_custkey", F.lit(',"flag":'), (F.col("c_nationkey") % 2 == 0).cast("string"), F.lit(',"digits":"'), "c_custkey", F.lit('","list":['), "c_nationkey", F.lit(',"x",null,{"in":true}],"none":null}'))
    as_lines(c.select(value.alias("value")), f"{path}/nodes.jsonl")
    as_lines(spark.createDataFrame([], "value string"), f"{path}/edges.jsonl")
    first = read_graph(spark, "component_graph", path)
    sinks.export(first, f"{path}/out", component=True)
    again = read_graph(spark, "component_graph", f"{path}/out")
    rows = again.nodes.select("id", "text", "type", "metadata")
    return rows.withColumn("found", has_value(F.col("metadata"), "flag", True))


@query("""SELECT 'edge' AS part, 'o:' || l_orderkey AS id, '' AS a, 'p:' || l_partkey AS b, 1.0::DOUBLE AS weight, '{}' AS metadata FROM lineitem UNION ALL
SELECT 'node', 'o:' || o_orderkey, 'Chunk', o_orderpriority, NULL, '{"status":"' || o_orderstatus || '"}' FROM orders UNION ALL
SELECT DISTINCT 'node', 'p:' || l_partkey, 'Entity', NULL, NULL, '{}' FROM lineitem""")
def source_component(spark, sf_dir):
    """Nodes as objects, edges as pairs; parts appear only as ends of edges."""
    path = folder(spark)
    as_lines(table(spark, sf_dir, "orders").select(text("o:", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("status")), f"{path}/nodes.jsonl")
    as_lines(table(spark, sf_dir, "lineitem").select(F.to_json(F.array(text("o:", "l_orderkey"), text("p:", "l_partkey"))).alias("value")), f"{path}/edges.jsonl")
    return shown(read_graph(spark, "component_graph", path))


@query("""SELECT 'node' AS part, 'n:' || n_nationkey AS id, 'Nation' AS a, n_name AS b, NULL::DOUBLE AS weight, '{"type":"Nation","area":' || n_regionkey || '}' AS metadata, n_nationkey::DOUBLE AS v FROM nation UNION ALL
SELECT 'node', 'r:' || r_regionkey, 'Entity', NULL, NULL, '{}', NULL FROM region UNION ALL
SELECT 'edge', 'n:' || n_nationkey, 'RELATED', 'r:' || n_regionkey, 2.0, '{}', NULL FROM nation""")
def source_attribute_bundle(spark, sf_dir):
    """One JSON document of records and one of vectors by position."""
    path = folder(spark)
    n = table(spark, sf_dir, "nation")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("v")))), lambda x: x["v"])
    record = F.struct(text("n:", "n_nationkey").alias("id"), F.col("n_name").alias("content"), F.lit("Nation").alias("type"), F.col("n_regionkey").alias("area"))
    as_lines(n.agg(ordered(record).alias("data"), ordered(F.array(F.col("n_nationkey").cast("float"), F.lit(1.0).cast("float"))).alias("matrix")), f"{path}/vdb_entities.json", 1)
    as_lines(n.agg(ordered(F.struct(text("n:", "n_nationkey").alias("src_id"), text("r:", "n_regionkey").alias("tgt_id"), F.lit("2").alias("weight"))).alias("data")), f"{path}/vdb_relationships.json", 1)
    graph = read_graph(spark, "attribute_bundle_graph", path)
    vectors = graph.nodes.select("id", F.get("embedding", F.lit(0)).cast("double").alias("v")).filter("v is not null")
    return shown(graph).join(vectors.withColumn("part", F.lit("node")), ["part", "id"], "left")


TOPOLOGY = """
ent AS (SELECT 'e' || n_nationkey AS id, n_name AS text, n_nationkey FROM nation),
doc AS (SELECT 'k' || r_regionkey AS chunk, r_regionkey, r_name FROM region),
mention AS (SELECT d.chunk, e.id AS entity FROM doc d JOIN nation n ON n.n_regionkey = d.r_regionkey JOIN ent e USING (n_nationkey) UNION SELECT chunk, 'entity-' || md5('entity of ' || lower(r_name)) FROM doc)"""


@query(f"""WITH {TOPOLOGY}
SELECT 'node' AS part, id, 'Entity' AS a, text AS b, NULL::DOUBLE AS weight, '{{"hash_id":"' || id || '","node_type":"Entity"}}' AS metadata FROM ent UNION ALL
SELECT 'node', chunk, 'Chunk', r_name, NULL, '{{"hash_id":"' || chunk || '","node_type":"Chunk"}}' FROM doc UNION ALL
SELECT 'node', 'entity-' || md5('entity of ' || lower(r_name)), 'Entity', 'Entity of ' || r_name, NULL, '{{"hash_id":"entity-' || md5('entity of ' || lower(r_name)) || '","inferred_from_openie_entity":true}}' FROM doc UNION ALL
SELECT DISTINCT 'node', 'entity-' || md5('earth'), 'Entity', 'earth', NULL, '{{"hash_id":"entity-' || md5('earth') || '","inferred_from_fact":true}}' FROM doc UNION ALL
SELECT 'edge', chunk, 'mentions', entity, 1.0, '{{"source":"openie","openie_passage_id":"' || chunk || '"}}' FROM mention UNION ALL
SELECT 'edge', entity, 'mentioned_in', chunk, 1.0, '{{"source":"openie","openie_passage_id":"' || chunk || '"}}' FROM mention UNION ALL
SELECT 'edge', id, 'Lies on', 'entity-' || md5('earth'), 1.0, '{{"source":"vdb_fact","fact_hash_id":"f' || n_nationkey || '"}}' FROM ent UNION ALL
SELECT 'edge', 'e' || n_nationkey, 'near', 'e' || ((n_nationkey + 1) % 25), 1.0 + n_nationkey, '{{"source":"igraph"}}' FROM nation""")
def source_topology(spark, sf_dir):
    """Entity, chunk and fact stores, passages joined to chunks by their id, and topology edges named by open extraction."""
    path = folder(spark) + "/graphs"
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    store = lambda rows, kind: rows.select("hash_id", "content", F.array(F.lit(0.5)).cast("array<float>").alias("embedding")).write.parquet(f"{path}/{kind}_embeddings/vdb_{kind}.parquet")
    store(n.select(text("e", "n_nationkey").alias("hash_id"), F.col("n_name").alias("content")), "entity")
    store(r.select(text("k", "r_regionkey").alias("hash_id"), F.col("r_name").alias("content")), "chunk")
    store(n.select(text("f", "n_nationkey").alias("hash_id"), F.concat(F.lit("('"), F.lower("n_name"), F.lit("', ' Lies on', 'Earth')")).alias("content")), "fact")
    n.select(text("e", "n_nationkey").alias("src"), F.concat(F.lit("e"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), (F.col("n_nationkey") + 1.0).alias("weight")).write.parquet(f"{path}/topology.parquet")
    names = n.select("n_regionkey", "n_name", F.lead("n_name").over(Window.orderBy("n_nationkey")).alias("_next"))
    first = n.agg(F.min_by("n_name", "n_nationkey")).first()[0]
    listed = names.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("found"), F.collect_list(F.array("n_name", F.lit("near"), F.coalesce("_next", F.lit(first)))).alias("extracted_triples"))
    docs = r.join(listed, F.col("r_regionkey") == F.col("n_regionkey")).select(text("k", "r_regionkey").alias("idx"), F.col("r_name").alias("passage"), F.concat("found", F.array(F.lit(" "), F.concat(F.lit("Entity of "), "r_name"))).alias("extracted_entities"), "extracted_triples")
    # Of two files the last one counts.
    as_lines(docs.limit(0).agg(F.collect_list(F.struct("*")).alias("docs")), path.rsplit("/", 1)[0] + "/openie_results_ner_a.json", 1)
    as_lines(docs.agg(F.collect_list(F.struct("*")).alias("docs")), path.rsplit("/", 1)[0] + "/openie_results_ner_b.json", 1)
    return shown(read_graph(spark, "topology_semantic_graph", path))


@query("""WITH t AS (SELECT n_name AS head, r_name AS tail, 'k' || r_regionkey AS idx, 'About ' || r_name AS passage, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
seen AS (SELECT head AS text, idx, passage FROM t UNION ALL SELECT DISTINCT tail, idx, passage FROM t)
SELECT 'node' AS part, 'entity-' || md5(lower(text)) AS id, 'Entity' AS a, text AS b, NULL::DOUBLE AS weight, '{"inferred_from_openie":true,"original_label":"entity-' || md5(lower(text)) || '","openie_passage_id":"' || idx || '","passage":"' || passage || '"}' AS metadata FROM seen UNION ALL
SELECT 'edge', 'entity-' || md5(lower(head)), 'Part Of', 'entity-' || md5(lower(tail)), 1.0, '{"source":"openie","passage":"' || passage || '","openie_passage_id":"' || idx || '"}' FROM t""")
def source_openie(spark, sf_dir):
    """Only an open-extraction file."""
    path = folder(spark)
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    listed = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    docs = r.join(listed, F.col("r_regionkey") == F.col("n_regionkey")).select(text("k", "r_regionkey").alias("idx"), F.concat(F.lit("About "), "r_name").alias("passage"), F.array().cast("array<string>").alias("extracted_entities"), F.transform("names", lambda x: F.array(x, F.lit(" Part Of "), F.col("r_name"))).alias("extracted_triples"))
    as_lines(docs.agg(F.collect_list(F.struct("*")).alias("docs")), f"{path}/openie_results_ner_x.json", 1)
    return shown(read_graph(spark, "openie", path))


@query("""WITH s AS (SELECT 'node-' || md5('entity|' || lower(s_name)) AS id, s_name, n_name, 'node-' || md5('entity|' || lower(n_name)) AS nid FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nodes AS (SELECT id, s_name AS text FROM s UNION SELECT nid, n_name FROM s)
SELECT 'node' AS part, id, 'Entity' AS a, text AS b, NULL::DOUBLE AS weight, '{"original_label":"' || id || '"}' AS metadata FROM nodes UNION ALL
SELECT 'edge', id, 'lies in', nid, 1.0, '{}' FROM s UNION ALL SELECT 'edge', id, 'related', nid, 1.0, '{}' FROM s""")
def source_triple_text(spark, sf_dir):
    """Triples as text in a table of rows; relations that differ only in case are one."""
    path = folder(spark)
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("1\t("), "s_name", F.lit("; Lies  In ; "), "n_name", F.lit(")("), "s_name", F.lit("; lies in ;"), "n_name", F.lit(")("), F.upper("s_name"), F.lit(";;"), "n_name", F.lit(")"))
    header = spark.range(1).select(F.lit("id\tgraph").alias("value"))
    as_lines(header.unionByName(s.select(row.alias("value"))), f"{path}/train_dev.tsv", 1)
    return shown(read_graph(spark, "expla_graphs", path))


@query("""WITH o AS (SELECT 'node-' || md5('customer ' || o_custkey) AS a, 'node-' || md5('order ' || o_orderkey) AS b, o_custkey, o_orderkey FROM orders)
SELECT DISTINCT 'node' AS part, a AS id, 'Entity' AS a, 'Customer ' || o_custkey AS b, NULL::DOUBLE AS weight, '{}' AS metadata FROM o UNION ALL
SELECT 'node', b, 'Entity', 'Order ' || o_orderkey, NULL, '{}' FROM o UNION ALL SELECT 'edge', a, 'made by', b, 1.0, '{}' FROM o""")
def source_triple_list(spark, sf_dir):
    """Lists of triples in twenty files of three splits."""
    path = folder(spark)
    o = table(spark, sf_dir, "orders")
    triples = o.select(F.array(F.array(text("Customer ", "o_custkey"), F.lit("Made  By"), text("Order ", "o_orderkey")), F.array(F.lit("no"), F.lit("triple"))).alias("graph"), (F.col("o_orderkey") % 20).alias("k"))
    for k in range(20):
        triples.filter(F.col("k") == k).select("graph").write.parquet(f"{path}/{('train', 'validation', 'test')[k % 3]}-{k:02d}.parquet")
    return shown(read_graph(spark, "freebasekg", path))


@query("""WITH s AS (SELECT s_suppkey, 'q' || (s_suppkey % 7) AS qid, s_suppkey % 5 AS depth, row_number() OVER (ORDER BY s_suppkey) - 1 AS record, 'name:n' || s_nationkey AS r FROM supplier),
f AS (SELECT qid, min(s_suppkey) AS k FROM s GROUP BY qid), p AS (SELECT r, min(s_suppkey) AS k, count(*) AS n FROM s GROUP BY r),
x AS (SELECT qid, r, s_suppkey % 2 = 0 AS back, list(DISTINCT record ORDER BY record) AS records, list(depth ORDER BY s_suppkey) AS d FROM s GROUP BY ALL)
SELECT 'node' AS part, qid AS id, 'Entity' AS a, 'Q' AS b, NULL::DOUBLE AS weight, '{"question":"why ' || k || '"}' AS metadata FROM f UNION ALL
SELECT 'node', r, 'Entity', substr(r, 6), NULL, '{"related_paragraphs":' || CASE WHEN n = 1 THEN '"p"}' ELSE '["p"]}' END FROM p UNION ALL
SELECT 'edge', CASE WHEN back THEN r ELSE qid END, 'rel', CASE WHEN back THEN qid ELSE r END, 1.0, '{"record_indices":[' || array_to_string(records, ',') || '],"depths":[' ||
  array_to_string(list_transform(list_filter(d, lambda v, i: list_position(d, v) = i), lambda v: v::VARCHAR), ',') || ']}' FROM x""")
def source_explored_paths(spark, sf_dir):
    """Explored paths, a record a line."""
    path = folder(spark)
    s = table(spark, sf_dir, "supplier")
    right = F.struct(text("n", "s_nationkey").alias("name"), F.lit("p").alias("related_paragraphs"))
    relation = F.struct(F.struct(F.concat(F.lit("q"), (F.col("s_suppkey") % 7).cast("string")).alias("qid"), F.lit("Q").alias("name"), F.lit("rel").alias("relation"), (F.col("s_suppkey") % 2 != 0).alias("head")).alias("current_relation"), F.array(right).alias("right_entity"))
    record = s.orderBy("s_suppkey").select(text("why ", "s_suppkey").alias("question"), F.array(F.struct((F.col("s_suppkey") % 5).cast("int").alias("depth"), F.array(relation).alias("each_relation_right_entityList"))).alias("search_entity_list"))
    as_lines(record, f"{path}/found.jsonl", 1)
    return shown(read_graph(spark, "tog", f"{path}/found.jsonl"))


@query("""WITH n AS (SELECT n_regionkey AS g, n_nationkey AS local, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS text, n_nationkey % 2 = 0 AS even FROM nation),
m AS (SELECT 'node-' || md5('entity|' || lower(text)) AS id, min(text) AS text, list(DISTINCT g ORDER BY g) AS gs, list(local ORDER BY g, local) AS locals FROM n GROUP BY ALL)
SELECT 'node' AS part, id, 'Entity' AS a, text AS b, NULL::DOUBLE AS weight, '{"graph_ids":["' || array_to_string(gs, '","') || '"],"original_node_ids":["' || array_to_string(locals, '","') || '"]}' AS metadata FROM m UNION ALL
SELECT 'node', g || ':99', 'Entity', NULL, NULL, '{}' FROM (SELECT DISTINCT g FROM n) UNION ALL
SELECT 'edge', 'node-' || md5('entity|' || lower(text)), 'in', g || ':99', max(local)::DOUBLE, NULL FROM n GROUP BY g, text""")
def source_subgraph_union(spark, sf_dir):
    """A CSV of nodes and one of edges per region, merged by text; ends without a row are their graph's own."""
    path = folder(spark)
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lit("even")).otherwise(F.col("n_name"))
    for g in range(5):  # five regions
        of = n.filter(F.col("n_regionkey") == g).orderBy("n_nationkey").coalesce(1)
        of.select(F.col("n_nationkey").alias("node_id"), name.alias("node_attr")).write.option("header", True).csv(f"{path}/nodes/{g}.csv")
        of.select(F.col("n_nationkey").alias("src"), F.lit("in").alias("edge_attr"), F.lit(99).alias("dst"), F.col("n_nationkey").alias("weight")).write.option("header", True).csv(f"{path}/edges/{g}.csv")
    out = shown(read_graph(spark, "subgraph_union_graph", path))
    return out.withColumn("metadata", F.when(F.col("part") == "node", F.col("metadata")))


@query(f"""WITH {KG_NODES}, {KG_EDGES} SELECT 'node' AS part, id, type AS a, text AS b, NULL::DOUBLE AS weight, '{{}}' AS metadata FROM kn UNION ALL
SELECT 'edge', source, relation, target, weight, '{{}}' FROM ke""")
def native_roundtrip(spark, sf_dir):
    """A graph saved with all columns and read back."""
    path = folder(spark)
    sinks.save(B.knowledge_graph(spark, sf_dir), f"{path}/g")
    return shown(read_graph(spark, "native", f"{path}/g"))


@query("""SELECT 'edge' AS part, 'o:' || l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS weight, CASE WHEN l_linenumber = 2 THEN '{"k":null,"t":"a NaN, NaN"}' ELSE '{"k":1}' END AS metadata, NULL AS v FROM lineitem UNION ALL
SELECT 'node', 'c:' || c_custkey, NULL, '{"b":' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE c_nationkey || '.0' END || '}', '[' || CASE WHEN c_nationkey = 3 THEN 'null' ELSE c_nationkey || '.0' END || ',1.0]' FROM customer""")
def native_nan(spark, sf_dir):
    """NaN in weights, vectors, and metadata as text and as structs, is null once read."""
    path = folder(spark)
    nan = F.lit(float("nan"))
    own = F.when(F.col("c_nationkey") == 3, nan).otherwise(F.col("c_nationkey").cast("double"))
    table(spark, sf_dir, "customer").select(text("c:", "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.lit(None).cast("string").alias("text"), F.array(own, F.lit(1.0)).alias("embedding"), F.struct(own.alias("b")).alias("metadata")).write.parquet(f"{path}/g_nodes.parquet")
    second = F.col("l_linenumber") == 2
    table(spark, sf_dir, "lineitem").select(text("o:", "l_orderkey").alias("source"), text("p:", "l_partkey").alias("target"), F.lit("r").alias("relation"), F.when(second, nan).otherwise(F.col("l_quantity")).alias("weight"), F.when(second, F.lit('{"k":NaN,"t":"a NaN, NaN"}')).otherwise(F.lit('{"k":1}')).alias("metadata")).write.parquet(f"{path}/g_edges.parquet")
    graph = read_graph(spark, "native", f"{path}/g")
    nodes = graph.nodes.filter("type = 'Customer'").select(F.lit("node").alias("part"), "id", F.lit(None).cast("double").alias("weight"), "metadata", F.to_json(F.col("embedding").cast("array<double>")).alias("v"))
    return nodes.unionByName(graph.edges.select(F.lit("edge").alias("part"), F.col("source").alias("id"), "weight", "metadata", F.lit(None).cast("string").alias("v")))


@query("""SELECT 'n:' || n_nationkey AS text, 'flat' AS graph_ids, n_nationkey::VARCHAR AS original FROM nation UNION ALL SELECT 'c:' || c_custkey, 'flat', (1000 + c_custkey)::VARCHAR FROM customer""")
def source_flat_csv(spark, sf_dir):
    """Just nodes.csv and edges.csv: one graph, named by its folder."""
    path = f"{folder(spark)}/flat"
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("node_id"), text("n:", "n_nationkey").alias("node_attr")).union(c.select((F.col("c_custkey") + 1000).cast("string"), text("c:", "c_custkey")))
    nodes.write.option("header", True).csv(f"{path}/nodes.csv")
    c.select((F.col("c_custkey") + 1000).cast("string").alias("src"), F.lit("in").alias("edge_attr"), F.col("c_nationkey").cast("string").alias("dst")).write.option("header", True).csv(f"{path}/edges.csv")
    read = read_graph(spark, "subgraph_union_graph", path).nodes
    own = lambda k: F.get(F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>"), F.lit(0))
    return read.select("text", own("graph_ids").alias("graph_ids"), own("original_node_ids").alias("original"))


@query(f"WITH {KG_EDGES} SELECT source, target, relation, weight FROM ke")
def export_jsonl_roundtrip(spark, sf_dir):
    """Edges exported as JSON lines and read back from the files."""
    path = folder(spark)
    sinks.export(B.knowledge_graph(spark, sf_dir), path)
    lines = spark.read.text(f"{path}/edges.jsonl")
    return lines.select(F.from_json("value", "source string, target string, relation string, weight string").alias("e")).select("e.source", "e.target", "e.relation", F.col("e.weight").cast("double").alias("weight"))


@query("""WITH d AS (SELECT doc_id, direction, coalesce(text, '') AS own, 'about ' || doc_id AS other FROM documents, (SELECT unnest(['for', 'rev']) AS direction))
SELECT 'judge-' || lpad(doc_id::VARCHAR, 6, '0') || '-' || direction AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'm' AS model, 'json_object' AS response_format, 'system' AS role0, 'user' AS role1,
 md5('---Role---
You are an expert tasked with evaluating two answers to the same question based on three criteria: **Comprehensiveness, Diversity, and Empowerment**.

---Goal---
Evaluate two answers based on:
- **Comprehensiveness**: Detail covering all aspects.
- **Diversity**: Variety of perspectives.
- **Empowerment**: Helping the reader make informed judgments.

For each criterion, choose the better answer (Answer 1 or Answer 2) and explain why. Then, select an overall winner.') AS system_md5,
 md5('
Here is the question: q ' || doc_id || '

Here are the two answers:
**Answer 1**: ' || CASE direction WHEN 'for' THEN own ELSE other END || '
**Answer 2**: ' || CASE direction WHEN 'for' THEN other ELSE own END || '

Evaluate both answers. Output your evaluation in the following **JSON format**:
{
  "Comprehensiveness": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Diversity": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Empowerment": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Overall Winner": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." }
}
') AS user_md5,
 'a_vs_b' AS pair_id, 'q ' || doc_id AS query, CASE direction WHEN 'for' THEN 'forward' ELSE 'reverse' END AS direction,
 CASE direction WHEN 'for' THEN 'g_a.jsonl' ELSE 'g_b.jsonl' END AS answer_a_file, CASE direction WHEN 'for' THEN 'g_b.jsonl' ELSE 'g_a.jsonl' END AS answer_b_file,
 CASE direction WHEN 'for' THEN 'g_a' ELSE 'g_b' END AS model_a, CASE direction WHEN 'for' THEN 'g_b' ELSE 'g_a' END AS model_b FROM d""")
def judge_batch_roundtrip(spark, sf_dir):
    """Judge requests and their metadata written as files and read back, field by field."""
    path = folder(spark)
    sides = F.explode(F.array(F.lit("for"), F.lit("rev"))).alias("direction")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("own"), text("about ", "doc_id").alias("other"), sides)
    first = F.col("direction") == "for"
    requests = d.select(F.format_string("judge-%06d-%s", "doc_id", "direction").alias("custom_id"), text("q ", "doc_id").alias("query"), "direction", F.when(first, F.col("own")).otherwise(F.col("other")).alias("answer_a"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("answer_b"))
    sinks.write_batch(requests, f"{path}/batch", "m")
    sinks.write_request_metadata(requests, "a_vs_b", "out/g_a.jsonl", "out/g_b.jsonl", f"{path}/metadata")
    body = "body struct<model:string,messages:array<struct<role:string,content:string>>,response_format:struct<type:string>>"
    got = spark.read.text(f"{path}/batch").select(F.from_json("value", f"custom_id string, method string, url string, {body}").alias("r"))
    content = lambda i: F.md5(F.col("r.body.messages")[i]["content"])
    role = lambda i: F.col("r.body.messages")[i]["role"]
    sent = got.select("r.custom_id", "r.method", "r.url", "r.body.model", F.col("r.body.response_format.type").alias("response_format"), role(0).alias("role0"), role(1).alias("role1"), content(0).alias("system_md5"), content(1).alias("user_md5"))
    return sent.join(files.request_metadata(spark, f"{path}/metadata"), "custom_id")


@query("""SELECT 'p' AS pair_id, CASE WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 4 = 2 THEN 0 ELSE 1 END AS winner, count(*) AS n FROM documents WHERE doc_id % 4 <> 3 GROUP BY ALL""")
def judge_results_read(spark, sf_dir):
    """Result lines of a judge, broken ones left out, read and parsed."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents")
    name = F.element_at(F.array(F.lit("Answer 1"), F.lit("b"), F.lit("both"), F.lit("-")), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.concat(F.lit('{"Overall Winner": {"Winner": "'), name, F.lit('"}}'))
    line = F.to_json(F.struct(F.format_string("judge-%06d-for", "doc_id").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    d.select(F.when(F.col("doc_id") % 4 == 3, F.lit("broken")).otherwise(line).alias("value")).write.text(path)
    rows = criteria_winners(files.judge_results(spark, "p", path), "pair_id").filter("criterion = 'Overall Winner'")
    return rows.groupBy("pair_id", "winner").agg(F.count("*").alias("n"))


@query(f"""WITH {JUDGE} SELECT pair_id, criterion, {RATES} FROM jr GROUP BY GROUPING SETS ((pair_id, criterion), (criterion))""")
def judge_results_stream(spark, sf_dir):
    """Result files of every pair in two deliveries, some results in both, taken by two runs of the stream; rates by their metadata files."""
    path = folder(spark)
    found, asked = B.judge_rows(spark, sf_dir)
    message = F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))
    line = F.to_json(F.struct("custom_id", F.struct(message.alias("body")).alias("response"))).alias("value")
    number = F.regexp_extract("custom_id", r"(\d+)", 1).cast("int")
    for delivery in (number % 3 != 0, number % 3 != 1):
        for pair in [r[0] for r in found.select("pair_id").distinct().collect()]:
            found.filter(delivery & (F.col("pair_id") == pair)).select(line).write.mode("append").text(f"{path}/in/{pair}{L.SUFFIX}")
        L.collect_results(spark, f"{path}/in", f"{path}/results", f"{path}/checkpoint").awaitTermination()
    as_lines(asked, f"{path}/metadata")
    return L.rates(spark, f"{path}/results", files.request_metadata(spark, f"{path}/metadata"))


@query("""WITH l AS (SELECT doc_id::VARCHAR AS b, 'f' || (doc_id % 400) AS f, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 < 4 THEN 'completed' ELSE 'running' END AS status FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT f, max(b::BIGINT)::VARCHAR AS b FROM l WHERE status = 'completed' GROUP BY f)
SELECT f AS final_outputs_path, b AS batch_id, 'p' AS pair_id FROM d WHERE substr(f, 2)::INTEGER % 7 <> 0""")
def ledger_to_download(spark, sf_dir):
    """Batches submitted, then changed, in an append-only ledger; those completed and not there yet."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.col("doc_id").cast("string").alias("batch_id"))
    L.append(d.select("batch_id", F.lit("submitted").alias("status"), F.lit("p").alias("pair_id"), F.concat(F.lit("f"), (F.col("doc_id") % 400).cast("string")).alias("final_outputs_path"), F.col("doc_id").cast("long").alias("seq")), path)
    state = F.when(F.col("doc_id") % 5 == 0, "failed").when(F.col("doc_id") % 5 < 4, "completed").otherwise("running")
    L.append(d.select("batch_id", state.alias("status"), (F.col("doc_id") + (1 << 40)).cast("long").alias("seq")), path)
    present = d.select(F.concat(F.lit("f"), (F.col("doc_id") % 400).cast("string")).alias("name")).distinct().filter(F.substring("name", 2, 9).cast("int") % 7 == 0)
    return L.to_download(L.ledger(spark, path), present).select("final_outputs_path", "batch_id", "pair_id")


@query("""SELECT 0 AS version, vec_id AS id, label, round(CAST(embedding[1] AS DOUBLE), 5) + 0.0 AS first FROM embeddings UNION ALL
SELECT 1, vec_id, CASE WHEN vec_id % 16 = 3 THEN NULL ELSE label END, round(CASE WHEN vec_id % 16 = 3 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 5) + 0.0 FROM embeddings UNION ALL
SELECT 1, -1 - vec_id, NULL, 0.5 FROM embeddings WHERE vec_id % 100 = 0""")
def vector_store_upsert(spark, sf_dir):
    """Vectors upserted twice, with repeated ids; both versions read afterwards."""
    store = VectorStore(spark, folder(spark))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).alias("ord"))
    again = rows.withColumns({"embedding": F.transform("embedding", lambda x: x * 9), "ord": F.lit(0)})
    first = store.upsert(rows.unionByName(again))
    changed = rows.filter("id % 16 = 3").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding"), "ord")
    added = rows.filter("id % 100 = 0").select((-1 - F.col("id")).alias("id"), F.array(F.lit(0.5)).alias("embedding"), "ord")
    second = store.upsert(changed.unionByName(added))
    part = lambda v: store.read(v).select(F.lit(v).alias("version"), "id", "label", (F.round(F.col("embedding")[0], 5) + 0.0).alias("first"))
    return part(first).unionByName(part(second))


@query("""SELECT vec_id::VARCHAR AS id, round(CASE WHEN vec_id % 3 = 0 THEN 0.25 ELSE CAST(embedding[1] AS DOUBLE) END, 5) + 0.0 AS first FROM embeddings""")
def embedding_backfill(spark, sf_dir):
    """Missing embeddings filled from the nodes' metadata, then from the index."""
    graph = B.vector_graph(spark, sf_dir)
    own = F.when(F.col("ord") % 3 == 0, F.lit('{"embedding":[0.25]}')).otherwise(F.col("metadata"))
    bare = graph.nodes.withColumns({"embedding": F.lit(None).cast("array<float>"), "metadata": own})
    return backfilled(bare, graph.index("node_vector")).select("id", (F.round(F.col("embedding")[0].cast("double"), 5) + 0.0).alias("first"))


@query("""SELECT 'one_' || lang AS graph, source AS retriever, doc_id::VARCHAR AS query, md5(coalesce(text, '')) AS outputs FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def outputs_roundtrip(spark, sf_dir):
    """Outputs written by graph and retriever and read back."""
    path = folder(spark)
    d = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    sinks.write_outputs(d.select(F.concat(F.lit("one_"), "lang").alias("graph"), F.col("source").alias("retriever"), F.col("doc_id").cast("string").alias("query"), F.coalesce("text", F.lit("")).alias("outputs")), path)
    read = spark.read.schema("query string, outputs string, graph string, retriever string").json(path)
    return read.select("graph", "retriever", "query", F.md5("outputs").alias("outputs"))


@query("""WITH n AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL) SELECT a.name AS left, b.name AS right FROM n a JOIN n b ON a.name < b.name""")
def judge_file_pairs(spark, sf_dir):
    """Every unordered pair of answer files, one file a source."""
    return answer_pairs(table(spark, sf_dir, "documents").select(F.col("source").alias("name")).filter("name is not null").distinct())
