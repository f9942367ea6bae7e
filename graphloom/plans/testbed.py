"""The driver's tables as graphs, indexes, session events and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, as_edges, as_nodes
from graphloom.operators.vector import VectorIndex
from graphloom.session import table

BASE = 1 << 40
#: Table, key, name, prefix and type of the knowledge graph's nodes.
ENTITIES = (("region", "r_regionkey", "r_name", "r", "Region"), ("nation", "n_nationkey", "n_name", "n", "Nation"), ("customer", "c_custkey", "c_name", "c", "Customer"), ("supplier", "s_suppkey", "s_name", "s", "Supplier"), ("part", "p_partkey", "p_name", "p", "Part"), ("orders", "o_orderkey", "o_orderpriority", "o", "Order"))


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, (name, key, text, prefix, kind) in enumerate(ENTITIES):
        rows = as_nodes(table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), F.col(text).alias("text"), (F.lit(k * BASE) + F.col(key)).alias("ord")))
        out = rows if out is None else out.unionByName(rows)
    return out


def knowledge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("nation").select(_id("n", "n_nationkey").alias("source"), _id("r", "n_regionkey").alias("target"), F.lit("in_region").alias("relation"), F.lit(1.0).alias("weight"), F.col("n_nationkey").cast("long").alias("edge_idx")),
        t("customer").select(_id("c", "c_custkey").alias("source"), _id("n", "c_nationkey").alias("target"), F.lit("in_nation").alias("relation"), F.lit(1.0).alias("weight"), (F.lit(BASE) + F.col("c_custkey")).alias("edge_idx")),
        t("supplier").select(_id("s", "s_suppkey").alias("source"), _id("n", "s_nationkey").alias("target"), F.lit("in_nation").alias("relation"), F.lit(1.0).alias("weight"), (F.lit(2 * BASE) + F.col("s_suppkey")).alias("edge_idx")),
        t("orders").select(_id("c", "o_custkey").alias("source"), _id("o", "o_orderkey").alias("target"), F.lit("placed").alias("relation"), F.lit(1.0).alias("weight"), (F.lit(3 * BASE) + F.col("o_orderkey")).alias("edge_idx")),
        t("lineitem").select(_id("o", "l_orderkey").alias("source"), _id("p", "l_partkey").alias("target"), F.lit("contains").alias("relation"), F.col("l_quantity").alias("weight"), (F.lit(4 * BASE) + F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("edge_idx")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return as_edges(out)


def knowledge_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(knowledge_nodes(spark, sf_dir), knowledge_edges(spark, sf_dir))


def vector_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Embeddings with the documents' texts; edges to the next of the same label, and to (7 id + 1) mod N."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = vectors.join(docs.select("doc_id", "text"), F.col("vec_id") == F.col("doc_id"), "left")
    nodes = as_nodes(joined.select(F.col("vec_id").cast("string").alias("id"), F.lit("Chunk").alias("type"), "text", "embedding", F.to_json(F.struct("label")).alias("metadata"), F.col("vec_id").alias("ord")))
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))  # one row
    following = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    same = vectors.select("vec_id", following.alias("next")).filter("next is not null").select(F.col("vec_id").cast("string").alias("source"), F.col("next").cast("string").alias("target"), F.lit("next_same_label").alias("relation"), (F.col("vec_id") * 2).alias("edge_idx"))
    related = vectors.join(n, F.lit(True)).select(F.col("vec_id").cast("string").alias("source"), ((F.col("vec_id") * 7 + 1) % F.col("n")).cast("string").alias("target"), F.lit("related").alias("relation"), (F.col("vec_id") * 2 + 1).alias("edge_idx"))
    graph = PropertyGraph(nodes, as_edges(same.unionByName(related)))
    return graph.attach("node_vector", index(nodes))


def index(nodes: DataFrame, metric: str = "cosine") -> VectorIndex:
    return VectorIndex(nodes.select("id", F.col("text").alias("document"), "metadata", "embedding", "ord"), metric)


def query_vectors(spark: SparkSession, sf_dir: str, below: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < below).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches' queries: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def session_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as session updates: clicks and views give nodes, purchases edges, others only progress; errors clear now and then."""
    e = table(spark, sf_dir, "events") if events is None else events
    kind, key = F.col("event_type"), F.get_json_object("props", "$.k")
    node = F.array(F.struct(F.concat(F.lit("p:"), key).alias("id"), F.when(kind == "click", "current").otherwise("previous").alias("style")))
    edge = F.array(F.struct(F.concat(F.lit("c:"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("p:"), key).alias("target"), F.lit(None).cast("string").alias("relation"), F.lit("current").alias("style")))
    progress = F.struct(F.floor("value").cast("int").alias("current"), F.lit(100).alias("total"), kind.alias("message"))
    return e.select(
        F.col("user_id").cast("string").alias("session_id"),
        "event_id",
        F.when((kind == "error") & (F.col("event_id") % 10 == 0), "clear").otherwise("update").alias("op"),
        F.when(kind.isin("click", "view"), node).alias("nodes"),
        F.when(kind == "purchase", edge).alias("edges"),
        F.to_json(F.map_from_arrays(F.array(kind), F.array(key))).alias("metadata"),
        F.when(kind.isin("signup", "purchase"), progress).alias("progress"),
    )


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session updates with sessions created and deleted at some signups, and metadata of numbers and booleans."""
    events = session_events(spark, sf_dir)
    kind = F.element_at(F.json_object_keys("metadata"), 1)
    key = F.call_function("get_json_object", F.col("metadata"), F.concat(F.lit("$."), kind))
    signup = kind == "signup"
    op = F.when(signup & (F.col("event_id") % 4 == 0), "delete").when(signup & (F.col("event_id") % 4 == 1), "create").otherwise(F.col("op"))
    metadata = F.concat(F.lit('{"'), kind, F.lit('": '), key, F.lit(', "even": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"))
    return events.withColumns({"op": op, "metadata": metadata}).withColumn("progress", F.when(F.col("op") == "update", F.col("progress")))


def verdict_content(doc_id: Column) -> Column:
    """A verdict as a judge may write it: fenced, in lower case, truncated, in numbers or without a block, by the id."""
    w = F.element_at(F.array(F.lit("Answer 1"), F.lit("Answer 2"), F.lit("Tie"), F.lit("2"), F.lit("neither")), (doc_id % 5 + 1).cast("int"))
    body = F.concat(F.lit('{"Comprehensiveness": {"Winner": "'), w, F.lit('", "Explanation": "x"}, "diversity": {"Winner": "Answer 1"}, "Empowerment": {"Winner": "'), w, F.lit('"}, "Overall Winner": '), F.when(doc_id % 3 == 0, F.concat(F.lit('{"Winner": "'), w, F.lit('"}'))).otherwise(F.concat(F.lit('"'), w, F.lit('"'))), F.lit("}"))
    return F.when(doc_id % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(doc_id % 11 == 0, F.substring(body, 1, 60)).when(doc_id % 13 == 0, F.lit(None)).otherwise(body)


def judge_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results (pair_id, custom_id, content) and request metadata (pair_id, custom_id, query, direction)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    direction = F.when(F.col("doc_id") % 2 == 0, "for").otherwise("rev")
    rows = docs.select(F.concat(F.lit("one_vs_"), "lang").alias("pair_id"), F.format_string("judge-%06d-%s", F.floor(F.col("doc_id") / 2), direction).alias("custom_id"), direction.alias("direction"), F.col("doc_id").cast("string").alias("query"), verdict_content(F.col("doc_id")).alias("content"))
    return rows.select("pair_id", "custom_id", "content"), rows.select("pair_id", "custom_id", "query", "direction")
