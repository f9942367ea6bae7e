"""The engine's named queries and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import chunk, content_id, norm_key
from graphloom.operators import batch as Q, chat, graph as G, judge as J, merge as M, retrieve as R, textindex as X
from graphloom.plans import testbed as B
from graphloom.session import shared_folder, table
from graphloom.streaming import history as H, sessions as S, store as T, trace as TR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = "the and tion of thhe"


def query(oracle: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


# --- SQL that several oracles share --------------------------------------------------------------

VEC = """vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"""
COS = "1 - list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))"
KG_NODES = """kn AS (
  SELECT 'r:' || r_regionkey AS id, 'Region' AS type, r_name AS text FROM region UNION ALL
  SELECT 'n:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL
  SELECT 'c:' || c_custkey, 'Customer', c_name FROM customer UNION ALL
  SELECT 's:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL
  SELECT 'p:' || p_partkey, 'Part', p_name FROM part UNION ALL
  SELECT 'o:' || o_orderkey, 'Order', o_orderpriority FROM orders)"""
KG_EDGES = """ke AS (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'in_region' AS relation, 1.0::DOUBLE AS weight, n_nationkey::BIGINT AS edge_idx FROM nation UNION ALL
  SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'in_nation', 1.0, 1099511627776 + c_custkey FROM customer UNION ALL
  SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'in_nation', 1.0, 2 * 1099511627776 + s_suppkey FROM supplier UNION ALL
  SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'placed', 1.0, 3 * 1099511627776 + o_orderkey FROM orders UNION ALL
  SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'contains', l_quantity, 4 * 1099511627776 + l_orderkey * 16 + l_linenumber FROM lineitem)"""
VG = f"""{VEC},
vn AS (SELECT vec_id, vec_id::VARCHAR AS id, text, e FROM vec LEFT JOIN documents ON vec_id = doc_id),
ve AS (
  SELECT vec_id::VARCHAR AS source, next::VARCHAR AS target, 'next_same_label' AS relation, vec_id * 2 AS edge_idx
  FROM (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next FROM vec) WHERE next IS NOT NULL UNION ALL
  SELECT vec_id::VARCHAR, ((vec_id * 7 + 1) % (SELECT count(*) FROM vec))::VARCHAR, 'related', vec_id * 2 + 1 FROM vec),
hits AS (SELECT id, row_number() OVER (ORDER BY {COS}, vec_id) - 1 AS pos, 1 - ({COS}) AS score FROM vn, q)"""
SEEDS = VG + ", seed AS (SELECT * FROM hits WHERE pos < 5)"
TOP10 = VG + ", got AS (SELECT * FROM hits WHERE pos < 10)"
HOP = SEEDS + """,
x AS (SELECT s.pos, ve.* FROM ve JOIN seed s ON ve.source = s.id),
placed AS (SELECT id, min(k) AS k, max(score) AS score FROM (
  SELECT id, [0, pos, 0] AS k, score FROM seed UNION ALL SELECT target, [1, pos, edge_idx], NULL FROM x) GROUP BY id),
hopn AS (SELECT row_number() OVER (ORDER BY k) - 1 AS place, p.id, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text, score FROM placed p JOIN vn ON p.id = vn.id)"""
UND = f"WITH {KG_EDGES}, und AS (SELECT source AS a, target AS b FROM ke UNION SELECT target, source FROM ke), h0 AS (SELECT 'c:1' AS id), h1 AS (SELECT DISTINCT b AS id FROM und WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT b AS id FROM und WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1)), hop AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"
STEX = TOP10 + """,
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ve UNION ALL SELECT target FROM ve) GROUP BY id),
adj AS (SELECT target AS id, count(*) AS adjacent FROM (SELECT DISTINCT source, target FROM ve) WHERE source IN (SELECT id FROM got) AND target NOT IN (SELECT id FROM got) GROUP BY target),
st AS (SELECT adj.id, degree, adjacent, round((-1.0 / 9) + CASE WHEN least(degree, 10) > 1 THEN (adjacent - 1.0) / (least(degree, 10) - 1.0) ELSE 0 END + list_dot_product(e, v), 5) AS gs_score
  FROM adj JOIN deg ON adj.id = deg.id JOIN vn ON adj.id = vn.id, q)"""
EV = """ev AS (
  SELECT user_id::VARCHAR AS session_id, event_id, event_type AS kind, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'clear' ELSE 'update' END AS op,
    event_type IN ('click', 'view') AS has_nodes, event_type = 'purchase' AS has_edges,
    event_type IN ('signup', 'purchase') AS has_progress, floor(value)::INTEGER AS cur FROM events)"""
FOLD = EV + """,
f1 AS (SELECT *, row_number() OVER w AS revision,
    coalesce(last_value(CASE WHEN has_progress AND op = 'update' THEN cur END IGNORE NULLS) OVER w, 0) AS current,
    coalesce(last_value(CASE WHEN has_progress AND op = 'update' THEN kind END IGNORE NULLS) OVER w, '') AS message,
    coalesce(last_value(CASE WHEN has_progress AND op = 'update' THEN least(100.0, greatest(0.0, cur / 100.0 * 100.0)) END IGNORE NULLS) OVER w, 0.0)::DOUBLE AS percent,
    sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER w AS clears
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f2 AS (SELECT *, coalesce(lag(percent) OVER (PARTITION BY session_id ORDER BY event_id), 0.0) AS before,
    op = 'update' AND (has_nodes OR has_edges OR has_progress) AS may FROM f1),
f3 AS (SELECT *, coalesce(max(may::INT) OVER (PARTITION BY session_id, clears ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first FROM f2),
fold AS (SELECT *, may AND (abs(percent - before) > 1e-9 OR has_nodes OR has_edges OR first) AS snapshot FROM f3)"""
NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
JUDGE = """jw AS (SELECT doc_id, lang, ['Answer 1', 'Answer 2', 'Tie', '2', 'neither'][doc_id % 5 + 1] AS w, doc_id % 2 = 1 AS rev,
    CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 13 = 0 THEN 2 ELSE 0 END AS broken FROM documents),
jc AS (SELECT *, unnest(['Comprehensiveness', 'Diversity', 'Empowerment', 'Overall Winner']) AS criterion FROM jw),
ja AS (SELECT *, CASE WHEN broken = 2 THEN NULL WHEN broken = 1 AND criterion <> 'Comprehensiveness' THEN NULL
    WHEN criterion = 'Diversity' THEN 1
    WHEN criterion = 'Overall Winner' AND doc_id % 3 <> 0 THEN NULL
    WHEN w = 'Answer 1' THEN 1 WHEN w IN ('Answer 2', '2') THEN 2 WHEN w = 'Tie' THEN 0 END AS win FROM jc),
jr AS (SELECT 'one_vs_' || lang AS pair_id, criterion, CASE WHEN rev AND win IN (1, 2) THEN 3 - win ELSE win END AS winner FROM ja)"""
RATES = """count(*) FILTER (winner = 1) AS answer1, count(*) FILTER (winner = 2) AS answer2, count(*) FILTER (winner = 0) AS tie,
  count(*) FILTER (winner IS NULL) AS invalid, count(*) AS total, count(winner) AS valid,
  CASE WHEN count(winner) > 0 THEN round(count(*) FILTER (winner = 1) / count(winner) * 100, 2) ELSE 0 END AS answer1_pct,
  CASE WHEN count(winner) > 0 THEN round(count(*) FILTER (winner = 2) / count(winner) * 100, 2) ELSE 0 END AS answer2_pct,
  CASE WHEN count(winner) > 0 THEN round(count(*) FILTER (winner = 0) / count(winner) * 100, 2) ELSE 0 END AS tie_pct"""

# --- vector and keyword search --------------------------------------------------------------------


def _hits(df: DataFrame) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def _topk(distance: str, where: str = "true", queries: str = "vec_id % 100 = 0", k: int = 5) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {queries}),
s AS (SELECT query_id, vec_id, {distance} AS d FROM v, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s)
SELECT query_id, vec_id::VARCHAR AS id, round(d, 6) + 0.0 AS distance, rank::INTEGER AS rank FROM r WHERE rank <= {k}"""


L2 = "list_dot_product(e, e) + list_dot_product(v, v) - 2 * list_dot_product(e, v)"


@query(_topk(COS, queries="vec_id = 7", k=10))
def vector_topk(spark, sf_dir):
    return _hits(B.index(B.vector_graph(spark, sf_dir).nodes).search(B.query_vectors(spark, sf_dir, 8).filter("query_id = 7"), 10))


@query(_topk(COS))
def vector_topk_batch(spark, sf_dir):
    return _hits(B.index(B.vector_graph(spark, sf_dir).nodes).search(B.query_set(spark, sf_dir), 5))


@query(_topk(L2))
def vector_topk_l2(spark, sf_dir):
    return _hits(B.index(B.vector_graph(spark, sf_dir).nodes, "l2sq").search(B.query_set(spark, sf_dir), 5))


@query(_topk(COS, where="label = 3"))
def vector_topk_filtered(spark, sf_dir):
    return _hits(B.index(B.vector_graph(spark, sf_dir).nodes).search(B.query_set(spark, sf_dir), 5, where={"label": 3}))


_TOKENS = WORDS.split()


@query(f"""WITH s AS (SELECT doc_id, {' + '.join(f"contains(lower(doc_id::VARCHAR || ' ' || text), '{t}')::INT" for t in _TOKENS)} AS hits FROM documents)
SELECT (row_number() OVER (ORDER BY hits DESC, doc_id) - 1)::INTEGER AS pos, doc_id::VARCHAR AS id, round(hits / {len(_TOKENS)}.0, 6) AS score FROM s WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 20""")
def keyword_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))
    return R.keyword_seeds(docs, WORDS, 20).select("pos", "id", F.round("score", 6).alias("score"))


@query(f"""WITH asked AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS words FROM conversations WHERE role = 'user' AND conv_id % 100 = 0),
word AS (SELECT query_id, w, count(*) AS times FROM (SELECT query_id, unnest(words) AS w FROM asked) GROUP BY query_id, w),
hit AS (SELECT query_id, doc_id, sum(times) AS hits FROM word JOIN documents ON contains(lower(doc_id::VARCHAR || ' ' || coalesce(text, '')), w) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS r FROM hit)
SELECT query_id, (r - 1)::INTEGER AS pos, doc_id::VARCHAR AS id, round(hits / len(words), 6) AS score FROM ranked JOIN asked USING (query_id) WHERE r <= 20""")
def keyword_topk_batch(spark, sf_dir):
    """The users' turns of the conversations whose id is divisible by 100, as queries over all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("ord"))
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' and conv_id % 100 = 0")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return X.TrigramIndex.build(docs).search(asked, 20).select("query_id", "pos", "id", F.round("score", 6).alias("score"))


def _asked(spark, sf_dir):
    return B.query_set(spark, sf_dir).select("query_id", F.concat(F.lit("query "), "query_id").alias("query"), F.col("vector").cast("array<double>").alias("vector"))


BATCH_HITS = VG.replace("WHERE vec_id = 7", "WHERE vec_id % 100 = 0").rsplit("hits AS", 1)[0] + f"""
hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round({COS}, 12), vec_id) - 1 AS pos FROM vn, q),
seed AS (SELECT * FROM hits WHERE pos < 5),
told AS (SELECT id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM vn WHERE text IS NOT NULL),
placed AS (SELECT query_id, id, min(k) AS k FROM (
  SELECT query_id, id, [0, pos, 0] AS k FROM seed UNION ALL SELECT query_id, target, [1, pos, edge_idx] FROM seed JOIN ve ON ve.source = seed.id) GROUP BY query_id, id),
hop AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS pos, '[' || id || '] ' || text AS chunk FROM placed JOIN told USING (id) WHERE text <> ''),
near AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, '[' || id || '] ' || text AS chunk FROM seed JOIN told USING (id) WHERE text <> '')"""


@query(f"WITH {BATCH_HITS} SELECT query_id, pos::INTEGER AS pos, chunk FROM hop WHERE pos < 10")
def retrieve_batch(spark, sf_dir):
    """One-hop contexts of all queries, those whose id is divisible by 100, in one plan."""
    got = Q.retrieved(B.vector_graph(spark, sf_dir), _asked(spark, sf_dir), "one-hop", top_k=5)
    return got.select("query_id", F.posexplode("chunks").alias("pos", "chunk"))


@query(f"""WITH {BATCH_HITS},
said AS (SELECT 'one-hop' AS retriever, query_id, string_agg(chunk, chr(10) ORDER BY pos) AS outputs FROM hop WHERE pos < 10 GROUP BY query_id UNION ALL
  SELECT 'vector', query_id, string_agg(chunk, chr(10) ORDER BY pos) FROM near GROUP BY query_id UNION ALL
  SELECT 'hybrid', query_id, 'ERROR: NotImplementedError: hybrid retrieval is not defined' FROM q),
methods AS (SELECT unnest(['one-hop', 'vector', 'hybrid']) AS retriever)
SELECT 'vectors' AS graph, retriever, query_id, md5(coalesce(outputs, 'No retrieval context was found.')) AS outputs FROM q CROSS JOIN methods LEFT JOIN said USING (retriever, query_id)""")
def experiment_matrix(spark, sf_dir):
    """Graphs by retrievers by queries in one plan; what fails is an output."""
    got = Q.experiment({"vectors": B.vector_graph(spark, sf_dir)}, ["one-hop", "vector", "hybrid"], _asked(spark, sf_dir), top_k=5)
    return got.select("graph", "retriever", "query_id", F.md5("outputs").alias("outputs"))


@query(f"""WITH {BATCH_HITS},
n AS (SELECT query_id, (SELECT count(*) FROM seed WHERE seed.query_id = q.query_id) AS seeds, (SELECT count(*) FROM seed JOIN ve ON ve.source = seed.id WHERE seed.query_id = q.query_id) AS edges,
  (SELECT count(*) FROM hop WHERE hop.query_id = q.query_id AND pos < 10) AS nodes FROM (SELECT DISTINCT query_id FROM q) q)
SELECT 'query ' || query_id AS session_id, 1 AS event_id, NULL::INTEGER AS current, NULL AS message, seeds AS given FROM n
UNION ALL SELECT 'query ' || query_id, 2, 1, 'Seeds: ' || seeds, NULL FROM n
UNION ALL SELECT 'query ' || query_id, 4, 2, 'Edges: ' || edges, NULL FROM n
UNION ALL SELECT 'query ' || query_id, 5, NULL, NULL, nodes FROM n
UNION ALL SELECT 'query ' || query_id, 6, 3, 'Retrieval complete: ' || nodes, NULL FROM n""")
def retrieval_trace(spark, sf_dir):
    """Session events of a traced one-hop retrieval for all queries: ids and numbers of every stage."""
    asked = _asked(spark, sf_dir)
    _, trace = TR.one_hop(B.vector_graph(spark, sf_dir), asked, top_k=5)
    events = TR.one_hop_events(trace, asked.select("query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("session_id")))
    return events.select("session_id", "event_id", "progress.current", "progress.message", F.when(F.col("nodes").isNotNull(), F.size("nodes").cast("long")).alias("given"))


@query()
def collect_batch(spark, sf_dir):
    """Collection in rounds for all queries at once; tests hold it against one query at a time in plain Python."""
    graph, asked = B.vector_graph(spark, sf_dir), _asked(spark, sf_dir)
    hits = graph.search("node_vector", asked.select("query_id", "vector"), 30).select("query_id", (F.col("rank") - 1).alias("pos"), "id", F.col("document").alias("text"))
    got = Q.collect(graph, asked, G.cut(hits))
    return got.select("query_id", "place", "id", "origin", F.round("score", 6).alias("score"), F.round("gs_score", 6).alias("gs_score"))


def _one_hop(spark, sf_dir):
    return R.OneHopRetriever().retrieve(B.vector_graph(spark, sf_dir), WORDS, vector=B.query_vector(spark, sf_dir), top_k=5)


@query(f"WITH {SEEDS} SELECT pos::INTEGER AS pos, s.id, round(score, 6) AS score, length(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)))::INTEGER AS n FROM seed s JOIN vn ON s.id = vn.id")
def vector_retriever(spark, sf_dir):
    found = R.VectorRetriever().retrieve(B.vector_graph(spark, sf_dir), WORDS, vector=B.query_vector(spark, sf_dir), top_k=5)
    return found.nodes.select(F.col("place").alias("pos"), "id", F.round("score", 6).alias("score"), F.length("text").alias("n"))


@query(f"WITH {HOP} SELECT place::INTEGER AS place, id, text, round(score, 6) AS score FROM hopn")
def one_hop_nodes(spark, sf_dir):
    return _one_hop(spark, sf_dir).nodes.select("place", "id", "text", F.round("score", 6).alias("score"))


@query(f"WITH {HOP} SELECT pos::INTEGER AS pos, edge_idx, source, target, relation, 1.0::DOUBLE AS weight FROM x")
def one_hop_edges(spark, sf_dir):
    return _one_hop(spark, sf_dir).edges.select("pos", "edge_idx", "source", "target", "relation", "weight")


@query(f"WITH {HOP}, c AS (SELECT '[' || id || '] ' || text AS chunk, min(place) AS p FROM hopn WHERE text <> '' GROUP BY 1) SELECT (row_number() OVER (ORDER BY p) - 1)::INTEGER AS pos, chunk FROM c")
def context_chunks(spark, sf_dir):
    return _one_hop(spark, sf_dir).chunks.select(F.posexplode("chunks").alias("pos", "chunk"))


# --- graph container --------------------------------------------------------------------------------


@query(f"WITH {KG_EDGES} SELECT edge_idx, source, target, relation, weight FROM ke WHERE source IN ('c:1', 'n:3', 'o:5', 'r:0')")
def neighbors(spark, sf_dir):
    ids = spark.createDataFrame([("c:1",), ("n:3",), ("o:5",), ("r:0",)], "id string")
    return B.knowledge_graph(spark, sf_dir).neighbors(ids).select("edge_idx", "source", "target", "relation", "weight")


@query(f"WITH {KG_NODES}, {KG_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ke UNION ALL SELECT target FROM ke) GROUP BY id) SELECT coalesce(kn.id, d.id) AS id, coalesce(degree, 0)::BIGINT AS degree FROM kn FULL JOIN d ON kn.id = d.id")
def degree(spark, sf_dir):
    return G.degrees(B.knowledge_graph(spark, sf_dir))


@query(f"WITH {KG_NODES}, {KG_EDGES}, have AS (SELECT * FROM kn WHERE type <> 'Part'), ends AS (SELECT unnest([source, target]) AS id FROM ke) SELECT id, type, text FROM have UNION ALL SELECT DISTINCT id, 'Entity', NULL FROM ends WHERE id NOT IN (SELECT id FROM have)")
def endpoint_closure(spark, sf_dir):
    graph = B.knowledge_graph(spark, sf_dir)
    return G.closed(graph.nodes.filter("type != 'Part'"), graph.edges).select("id", "type", "text")


@query(f"""WITH {KG_NODES}, {KG_EDGES},
o AS (SELECT source AS id, string_agg(edge_idx::VARCHAR, ',' ORDER BY edge_idx) AS out_edges FROM ke GROUP BY source), i AS (SELECT target AS id, string_agg(edge_idx::VARCHAR, ',' ORDER BY edge_idx) AS in_edges FROM ke GROUP BY target)
SELECT kn.id, coalesce(out_edges, '') AS out_edges, coalesce(in_edges, '') AS in_edges FROM kn LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def incident_edges(spark, sf_dir):
    """Every node's outgoing and incoming edges, from edges stored by their ends."""
    lists = G.incident(B.knowledge_graph(spark, sf_dir).stored())
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return lists.select("id", shown("out_edges"), shown("in_edges"))


@query(UND + """ SELECT count(*) AS edges, count(DISTINCT edge_idx) AS distinct_edges, sum(weight) AS weight FROM ke WHERE source IN (SELECT id FROM hop) AND target IN (SELECT id FROM hop)""")
def khop_stored(spark, sf_dir):
    """Two hops and the edges among what they reach, from edges stored by their ends."""
    graph = B.knowledge_graph(spark, sf_dir).stored()
    near = G.k_hop(graph, spark.createDataFrame([("c:1",)], "id string"), 2)
    return G.induced(graph, near).edges.agg(F.count("*").alias("edges"), F.countDistinct("edge_idx").alias("distinct_edges"), F.sum("weight").alias("weight"))


@query(f"WITH {KG_EDGES}, b AS (SELECT source AS id, target AS n FROM ke UNION SELECT target, source FROM ke) SELECT id, string_agg(n, ',' ORDER BY n) AS neighbours FROM b GROUP BY id")
def adjacency_list(spark, sf_dir):
    return G.adjacency(B.knowledge_graph(spark, sf_dir)).select("id", F.array_join("neighbours", ",").alias("neighbours"))


def _seed(spark):
    return spark.createDataFrame([("c:1",)], "id string")


@query(UND + " SELECT id, hop FROM hop")
def khop_nodes(spark, sf_dir):
    return G.k_hop(B.knowledge_graph(spark, sf_dir), _seed(spark), 2).select("id", "hop")


@query(UND + " SELECT edge_idx, source, target, relation FROM ke WHERE source IN (SELECT id FROM hop) AND target IN (SELECT id FROM hop)")
def khop_induced_edges(spark, sf_dir):
    graph = B.knowledge_graph(spark, sf_dir)
    return G.induced(graph, G.k_hop(graph, _seed(spark), 2)).edges.select("edge_idx", "source", "target", "relation")


@query("SELECT 'c:' || o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS text, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey")
def node_upsert_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("text"), F.col("o_orderkey").alias("ord"))
    return G.last_wins(rows, "id", "ord")


@query("SELECT l_suppkey AS source, l_partkey AS target, arg_min(l_shipdate, l_orderkey * 16 + l_linenumber) AS shipped, min(l_orderkey * 16 + l_linenumber) AS ord FROM lineitem GROUP BY ALL")
def first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_shipdate").alias("shipped"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"))
    return G.first_wins(rows, ["source", "target"], "ord")


@query(f"WITH {KG_NODES} SELECT id, text AS label, type AS \"group\", id AS title FROM kn")
def node_labels(spark, sf_dir):
    nodes = B.knowledge_nodes(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.lit("x").alias("original_label"))))
    return G.labels(nodes)


# --- multi-stage retrieval ----------------------------------------------------------------------------


def _retrieved(spark, sf_dir):
    graph = B.vector_graph(spark, sf_dir)
    vector = B.query_vector(spark, sf_dir)
    hits = graph.search("node_vector", vector, 10).select("id", (F.col("rank") - 1).alias("pos"))
    return graph, vector, hits


@query(f"WITH {STEX} SELECT id, degree, adjacent, gs_score FROM st")
def stex_scores(spark, sf_dir):
    graph, vector, hits = _retrieved(spark, sf_dir)
    return R.stex(graph, hits, vector).select("id", "degree", "adjacent", F.round("gs_score", 5).alias("gs_score"))


@query(f"WITH {STEX} SELECT id, gs_score FROM st ORDER BY gs_score DESC, degree, id LIMIT 10")
def collect_round1(spark, sf_dir):
    graph, vector, hits = _retrieved(spark, sf_dir)
    scored = R.stex(graph, hits, vector).select("id", "degree", F.round("gs_score", 5).alias("gs_score"))
    return scored.orderBy(F.desc("gs_score"), "degree", "id").limit(10).select("id", "gs_score")


@query()
def collect_final(spark, sf_dir):
    graph = B.vector_graph(spark, sf_dir)
    asked = B.query_vectors(spark, sf_dir, 8).filter("query_id = 7").select("query_id", F.lit(WORDS).alias("query"), "vector")
    hits = graph.search("node_vector", asked.select("query_id", "vector"), 30).select("query_id", (F.col("rank") - 1).alias("pos"), "id", F.col("document").alias("text"))
    found = Q.collect(graph, asked, G.cut(hits)).filter("place < 10")
    return found.select("place", "id", "origin", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"))


@query(f"""WITH {TOP10}, f AS (SELECT got.id, unnest(range(len(e))) AS dim, unnest(e) AS x FROM got JOIN vn ON got.id = vn.id),
l AS (SELECT DISTINCT source, target FROM ve WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f) UNION SELECT id, id FROM f)
SELECT a.id, a.dim::INTEGER AS dim, round(0.3 * any_value(a.x) + 0.7 * avg(b.x), 6) + 0.0 AS y
FROM f a JOIN l ON a.id = l.source JOIN f b ON l.target = b.id AND a.dim = b.dim GROUP BY a.id, a.dim""")
def gcn_smooth(spark, sf_dir):
    graph, _, hits = _retrieved(spark, sf_dir)
    features = hits.join(graph.nodes, "id").select("id", F.col("embedding").cast("array<double>").alias("features"))
    return R.smoothed(features, graph.edges).select("id", F.posexplode("features").alias("dim", "y")).select("id", "dim", (F.round("y", 6) + 0.0).alias("y"))


@query(f"""WITH {SEEDS} SELECT benchmark.item_id, 'Answer the question using the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || (SELECT string_agg(id, chr(10) ORDER BY pos) FROM seed WHERE pos < 3) || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM benchmark""")
def prompt_build(spark, sf_dir):
    _, _, hits = _retrieved(spark, sf_dir)
    chunks = hits.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("chunks"))
    rows = table(spark, sf_dir, "benchmark").join(F.broadcast(chunks), F.lit(True))  # one row
    return rows.select("item_id", R.prompt(F.col("text"), F.col("chunks"), 3).alias("prompt"))


# --- entity resolution and merging ----------------------------------------------------------------------


def _triple_text(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("row"), F.concat(F.lit("("), F.col("s_name"), F.lit("; in ;"), F.col("n_name"), F.lit(")(; x; y)("), F.col("n_name"), F.lit(";;a;b)")).alias("graph"))


@query("""SELECT s_suppkey AS row, 0 AS i, s_name AS head, 'in' AS relation, n_name AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 1, n_name, '', 'a;b' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def triple_parse(spark, sf_dir):
    rows = _triple_text(spark, sf_dir).select("row", F.posexplode(M.parsed_triples(F.col("graph"))).alias("i", "t"))
    return rows.select("row", "i", "t.head", "t.relation", "t.tail")


@query("""WITH t AS (SELECT s_suppkey * 4096 AS ord, s_name AS head, 'in' AS relation, n_name AS tail FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey * 4096 + 1, n_name, '', 'a;b' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'node-' || md5(lower(head)) AS source, CASE WHEN relation = '' THEN 'related' ELSE relation END AS relation, 'node-' || md5(lower(tail)) AS target, min(ord) AS edge_idx FROM t GROUP BY ALL""")
def triple_graph_edges(spark, sf_dir):
    rows = _triple_text(spark, sf_dir).select("row", F.posexplode(M.parsed_triples(F.col("graph"))).alias("i", "t"))
    _, edges = M.triples_to_graph(rows.select("t.head", "t.relation", "t.tail", (F.col("row") * 4096 + F.col("i")).alias("ord")))
    return edges.select("source", "relation", "target", "edge_idx")


@query("""WITH names AS (SELECT '  ' || upper(n_name) || ' ' AS name FROM nation UNION ALL SELECT r_name FROM region)
SELECT name, coalesce('n:' || n_nationkey, 'entity-' || md5(trim(lower(name)))) AS resolved, n_nationkey IS NULL AS placeholder FROM names LEFT JOIN nation ON trim(lower(name)) = lower(n_name)""")
def entity_resolve(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    entities = nations.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("text"), F.col("n_nationkey").cast("long").alias("ord"))
    names = nations.select(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")).alias("name")).union(table(spark, sf_dir, "region").select("r_name"))
    return M.resolve_names(names, entities).select("name", "resolved", "placeholder")


@query("SELECT 's:' || l_suppkey AS source, l_returnflag AS relation, 'p:' || l_partkey AS target, max(l_quantity) AS weight FROM lineitem GROUP BY ALL")
def edge_dedup_max_weight(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("source"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("edge_idx"))
    return M.merge_edges(rows).select("source", "relation", "target", "weight")


@query("""WITH f AS (SELECT l_partkey, l_suppkey, min(l_orderkey * 16 + l_linenumber) AS o FROM lineitem GROUP BY ALL)
SELECT l_partkey AS part, string_agg(l_suppkey::VARCHAR, ',' ORDER BY o, l_suppkey) AS suppliers FROM f GROUP BY l_partkey""")
def append_unique(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"))
    return rows.groupBy(F.col("l_partkey").alias("part")).agg(F.array_join(F.transform(M.append_unique("l_suppkey", "ord"), lambda x: x.cast("string")), ",").alias("suppliers"))


@query("""SELECT 's:' || s_suppkey AS source, 'n:' || s_nationkey AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'fact' WHEN s_suppkey % 3 = 1 THEN 'open' ELSE 'related' END AS relation FROM supplier""")
def relation_coalesce(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    source, target = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string"))
    topology = s.select(source.alias("source"), target.alias("target"), F.lit(1.0).alias("weight"), F.col("s_suppkey").alias("ord"))
    facts = s.filter("s_suppkey % 3 = 0").select(source.alias("source"), target.alias("target"), F.explode(F.array(F.struct(F.lit("fact").alias("relation"), F.lit(0).alias("o")), F.struct(F.lit("later").alias("relation"), F.lit(1).alias("o")))).alias("e")).select("source", "target", "e.relation", F.col("e.o").alias("ord"))
    openie = s.filter("s_suppkey % 3 < 2").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.upper("s_name").alias("head"), F.explode(F.array(F.struct(F.lit("earlier").alias("relation"), F.lit(0).alias("o")), F.struct(F.lit("open").alias("relation"), F.lit(1).alias("o")))).alias("e"), F.col("n_name").alias("tail")).select("head", "e.relation", "tail", F.col("e.o").alias("ord"))
    texts = B.knowledge_nodes(spark, sf_dir).select("id", "text")
    return M.topology_edges(topology, facts, openie, texts).select("source", "target", "relation")


def _union_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord")
    nodes = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_orderpriority").alias("gid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("local_id"), F.lit("Part").alias("type"), F.col("p_brand").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("{}").alias("metadata"), order)
    edges = lines.select(F.col("o_orderpriority").alias("gid"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("supplied").alias("relation"), F.col("l_quantity").alias("weight"), order.alias("edge_idx"))
    return nodes, edges


@query("""WITH l AS (SELECT o_orderpriority AS gid, p_brand AS text, l_partkey, l_orderkey * 16 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT text, gid, min(o) AS o FROM l GROUP BY ALL)
SELECT 'node-' || md5('part|' || lower(text)) AS id, any_value(text) AS text, string_agg(gid, ',' ORDER BY o) AS graph_ids, (SELECT count(DISTINCT l_partkey) FROM l WHERE l.text = g.text)::INTEGER AS n_local FROM g GROUP BY text""")
def subgraph_union_nodes(spark, sf_dir):
    nodes, _ = M.merge_subgraph_nodes(_union_rows(spark, sf_dir)[0])
    return nodes.select("id", "text", F.array_join("graph_ids", ",").alias("graph_ids"), F.size("original_node_ids").alias("n_local"))


@query("""WITH l AS (SELECT o_orderpriority AS gid, 'node-' || md5('part|' || lower(p_brand)) AS source, o_orderpriority || ':s' || l_suppkey AS target, l_quantity AS w, l_orderkey * 16 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT source, 'supplied' AS relation, target, max(w) AS weight, count(DISTINCT o)::INTEGER AS n FROM l GROUP BY source, target""")
def subgraph_union_edges(spark, sf_dir):
    nodes, edges = _union_rows(spark, sf_dir)
    _, local = M.merge_subgraph_nodes(nodes)
    merged = M.merge_subgraph_edges(edges, local)
    return merged.select("source", "relation", "target", "weight", F.size("original_edge_ids").alias("n"))


@query("""SELECT n_nationkey AS k, 'entity-' || md5(lower(n_name)) AS hashed, '[' || n_nationkey || '] ' || n_name AS chunk FROM nation""")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), content_id("entity", norm_key(F.col("n_name"))).alias("hashed"), chunk(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("chunk"))


# --- evaluation --------------------------------------------------------------------------------------------


def _answers(spark, sf_dir, role):
    return table(spark, sf_dir, "conversations").filter(F.col("role") == role).groupBy(F.col("conv_id").cast("string").alias("query")).agg(F.max_by("text", "turn").alias("answer"), F.min("conv_id").alias("ord"))


@query("""WITH a AS (SELECT conv_id, arg_max(text, turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT conv_id, arg_max(text, turn) AS v FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT a.conv_id, u, v, row_number() OVER (ORDER BY a.conv_id) - 1 AS n FROM a JOIN b USING (conv_id)), d AS (SELECT *, unnest(['for', 'rev']) AS direction FROM j)
SELECT 'judge-' || lpad(n::VARCHAR, 6, '0') || '-' || direction AS custom_id, conv_id::VARCHAR AS query, direction, md5(CASE WHEN direction = 'for' THEN u ELSE v END) AS a, md5(CASE WHEN direction = 'for' THEN v ELSE u END) AS b FROM d""")
def judge_pairs(spark, sf_dir):
    out = J.request_pairs(_answers(spark, sf_dir, "user"), _answers(spark, sf_dir, "assistant"))
    return out.select("custom_id", "query", "direction", F.md5(F.col("answer_a").cast("binary")).alias("a"), F.md5(F.col("answer_b").cast("binary")).alias("b"))


def _rates(spark, sf_dir):
    return J.win_rates(J.verdicts(*B.judge_rows(spark, sf_dir)))


@query(f"WITH {JUDGE} SELECT pair_id, criterion, {RATES} FROM jr GROUP BY pair_id, criterion")
def judge_winrate(spark, sf_dir):
    return _rates(spark, sf_dir).filter("pair_id is not null")


@query(f"WITH {JUDGE} SELECT criterion, {RATES} FROM jr GROUP BY criterion")
def judge_overall(spark, sf_dir):
    return _rates(spark, sf_dir).filter("pair_id is null").drop("pair_id")


@query("""SELECT conv_id, turn, trim(text) AS message, text <> '' AS valid, CASE WHEN turn % 3 = 0 THEN 5 ELSE greatest(1, turn) END AS top_k,
CASE WHEN turn % 2 = 0 THEN 'openai' ELSE 'hf' END AS embedding_provider, CASE WHEN turn % 2 = 0 THEN 'm:1' ELSE 'BAAI/bge-m3' END AS embedding_model, 'raise' AS embedding_error_policy, role AS session_id FROM conversations""")
def chat_normalize(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct(F.col("text").alias("message"), F.when(F.col("turn") % 3 == 0, F.lit("x")).otherwise(F.col("turn").cast("string")).alias("top_k"), F.when(F.col("turn") % 2 == 0, F.lit("OpenAI:m:1")).alias("embedding"), F.concat(F.lit(" "), F.col("role")).alias("session_id")))
    out = chat.requests(t.select("conv_id", "turn", payload.alias("payload")))
    return out.select("conv_id", "turn", "message", "valid", "top_k", "embedding_provider", "embedding_model", "embedding_error_policy", "session_id")


# --- sessions ------------------------------------------------------------------------------------------------


@query(f"WITH {FOLD} SELECT session_id, event_id, revision::INTEGER AS revision, current, message, percent, snapshot FROM fold")
def session_fold(spark, sf_dir):
    return S.folded(B.session_events(spark, sf_dir)).select("session_id", "event_id", "revision", "current", "message", "percent", "snapshot")


@query(f"""WITH {FOLD}, l AS (SELECT *, max(clears) OVER (PARTITION BY session_id) AS c FROM fold), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY revision DESC) AS n FROM l WHERE clears = c AND snapshot)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY revision) - 1)::INTEGER AS step, revision::INTEGER AS revision, percent FROM r WHERE n <= 5""")
def session_replay_last_n(spark, sf_dir):
    return S.replay(S.folded(B.session_events(spark, sf_dir)), 5).select("session_id", "step", "revision", "percent")


@query(f"WITH {FOLD} SELECT session_id, arg_max(percent, event_id) AS percent, arg_max(message, event_id) AS message, max(revision)::INTEGER AS revision FROM fold GROUP BY session_id")
def session_progress(spark, sf_dir):
    return S.folded(B.session_events(spark, sf_dir)).groupBy("session_id").agg(F.max_by("percent", "event_id").alias("percent"), F.max_by("message", "event_id").alias("message"), F.max("revision").alias("revision"))


OVERLAY = EV + """,
cut AS (SELECT session_id, max(event_id) AS c FROM ev WHERE op = 'clear' GROUP BY session_id),
live AS (SELECT ev.* FROM ev LEFT JOIN cut USING (session_id) WHERE op = 'update' AND (c IS NULL OR event_id > c))"""


@query(f"WITH {OVERLAY} SELECT session_id, 'p:' || k AS id, arg_max(CASE WHEN kind = 'click' THEN 'current' ELSE 'previous' END, event_id) AS style FROM live WHERE has_nodes GROUP BY session_id, k")
def session_overlay_nodes(spark, sf_dir):
    return S.overlay_nodes(B.session_events(spark, sf_dir))


EDGES = OVERLAY + """,
oe AS (SELECT session_id, 'c:' || session_id AS source, 'p:' || k AS target, CASE WHEN max(event_id) = any_value(m) THEN 'current' ELSE 'previous' END AS style
  FROM (SELECT *, max(event_id) OVER (PARTITION BY session_id) AS m FROM live WHERE has_edges) GROUP BY session_id, k)"""


@query(f"WITH {EDGES} SELECT session_id, source, target, 'RELATED' AS relation, style FROM oe")
def session_edge_style(spark, sf_dir):
    return S.overlay_edges(B.session_events(spark, sf_dir))


@query(f"""WITH {EDGES}, ons AS (SELECT session_id, 'p:' || k AS id, arg_max(CASE WHEN kind = 'click' THEN 'current' ELSE 'previous' END, event_id) AS style FROM live WHERE has_nodes GROUP BY session_id, k),
pe AS (SELECT DISTINCT session_id, 'p:' || k AS source, 'p:' || ((k::INTEGER + 1) % 100) AS target, 'next' AS relation FROM ev UNION ALL SELECT session_id, source, target, 'RELATED' FROM oe)
SELECT pe.session_id, pe.source, pe.target, pe.relation, coalesce(oe.style, CASE WHEN a.style IS NOT NULL AND b.style IS NOT NULL THEN CASE WHEN 'current' IN (a.style, b.style) THEN 'current' ELSE 'previous' END END) AS style
FROM pe LEFT JOIN oe ON pe.session_id = oe.session_id AND pe.source = oe.source AND pe.target = oe.target AND pe.relation = 'RELATED' LEFT JOIN ons a ON pe.session_id = a.session_id AND pe.source = a.id LEFT JOIN ons b ON pe.session_id = b.session_id AND pe.target = b.id""")
def session_view_edges(spark, sf_dir):
    events = B.session_events(spark, sf_dir)
    overlay = S.overlay_edges(events)
    key = F.get_json_object("props", "$.k").cast("int")
    near = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("p:"), key.cast("string")).alias("source"), F.concat(F.lit("p:"), ((key + 1) % 100).cast("string")).alias("target"), F.lit("next").alias("relation")).distinct()
    return S.styled_edges(near.unionByName(overlay.drop("style")), S.overlay_nodes(events), overlay)


@query(f"""WITH {EDGES}, {KG_NODES}, {KG_EDGES},
ons AS (SELECT session_id, 'p:' || k AS id, arg_max(CASE WHEN kind = 'click' THEN 'current' ELSE 'previous' END, event_id) AS style FROM live WHERE has_nodes GROUP BY session_id, k),
ends AS (SELECT session_id, source AS id FROM oe UNION SELECT session_id, target FROM oe),
seed AS (SELECT session_id, id FROM ons UNION ALL SELECT session_id, id FROM ends WHERE session_id NOT IN (SELECT session_id FROM ons)),
und AS (SELECT source AS a, target AS b FROM ke UNION SELECT target, source FROM ke),
sel AS (SELECT session_id, id FROM seed UNION SELECT session_id, b FROM seed JOIN und ON a = id UNION SELECT session_id, id FROM ends),
vw AS (SELECT session_id, count(*) AS n, count(*) FILTER (style = 'current') AS c FROM sel JOIN kn USING (id) LEFT JOIN ons USING (session_id, id) GROUP BY session_id),
ed AS (SELECT s.session_id, ke.*, coalesce(oe.style, CASE WHEN a.style IS NOT NULL AND b.style IS NOT NULL THEN CASE WHEN 'current' IN (a.style, b.style) THEN 'current' ELSE 'previous' END END) AS style
  FROM ke JOIN sel s ON ke.source = s.id JOIN sel t ON ke.target = t.id AND s.session_id = t.session_id
  LEFT JOIN oe ON oe.session_id = s.session_id AND oe.source = ke.source AND oe.target = ke.target AND ke.relation = 'RELATED'
  LEFT JOIN ons a ON a.session_id = s.session_id AND a.id = ke.source LEFT JOIN ons b ON b.session_id = s.session_id AND b.id = ke.target),
ve2 AS (SELECT session_id, count(*) AS n, count(style) AS c FROM ed GROUP BY session_id),
hn AS (SELECT session_id, count(*) AS n FROM ons GROUP BY session_id), he AS (SELECT session_id, count(*) AS n FROM oe GROUP BY session_id)
SELECT session_id, r.revision, coalesce(vw.n, 0) AS nodes, coalesce(ve2.n, 0) AS edges, coalesce(hn.n, 0) AS highlighted_nodes, coalesce(he.n, 0) AS highlighted_edges, coalesce(vw.c, 0) AS current_nodes, coalesce(ve2.c, 0) AS styled_edges
FROM (SELECT session_id, count(*) AS revision FROM ev GROUP BY session_id) r LEFT JOIN vw USING (session_id) LEFT JOIN ve2 USING (session_id) LEFT JOIN hn USING (session_id) LEFT JOIN he USING (session_id)""")
def session_view_counts(spark, sf_dir):
    """Overlay, seeds, one hop, induced edges and styles of every session over the whole knowledge graph, counted."""
    events = B.session_events(spark, sf_dir)
    nodes, edges = S.session_view(B.knowledge_graph(spark, sf_dir), events, 1)
    return S.style_counts(events, nodes, edges)


@query(f"WITH {FOLD} SELECT session_id, event_id, revision, current, message, percent, snapshot FROM fold")
def session_stream_fold(spark, sf_dir):
    """The streaming twin of session_fold, run to completion over the events file into the feed's table."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = shared_folder(spark, "session-stream")
    T.start(B.session_events(spark, sf_dir, stream), f"{at}/feed", f"{at}/checkpoint").awaitTermination()
    return T.feed(spark, f"{at}/feed").select("session_id", "event_id", "revision", "current", "message", "percent", "snapshot")


def _lived(spark, sf_dir) -> str:
    """A folder with the feed and the state of a stream over sessions' lives, stopped half-way and begun again."""
    at, events = shared_folder(spark, "session-lives"), B.lifecycle_events(spark, sf_dir)
    half = events.agg(F.max("event_id")).first()[0] // 2
    for part in (events.filter(F.col("event_id") <= half), events.filter(F.col("event_id") > half)):
        part.write.mode("append").parquet(f"{at}/in")
        T.start(spark.readStream.schema(events.schema).parquet(f"{at}/in"), f"{at}/feed", f"{at}/checkpoint").awaitTermination()
    return at


LIVES = EV.replace("ev AS (", "e0 AS (") + """,
e1 AS (SELECT * REPLACE (CASE WHEN kind = 'signup' AND event_id % 4 = 0 THEN 'delete' WHEN kind = 'signup' AND event_id % 4 = 1 THEN 'create' ELSE op END AS op) FROM e0),
e2 AS (SELECT *, lag(op) OVER (PARTITION BY session_id ORDER BY event_id) AS prior,
    coalesce(sum((op = 'delete')::INT) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e1),
e3 AS (SELECT * REPLACE (has_progress AND op = 'update' AS has_progress), min(event_id) OVER (PARTITION BY session_id, life) AS born, prior IS NOT NULL AND prior <> 'delete' AS there FROM e2)"""
LIVES_FOLD = LIVES + ", ev AS (SELECT * FROM e3 WHERE op NOT IN ('create', 'delete')), " + FOLD.split("FROM events),", 1)[1].replace("PARTITION BY session_id", "PARTITION BY session_id, life")


@query(f"""WITH {LIVES_FOLD}
SELECT session_id, event_id, 'session_update' AS event, born, revision, message, percent, snapshot FROM fold UNION ALL
SELECT session_id, event_id, 'session_deleted', born, -1, '', 0.0, false FROM e3 WHERE op = 'delete' AND there UNION ALL
SELECT session_id, event_id, 'session_created', born, 0, '', 0.0, false FROM e3 WHERE op = 'create' AND NOT there""")
def session_feed(spark, sf_dir):
    """What followers are told of every session, by a stream that is stopped and begun again."""
    return T.feed(spark, f"{_lived(spark, sf_dir)}/feed").select("session_id", "event_id", "event", "born", "revision", "message", "percent", "snapshot")


@query(f"""WITH {LIVES},
gone AS (SELECT session_id, max(event_id) AS d FROM e3 WHERE op = 'delete' GROUP BY session_id),
cut AS (SELECT session_id, max(event_id) AS c FROM e3 WHERE op IN ('delete', 'clear') GROUP BY session_id),
kept AS (SELECT e3.* FROM e3 LEFT JOIN gone USING (session_id) WHERE d IS NULL OR event_id > d),
live AS (SELECT kept.* FROM kept LEFT JOIN cut USING (session_id) WHERE op = 'update' AND (c IS NULL OR event_id > c)),
facts AS (SELECT session_id, event_id, kind AS name, k AS value FROM kept WHERE op IN ('update', 'create') UNION ALL SELECT session_id, event_id, 'even', (event_id % 2 = 0)::VARCHAR FROM kept WHERE op IN ('update', 'create')),
fact AS (SELECT session_id, name, arg_max(value, event_id) AS value FROM facts GROUP BY session_id, name)
SELECT session_id, 'session' AS kind, 'revision' AS key, count(*) FILTER (op IN ('update', 'clear'))::VARCHAR AS value FROM kept GROUP BY session_id UNION ALL
SELECT session_id, 'node', 'p:' || k, '{{"color":{{"background":"#ffd54f","border":"#ff6f00"}},"borderWidth":3,"stage":"' || arg_max(CASE WHEN kind = 'click' THEN 'current' ELSE 'previous' END, event_id) || '"}}' FROM live WHERE has_nodes GROUP BY session_id, k UNION ALL
SELECT session_id, 'edge', 'c:' || session_id || '|p:' || k || '|RELATED', CASE WHEN max(event_id) = any_value(m) THEN 'current' ELSE 'previous' END FROM (SELECT *, max(event_id) OVER (PARTITION BY session_id) AS m FROM live WHERE has_edges) GROUP BY session_id, k UNION ALL
SELECT session_id, 'metadata', '', '{{' || string_agg('"' || name || '":' || value, ',' ORDER BY name) || '}}' FROM fact GROUP BY session_id""")
def session_state(spark, sf_dir):
    """The sessions, full styles, edges and metadata that the stream's state holds at its end."""
    at = f"{_lived(spark, sf_dir)}/checkpoint"
    sessions = T.stored_sessions(spark, at).select("session_id", F.lit("session").alias("kind"), F.lit("revision").alias("key"), F.col("revision").cast("string").alias("value"))
    nodes = T.stored_nodes(spark, at).select("session_id", F.lit("node"), "id", T.full_style(F.col("style"), T.NODE_STYLE))
    edges = T.stored_edges(spark, at).select("session_id", F.lit("edge"), F.concat_ws("|", "source", "target", "relation"), "style")
    return sessions.union(nodes).union(edges).union(T.stored_metadata(spark, at).select("session_id", F.lit("metadata"), F.lit(""), "metadata"))


SEEK = FOLD + """,
req AS (SELECT session_id, revision AS r FROM fold WHERE revision % 7 = 0),
upto AS (SELECT q.r, f.* FROM req q JOIN fold f ON q.session_id = f.session_id AND f.revision <= q.r),
cl AS (SELECT session_id, r, max(revision) AS c FROM upto WHERE op = 'clear' GROUP BY session_id, r),
lv AS (SELECT upto.* FROM upto LEFT JOIN cl USING (session_id, r) WHERE op = 'update' AND (c IS NULL OR revision > c)),
fr AS (SELECT 'node' AS kind, session_id, r AS revision, 'p:' || k AS key, arg_max(CASE WHEN kind = 'click' THEN 'current' ELSE 'previous' END, revision) AS style FROM lv WHERE has_nodes GROUP BY session_id, r, k UNION ALL
  SELECT 'edge', session_id, r, 'c:' || session_id || '|p:' || k || '|RELATED', CASE WHEN max(revision) = any_value(m) THEN 'current' ELSE 'previous' END FROM (SELECT *, max(revision) OVER (PARTITION BY session_id, r) AS m FROM lv WHERE has_edges) GROUP BY session_id, r, k)"""


def _seventh(spark, sf_dir):
    """The sessions' history and every seventh revision of each."""
    events = B.session_events(spark, sf_dir)
    asked = S.folded(events).filter("revision % 7 = 0").select("session_id", "life", "revision")
    return H.history(events, 16), asked


@query(f"WITH {SEEK} SELECT kind, session_id, revision, key, style FROM fr")
def session_seek(spark, sf_dir):
    """What every session showed at every seventh revision."""
    kept, asked = _seventh(spark, sf_dir)
    return H.frames(kept, asked, 16).select("kind", "session_id", F.col("revision").cast("long").alias("revision"), F.concat_ws("|", "key").alias("key"), "style")


@query(f"""WITH {SEEK.replace("revision AS r FROM fold WHERE revision % 7 = 0", "unnest([revision - 1, revision]) AS r FROM fold WHERE revision % 7 = 0")},
n AS (SELECT * FROM fr WHERE revision % 7 = 0), p AS (SELECT * REPLACE (revision + 1 AS revision) FROM fr WHERE revision % 7 <> 0)
SELECT * FROM (SELECT kind, session_id, revision, key, CASE WHEN p.style IS NULL THEN 'added' WHEN n.style IS NULL THEN 'removed' WHEN n.style <> p.style THEN 'restyled' END AS change
FROM n FULL JOIN p USING (kind, session_id, revision, key)) WHERE change IS NOT NULL""")
def session_frame_changes(spark, sf_dir):
    """What each of these revisions changed."""
    kept, asked = _seventh(spark, sf_dir)
    return H.frame_changes(kept, asked, 16).select("kind", "session_id", F.col("revision").cast("long").alias("revision"), F.concat_ws("|", "key").alias("key"), "change")
