"""Hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import chat, graph as G, judge as J, merge as M, retrieve as R
from graphloom.operators.vector import VectorIndex
from graphloom.plans.pipeline import GraphPipeline, experiment
from graphloom.streaming import sessions as S


def make(spark, edges, nodes=()):
    e = spark.createDataFrame([(i, *x) if len(x) > 2 else (i, x[0], x[1], "") for i, x in enumerate(edges)], "edge_idx long, source string, target string, relation string")
    n = spark.createDataFrame([(i, *x) for i, x in enumerate(nodes)], "ord long, id string, text string")
    return G.PropertyGraph(G.as_nodes(n), G.as_edges(spark.createDataFrame([], G.EDGE_SCHEMA))).append_edges(e)


def column(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect()]


def index(spark, rows):
    return VectorIndex(spark.createDataFrame([(i, d, "{}", v, o) for o, (i, d, v) in enumerate(rows)], "id string, document string, metadata string, embedding array<float>, ord long"))


def test_cosine(spark):
    ix = index(spark, [("v1", "", [2.0, 0.0]), ("v2", "", [0.0, 3.0]), ("v3", "", [0.0, 0.0]), ("v4", "", [1.0, 0.0, 0.0])])
    got = column(ix.search([1.0, 0.0], 5).orderBy("rank"), "id", "distance")
    assert got == [("v1", 0.0), ("v2", 1.0), ("v3", 1.0)]
    assert ix.search([1.0, 0.0], 0).count() == 0
    assert ix.search("x", 5).count() == 0


def test_index_upsert(spark):
    ix = index(spark, [("a", "one", [1.0, 0.0])]).add(spark.createDataFrame([("a", "two"), ("b", "new")], "id string, document string"))
    got = {r["id"]: r for r in ix.rows.collect()}
    assert got["a"]["document"] == "two" and got["a"]["embedding"] == [1.0, 0.0] and got["b"]["embedding"] is None
    with pytest.raises(ValueError):
        ix.add(spark.createDataFrame([("a",)], "id string"))


def test_keyword(spark):
    nodes = spark.createDataFrame([("n1", "a CATalog", 0), ("n2", None, 1), ("n3", "cat", 2)], "id string, text string, ord long")
    got = column(R.keyword_seeds(nodes, "Cat cat dog", 5).orderBy("pos"), "id", "score")
    assert got == [("n1", pytest.approx(2 / 3)), ("n3", pytest.approx(2 / 3))]
    assert R.keyword_seeds(nodes, "  ", 5).count() == 0


def test_degree_and_hops(spark):
    g = make(spark, [("A", "B"), ("A", "B"), ("C", "C")])
    assert dict(column(G.degrees(g), "id", "degree")) == {"A": 2, "B": 2, "C": 2}
    g = make(spark, [("A", "B"), ("C", "B"), ("C", "D")])
    seeds = spark.createDataFrame([("A",)], "id string")
    for hops, want in ((0, "A"), (1, "AB"), (2, "ABC"), (3, "ABCD"), (9, "ABCD")):
        assert sorted(column(G.k_hop(g, seeds, hops), "id")) == list(want)
    assert G.induced(g, G.k_hop(g, seeds, 2)).edges.count() == 2


def test_upsert_keeps_place(spark):
    g = make(spark, [], [("a", "1"), ("b", "2")])
    g = g.upsert_nodes(spark.createDataFrame([("a", "new", 99)], "id string, text string, ord long"))
    assert column(g.nodes.orderBy("ord"), "id", "text") == [("a", "new"), ("b", "2")]


def test_stex_and_gcn(spark):
    g = make(spark, [("A", "C"), ("A", "C"), ("B", "C"), ("A", "D")], [(x, x) for x in "ABCDE"])
    got = spark.createDataFrame([("A", 0), ("B", 1)], "id string, pos long")
    assert sorted(column(R.stex(g, got, [1.0]), "id", "gs_score")) == [("C", 0.0), ("D", -1.0)]
    even = R.smoothed(spark.createDataFrame([("A", [1.0]), ("B", [3.0])], "id string, features array<double>"), make(spark, [("A", "B")]).edges)
    assert {k: v[0] for k, v in column(even, "id", "features")} == {"A": pytest.approx(1.7), "B": pytest.approx(3.0)}


def test_one_hop_order(spark):
    g = make(spark, [("A", "C"), ("B", "D"), ("B", "A"), ("A", "C")], [(x, x.lower()) for x in "ABCD"])
    seeds = spark.createDataFrame([(0, "B", 1.0), (1, "A", 0.5)], "pos int, id string, score double")
    x = R.one_hop_edges(g.edges, seeds)
    assert column(x.orderBy("pos", "edge_idx"), "source", "target") == [("B", "D"), ("B", "A"), ("A", "C"), ("A", "C")]
    nodes = R.one_hop_nodes(g.nodes, seeds, x)
    assert column(nodes.orderBy("place"), "id") == ["B", "A", "D", "C"]
    assert R.context(nodes).first()["chunks"] == ["[B] b", "[A] a", "[D] d", "[C] c"]


def test_collect_stops_at_hits(spark):
    nodes = [(f"n{i:02d}", f"cat {i}") for i in range(40)]
    g = make(spark, [(f"n{i:02d}", f"n{i + 15:02d}") for i in range(20)], nodes)
    hits = spark.createDataFrame([(i, *nodes[i]) for i in range(14)], "pos long, id string, text string")
    got = R.collect(g, "cat", [], hits, R.LexicalReranker()).collect()
    assert len(got) == 14 and sum(r["origin"] == "GS" for r in got) == 4
    few = R.collect(g, "cat", [], hits.limit(8), R.LexicalReranker(), gcn=True).collect()
    assert len(few) == 8 and all(r["origin"] == "VS" for r in few)


def _collected(nodes, edges, hits, vector, words, most, slide=R.SLIDE):
    """The rounds of ``collect`` in plain Python: (id, origin) in the final order."""
    text, emb, order = {i: t for i, t, _ in nodes}, {i: v for i, _, v in nodes}, []
    degree = {i: sum((a == i) + (b == i) for a, b in edges) for i in text}
    out = {i: {b for a, b in edges if a == i} for i in text}
    reranker = R.LexicalReranker()
    held = [(i, "VS") for i in hits[:slide]]
    while True:
        scores = reranker.logits(reranker.features(words, [text[i] for i, _ in held]))
        held = [held[k] for k in sorted(range(len(held)), key=lambda k: -scores[k])]
        if len(held) >= most:
            return held
        ids = {i for i, _ in held}
        r = len(ids)
        found = []
        for c in {t for i in ids for t in out[i]} - ids:
            near = sum(c in out[i] for i in ids)
            rank = 1 - r / (r - 1) if r > 1 else 0.0
            cap = min(degree[c], r)
            bridge = (near - 1) / (cap - 1) if cap > 1 else 0.0
            found.append((-(rank + bridge + sum(x * y for x, y in zip(emb[c], vector, strict=True))), degree[c], c))
        if not found:
            return held
        held += [(c, "GS") for *_, c in sorted(found)[: min(slide, most - len(held))]]


def test_collect_against_plain_python(spark):
    import random

    rng = random.Random(5)
    words = "cat dog bird fish cow".split()
    nodes = [(f"n{i:02d}", " ".join(rng.choices(words, k=rng.randint(1, 6))), [rng.choice([0.25, 0.5, 0.75, 1.0]) for _ in range(3)]) for i in range(60)]
    edges = [(rng.choice(nodes)[0], rng.choice(nodes)[0]) for _ in range(150)]
    rows = spark.createDataFrame([(o, *n) for o, n in enumerate(nodes)], "ord long, id string, text string, embedding array<float>")
    g = G.PropertyGraph(G.as_nodes(rows), G.as_edges(spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "edge_idx long, source string, target string")))
    for most in (7, 25, 60):
        hits = spark.createDataFrame([(p, i, t) for p, (i, t, _) in enumerate(nodes[:most])], "pos long, id string, text string")
        got = R.collect(g, "cat bird", [1.0, 0.5, 0.25], hits, R.LexicalReranker()).orderBy("place").collect()
        assert [(r["id"], r["origin"]) for r in got] == _collected(nodes, edges, [i for i, _, _ in nodes[:most]], [1.0, 0.5, 0.25], "cat bird", most)


def test_triples(spark):
    t = spark.createDataFrame([("(a; r; b;c)(; r; x)(p; q)",)], "t string")
    assert [tuple(r) for r in t.select(F.explode(M.parsed_triples(F.col("t"))).alias("x")).select("x.*").collect()] == [("a", "r", "b;c")]
    facts = spark.createDataFrame([("('alice', 'knows', 'bob')",), ("oops",), ("('a', 'b')",)], "c string")
    assert [r["t"]["head"] for r in facts.select(M.fact_triple("c").alias("t")).collect()] == ["alice", None, None]


def test_merge(spark):
    e = spark.createDataFrame([("A", "rel", "B", w, i) for i, w in enumerate((1.0, 3.0, 2.0))], "source string, relation string, target string, weight double, edge_idx long")
    assert column(M.merge_edges(e), "weight") == [3.0]
    names = spark.createDataFrame([(" ALICE  b",), ("nobody",)], "name string")
    entities = spark.createDataFrame([("e2", "alice b", 1), ("e1", "Alice  B", 0)], "id string, text string, ord long")
    got = dict(column(M.resolve_names(names, entities), "name", "resolved"))
    assert got[" ALICE  b"] == "e1" and got["nobody"].startswith("entity-")


def test_winners(spark):
    cases = {"Answer 1 or Answer 2": 1, "TIE": 0, "2": 2, "x": None, "Answer1": 1, "a": 1, " B ": 2, "answer2": 2, "Both": 0, "draw": 0, "2.0": None, "true": None, "answer  2": 2}
    t = spark.createDataFrame(list(cases.items()), "v string, w int")
    assert [(r["v"], r["got"]) for r in t.select("v", J.winner(F.col("v")).alias("got")).collect()] == list(cases.items())
    cases = {"1": 1, "2.0": 2, "2.9": 2, "3": None, "true": 1, "false": None, "null": None, '"tie"': 0, '["Answer 1"]': 1, "-1": None}
    bodies = [(f'{{"Overall Winner": {{"Winner": {v}}}}}', w) for v, w in cases.items()]
    bodies += [
        ('```json\n{"overall winner": {"Winner": "Answer 2"}}\n```', 2),
        ('{"Overall Winner": "Answer 1", "x', None),
        ('{"Overall Winner": "draw"}', None),
        ('{"Overall Winner": {"Winner": "Answer 1", "x', 1),
        ('{"Overall Winner": {"Why": 1}, "overall winner": {"Winner": "1"}}', None),
        ('{"Overall Winner": "none", "OVERALL WINNER": {"Winner": "1"}}', 1),
        ("[1]", None),
        (None, None),
    ]
    c = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, content string")
    got = J.criteria_winners(c, "i").filter("criterion = 'Overall Winner'").orderBy("i").collect()
    assert [r["winner"] for r in got] == [w for _, w in bodies]
    rows = spark.createDataFrame([("p", "c", 1), ("p", "c", J_flip(2)), ("p", "c", 0), ("p", "c", None)], "pair_id string, criterion string, winner int")
    r = J.win_rates(rows).filter("pair_id is not null").first()
    assert (r["answer1"], r["tie"], r["invalid"], r["answer1_pct"], r["tie_pct"]) == (2, 1, 1, 66.67, 33.33)


def J_flip(w):
    return 3 - w


def test_pairs(spark):
    left = spark.createDataFrame([("q1", "a", 0), ("q2", "b", 1)], "query string, answer string, ord long")
    right = spark.createDataFrame([("q2", "y", 0), ("q1", "x", 1), ("q3", "z", 2)], "query string, answer string, ord long")
    got = column(J.request_pairs(left, right, 1).orderBy("custom_id"), "custom_id", "answer_a", "answer_b")
    assert got == [("judge-000000-for", "a", "x"), ("judge-000000-rev", "x", "a")]


def test_chat(spark):
    p = spark.createDataFrame([('{"query": " hi ", "top_k": "x", "embedding": {"provider": "OpenAI", "error_policy": "soft"}, "history": [{"role": "boss", "text": "t"}, {"role": "user", "content": " "}]}',), ("{}",)], "payload string")
    a, b = chat.requests(p).collect()
    assert (a["message"], a["top_k"], a["embedding_provider"], a["embedding_error_policy"], len(a["history"]), a["history"][0]["role"]) == ("hi", 5, "openai", "fallback", 1, "user")
    assert not b["valid"] and b["embedding_model"] == chat.MODEL


def test_sessions(spark):
    rows = [("s", 0, "update", None, None, '{"a": 1}', None), ("s", 1, "update", [("n", "current")], None, None, (1, 0, "m")), ("s", 2, "update", None, [("a", "b", None, None)], None, (300, 100, None)), ("s", 3, "update", None, [("b", "c", "r", "current")], None, None), ("s", 4, "update", None, None, None, (100, 100, None))]
    events = spark.createDataFrame(rows, S.EVENT_SCHEMA)
    got = S.folded(events).orderBy("event_id").collect()
    assert [r["percent"] for r in got] == [0.0, 0.0, 100.0, 100.0, 100.0]
    assert [r["snapshot"] for r in got] == [False, True, True, True, False]
    assert sorted(column(S.overlay_edges(events), "source", "relation", "style")) == [("a", "RELATED", "previous"), ("b", "r", "current")]
    cleared = events.union(spark.createDataFrame([("s", 9, "clear", None, None, None, None)], S.EVENT_SCHEMA))
    assert S.overlay_nodes(cleared).count() == 0 and S.replay(S.folded(cleared)).count() == 0
    assert S.session_metadata(cleared).first()["metadata"] == '{"a":1}'
    assert S.folded(cleared).orderBy(F.desc("event_id")).first()["percent"] == 100.0


def test_pipeline(spark):
    g = make(spark, [("A", "B")], [("A", "cat food"), ("B", "dog")])
    p = GraphPipeline()
    got = p.run(g, {"message": "cat", "retrieval": "graph-hop"})
    assert got["retrieval"] == "one-hop" and got["chunks"] == ["[A] cat food", "[B] dog"]
    out = experiment({"g": g}, ["vector", "hybrid"], ["cat"], p)
    assert out[0]["outputs"] == "[A] cat food" and out[1]["outputs"].startswith("ERROR: NotImplementedError")
    assert R.embed_query("x", lambda q: 1 / 0, "soft") == []
    with pytest.raises(RuntimeError):
        R.embed_query("x", lambda q: 1 / 0)


def test_registry():
    r = G.GraphRegistry()
    r.register("a", G.PropertyGraph(None, None), "Attribute-Bundle")
    assert r.unique_name("a") == "a_2" and r.active == "a" and r.listed()[0]["graph_type"] == "attribute_bundle_graph"
    with pytest.raises(KeyError):
        r.switch("b")
    assert X.prettified("/data/scene_graphs-v2/QA") == "QA" and X.prettified("scene_graphs") == "Scene Graphs"


def test_session_view(spark):
    g = make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], [(i, i) for i in "abcdxy"])
    events = spark.createDataFrame(
        [
            ("s", 1, "update", [("a", "current")], None, None, None),
            ("s", 2, "update", [("b", "previous")], [("x", "y", None, None)], None, None),
            ("e", 1, "update", None, [("c", "d", "r", "previous"), ("no", "node", None, None)], None, None),
            ("gone", 1, "update", [("a", "current")], None, None, None),
            ("gone", 2, "delete", None, None, None, None),
            ("bare", 1, "clear", None, None, None, None),
        ],
        S.EVENT_SCHEMA,
    )
    nodes, edges = S.session_view(g, events, 1)
    shown = lambda s: sorted(r["id"] for r in nodes.filter(F.col("session_id") == s).collect())
    assert (shown("s"), shown("e"), shown("gone"), shown("bare")) == (list("abcxy"), list("bcd"), [], [])
    styles = {(r["session_id"], r["source"], r["target"]): r["style"] for r in edges.collect()}
    assert styles["s", "a", "b"] == "current" and styles["s", "b", "c"] is None and ("s", "c", "d") not in styles
    counts = {r["session_id"]: tuple(r)[1:] for r in S.view_counts(events, nodes, edges).collect()}
    assert counts == {"s": (2, 5, 3, 2, 1), "e": (1, 3, 2, 0, 2), "bare": (1, 0, 0, 0, 0)}
    asked = spark.createDataFrame([("s", 2), ("e", 0), ("gone", 2), ("never", None)], "session_id string, since_revision long")
    assert sorted(tuple(r) for r in S.polled(events, asked).collect()) == [("e", True, 1, True), ("gone", False, -1, True), ("never", False, -1, True), ("s", True, 2, False)]


def test_session_event_constructors(spark):
    rows = spark.createDataFrame([("s", 1, ["a", "b"], None, "seeds"), ("s", 2, None, None, ""), ("s", 3, ["a"], "previous", None)], "session_id string, event_id long, node_ids array<string>, style string, message string")
    made = S.record_events(rows)
    done = S.progress_events(spark.createDataFrame([("s", 4, 3, 4, None)], "session_id string, event_id long, current long, total long, message string"))
    found = S.search_events(spark.createDataFrame([("s", 5, ["c", None], [("a", "c", None), (None, "c", "r")]), ("s", 6, None, None)], "session_id string, event_id long, seed_nodes array<string>, one_hop_edges array<struct<source:string,target:string,relation:string>>"))
    events = made.unionByName(done).unionByName(found)
    assert {(r["id"], r["style"]) for r in S.overlay_nodes(events).collect()} == {("a", "previous"), ("b", "current"), ("c", "current")}
    assert [tuple(r) for r in S.overlay_edges(events).collect()] == [("s", "a", "c", "RELATED", "previous")]
    fold = S.folded(events).orderBy("event_id").select("message", "percent", "snapshot").collect()
    assert [tuple(r) for r in fold] == [("seeds", 0.0, True), ("seeds", 0.0, False), ("seeds", 0.0, True), ("", 75.0, True), ("", 75.0, True), ("", 75.0, True)]


def test_distinct_steps_and_stages(spark):
    steps = spark.createDataFrame([("s", 0, None), ("s", 1, None), ("s", 2, "x"), ("s", 3, "x"), ("s", 4, None), ("t", 0, "x")], "session_id string, step long, message string")
    assert sorted((r["session_id"], r["step"]) for r in S.distinct_steps(steps, "message").collect()) == [("s", 0), ("s", 2), ("s", 4), ("t", 0)]
    said = spark.createDataFrame([("Answer generated.",), ("generating answer",), ("Retrieval complete: 5",), ("",), (None,)], "m string")
    assert [r[0] for r in said.select(S.stage(F.col("m"))).collect()] == ["generated", "generating", "retrieved", "retrieving", "retrieving"]
