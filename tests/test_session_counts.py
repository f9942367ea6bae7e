"""Counts of a session's view: the view is made once."""

from graphloom.plans import catalog, testbed as B
from graphloom.streaming import sessions as S
from tests.test_catalog import SF, duck, pytestmark, rows  # noqa: F401


def test_the_view_is_made_once(spark, duck):  # noqa: F811
    frame = catalog.QUERIES["session_view_counts"](spark, SF)
    assert rows(frame.toPandas()) == rows(duck.execute(catalog.ORACLES["session_view_counts"]).df())
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join LeftOuter" in x and "relation#" in x for x in plan.splitlines()) == 1


def test_counts_are_those_of_the_view(spark):
    events = B.session_events(spark, SF)
    nodes, edges = S.session_view(B.knowledge_graph(spark, SF), events, 1)
    got = {r["session_id"]: r for r in S.style_counts(events, nodes, edges).collect()}
    styled = {r[0]: r[1] for r in edges.filter("style is not null").groupBy("session_id").count().collect()}
    current = {r[0]: r[1] for r in nodes.filter("style = 'current'").groupBy("session_id").count().collect()}
    assert all((r["styled_edges"], r["current_nodes"]) == (styled.get(s, 0), current.get(s, 0)) for s, r in got.items()) and current
