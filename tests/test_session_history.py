"""Frames at any revision against a replay in plain Python."""

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import history as H
from graphloom.streaming import sessions as S
from tests.test_session_store import made


def replayed(rows):
    """(session, life, revision) -> {(kind, key): style}."""
    state, out = {}, {}
    for session, _, op, nodes, edges, *_ in rows:
        life, revision, shown = state.get(session, (0, 0, {}))
        if op == "create":
            continue
        if op == "delete":
            state[session] = (life + 1, 0, {})
            continue
        shown, revision = dict(shown), revision + 1
        if op == "clear":
            shown = {}
        for i, style in nodes or []:
            shown["node", (i,)] = style
        if edges is not None:
            shown = {k: "previous" if k[0] == "edge" and v == "current" else v for k, v in shown.items()}
        for a, b, relation, style in edges or []:
            shown["edge", (a, b, relation or "RELATED")] = style or "current"
        state[session] = (life, revision, shown)
        out[session, life, revision] = shown
    return out


@pytest.mark.parametrize("every", [1, 3, 64])
def test_every_frame(spark, every):
    rows = [r for r in made(300) if r[2] != "create"]
    events = spark.createDataFrame(rows, S.EVENT_SCHEMA)
    want = replayed(rows)
    asked = spark.createDataFrame(list(want), "session_id string, life long, revision long")
    table = H.history(events, every).cache()
    got = {k: {} for k in want}
    for r in H.frames(table, asked, every).collect():
        frame = got[r["session_id"], r["life"], r["revision"]]
        assert (r["kind"], tuple(r["key"])) not in frame
        frame[r["kind"], tuple(r["key"])] = r["style"]
    assert got == want
    changes = {}
    for r in H.frame_changes(table, asked, every).collect():
        changes.setdefault((r["session_id"], r["life"], r["revision"]), {})[r["kind"], tuple(r["key"])] = r["change"]
    for (session, life, revision), now in want.items():
        before = want.get((session, life, revision - 1), {})
        told = {k: "added" for k in now.keys() - before.keys()} | {k: "removed" for k in before.keys() - now.keys()} | {k: "restyled" for k in now.keys() & before.keys() if now[k] != before[k]}
        assert changes.get((session, life, revision), {}) == told


def test_a_frame_is_read_from_its_span(spark):
    """However long a session is, a request meets what its span holds."""
    rows = [("s", i, "update", [(f"n{i}", "current")], None, None, None) if i % 50 else ("s", i, "clear", None, None, None, None) for i in range(1, 1001)]
    table = H.history(spark.createDataFrame(rows, S.EVENT_SCHEMA), 10)
    asked = spark.createDataFrame([("s", 0, 777)], "session_id string, life long, revision long")
    assert H.frames(table, asked, 10).count() == 27
    assert table.filter(F.col("span") == 77).count() == 29
