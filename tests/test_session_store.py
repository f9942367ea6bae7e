"""Sessions as the state of a stream: feed, restarts, state read back, keep-alives, polls."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import sessions as S
from graphloom.streaming import store as T

STYLED = '{"color": {"color": "#1565C0"}, "width": 9}'


def made(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        op = rng.choice(["update"] * 12 + ["clear", "delete", "create"])
        nodes = [(f"n{rng.randint(0, 6)}", rng.choice(["current", "previous", '{"borderWidth": 1}', None])) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else None
        edges = [(f"n{rng.randint(0, 3)}", f"n{rng.randint(0, 3)}", rng.choice([None, "r"]), rng.choice([None, "current", STYLED])) for _ in range(rng.randint(0, 2))] if rng.random() < 0.4 else None
        metadata = json.dumps({rng.choice("abç\""): rng.choice([1, 1.5, True, None, "x", [1, {"y": "z"}]])}) if rng.random() < 0.5 else None
        progress = (rng.choice([None, rng.randint(0, 120)]), rng.choice([None, 0, 100]), rng.choice([None, "m"])) if rng.random() < 0.4 else None
        rows.append((f"s{rng.randint(0, 5)}", i, op, *((None, None) if op != "update" else (nodes, edges)), metadata if op in ("update", "create") else None, progress if op == "update" else None))
    return rows


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """The stream over two files, stopped and begun again between them."""
    at = tmp_path_factory.mktemp("feed")
    rows = made()
    incoming, table, checkpoint = (str(at / x) for x in ("in", "feed", "checkpoint"))
    for part in (rows[:130], rows[130:]):
        spark.createDataFrame(part, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        run = T.start(spark.readStream.schema(S.EVENT_SCHEMA).parquet(incoming), table, checkpoint)
        run.awaitTermination()
    return spark.createDataFrame(rows, S.EVENT_SCHEMA), table, checkpoint


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_feed_equals_the_batch(spark, ran):
    events, table, _ = ran
    columns = [c.split()[0] for c in T.FEED.split(", ")]
    got, want = T.feed(spark, table).select(columns), T.feed_batch(events).select(columns)
    assert rows_of(got) == rows_of(want) and {r["event"] for r in got.collect()} == {T.UPDATED, T.DELETED, T.CREATED}


def test_a_repeated_batch_is_there_once(spark, ran, tmp_path):
    """A version without its success file does not count; written anew it does."""
    import shutil

    _, table, _ = ran
    copy = str(tmp_path / "feed")
    shutil.copytree(table, copy)
    before = T.feed(spark, copy).count()
    first = T.feed(spark, copy).filter(F.input_file_name().contains("version=0")).count()
    (tmp_path / "feed" / "version=0" / "_SUCCESS").unlink()
    assert T.feed(spark, copy).count() == before - first
    spark.read.schema(T.FEED).parquet(f"{table}/version=0").write.mode("overwrite").parquet(f"{copy}/version=0")
    assert T.feed(spark, copy).count() == before


def test_state_equals_the_overlays(spark, ran):
    events, _, checkpoint = ran
    live = T.stored_sessions(spark, checkpoint)
    assert {r[0] for r in live.select("session_id").collect()} == {r[0] for r in S.live_sessions(events).select("session_id").collect()}
    assert rows_of(T.stored_nodes(spark, checkpoint)) == rows_of(S.overlay_nodes(events))
    plain = S.overlay_edges(events).withColumn("style", F.col("style"))
    own = {tuple(r[:4]): r[4] for r in T.stored_edges(spark, checkpoint).collect()}
    for r in plain.collect():
        style = own.pop(tuple(r[:4]))
        assert style == r["style"] or json.loads(style) == {"color": {"color": "#4caf50", "highlight": "#4caf50"}, "width": 9} or style == STYLED
    assert not own
    meta = lambda frame: {r["session_id"]: json.loads(r["metadata"]) for r in frame.collect()}
    assert meta(T.stored_metadata(spark, checkpoint)) == meta(S.session_metadata(events)) and meta(S.session_metadata(events))


def test_followers(spark, ran):
    events, table, checkpoint = ran
    revision = {r["session_id"]: r["revision"] for r in T.stored_sessions(spark, checkpoint).collect()}
    some = next(iter(revision))
    asked = spark.createDataFrame([(s, r - 1) for s, r in revision.items()] + [("none", 3)], "session_id string, since long")
    assert {tuple(r) for r in T.followed(T.feed(spark, table), asked).collect()} == {(s, T.UPDATED, r) for s, r in revision.items()} | {("none", T.DELETED, -1)}
    assert T.wait(spark, table, some, revision[some], timeout=0.1) == {"exists": True, "revision": revision[some], "timeout": True}
    assert T.wait(spark, table, some, -5)["revision"] == revision[some]
    assert T.wait(spark, table, "none", 0) == {"exists": False, "revision": -1}


def test_quiet_sessions_are_told_to_be_alive(spark, tmp_path):
    rows = [("a", 0, "create", None, None, None, None), ("b", 1, "update", None, None, None, None), ("b", 2, "delete", None, None, None, None)]
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = T.start(spark.readStream.schema(S.EVENT_SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "feed"), str(tmp_path / "c"), quiet=0.5, processingTime="500 milliseconds")
    ends = time.monotonic() + 60
    alive = T.feed(spark, str(tmp_path / "feed")).filter(F.col("event") == T.KEEP_ALIVE)
    while time.monotonic() < ends and alive.isEmpty():
        time.sleep(0.5)
        alive = T.feed(spark, str(tmp_path / "feed")).filter(F.col("event") == T.KEEP_ALIVE)
    assert run.exception() is None
    assert {tuple(r) for r in alive.select("session_id", "revision").collect()} == {("a", 0)}
    run.stop()


def test_styles(spark):
    frame = spark.createDataFrame([("current",), (None,), ('{"borderWidth": 1, "color": "red"}',), (STYLED,)], "style string")
    full = [json.loads(r[0]) for r in frame.select(T.full_style(F.col("style"), T.NODE_STYLE)).collect()]
    color = {"background": "#ffd54f", "border": "#ff6f00"}
    assert full[:3] == [{"color": color, "borderWidth": 3, "stage": "current"}, {"color": color, "borderWidth": 3}, {"color": "red", "borderWidth": 1}]
    down = [r[0] for r in frame.select(T.demoted(F.col("style"))).collect()]
    assert down[:2] == ["previous", None] and json.loads(down[3])["color"]["color"] == "#4caf50" and json.loads(down[3])["width"] == 9
