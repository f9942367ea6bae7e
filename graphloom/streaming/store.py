"""Session overlays as the state of a stream, and the feed of their revisions.

``SessionState`` keeps, for each session, its head (revision, progress), the styles of its nodes and
edges and its metadata in keyed state, so a trigger touches only what its events change.  The
stream's output is the feed: one row per event that a session's followers are told of.

The feed is written by ``foreachBatch`` into a versioned table: a batch has a folder of its own,
which is written anew when a batch is repeated after a failure, and counts once its success file
is there.  So every event is in the feed exactly once, over any number of restarts.

The state itself is read back with Spark's state data source (``stored_*``).

Events are those of ``streaming.sessions`` and the op ``create``, which begins a session with
metadata at revision 0.  A session that exists is not created again; an update or clear of one
that does not begins it, as in the batch folds; a delete of one that does not tells nothing.
Within a trigger a session's events go by event_id.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from graphloom.sources.base import members, merged_json
from graphloom.streaming.sessions import CURRENT, DEFAULT_RELATION, PREVIOUS, advance, folded

UPDATED, DELETED, CREATED, KEEP_ALIVE = "session_update", "session_deleted", "session_created", "keep_alive"
FEED = "session_id string, event_id long, event string, born long, revision long, current int, total int, message string, percent double, snapshot boolean"
#: What a style is merged over.
NODE_STYLE = '{"color": {"background": "#ffd54f", "border": "#ff6f00"}, "borderWidth": 3}'
EDGE_STYLE = '{"width": 3}'
CURRENT_COLOR = '{"color": "#1565c0", "highlight": "#1565c0"}'
PREVIOUS_COLOR = '{"color": "#4caf50", "highlight": "#4caf50"}'
#: Seconds after which the followers of a quiet session are told that it is alive, and the longest wait of a poll.
QUIET = 20.0

HEAD = "born long, revision long, current int, total int, message string, percent double, taken boolean, edges_at long"
#: What ``parts`` has beside the session, as it is read.
PARTS = ("event_id", "i", "op", "with_nodes", "with_edges", "with_progress", "current", "total", "message", "part", "a", "b", "c", "v")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parts(events: DataFrame) -> DataFrame:
    """Events as flat rows: one for the event itself, then one for each node, edge and member of the metadata."""
    kind = "struct<part:string,a:string,b:string,c:string,v:string>"
    row = lambda part, a, b, c, v: F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), v.alias("v")).cast(kind)
    none = F.lit(None).cast("string")
    of = lambda items, f: F.coalesce(F.transform(items, f), F.array().cast(f"array<{kind}>"))
    metadata = F.map_entries(members(F.col("metadata")))
    all_parts = F.concat(
        F.array(row("event", none, none, none, none)),
        of(F.col("nodes"), lambda n: row("node", n["id"], none, none, n["style"])),
        of(F.col("edges"), lambda e: row("edge", e["source"], e["target"], F.coalesce(e["relation"], F.lit(DEFAULT_RELATION)), F.coalesce(e["style"], F.lit(CURRENT)))),
        of(metadata, lambda m: row("member", m["key"], none, none, F.to_json(m["value"]))),
    )
    rows = events.select("session_id", "event_id", "op", F.col("nodes").isNotNull().alias("with_nodes"), F.col("edges").isNotNull().alias("with_edges"), F.col("progress").isNotNull().alias("with_progress"), "progress.current", "progress.total", "progress.message", F.posexplode(all_parts).alias("i", "p"))
    return rows.select("session_id", "event_id", "op", "with_nodes", "with_edges", "with_progress", F.col("current").cast("double").alias("current"), F.col("total").cast("double").alias("total"), "message", "i", "p.part", "p.a", "p.b", "p.c", "p.v")


class SessionState(StatefulProcessor):
    """The state of one session: head, nodes, edges, metadata."""

    def __init__(self, quiet: float | None = None):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.nodes = handle.getMapState("nodes", "id string", "style string")
        self.edges = handle.getMapState("edges", "source string, target string, relation string", "style string, event_id long")
        self.metadata = handle.getMapState("metadata", "name string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Plain lists: frames of a few rows cost more by far than what is done with them.
        columns: list[list] = [[] for _ in PARTS]
        for frame in rows:
            for column, name in zip(columns, PARTS, strict=True):
                column.extend(frame[name].tolist())
        head, emptied, forgotten, out = self.head.get(), -1, -1, []
        nodes, edges, members_ = {}, {}, {}
        given = lambda x: None if x is None or x != x else x
        whole = lambda x: None if x is None or x != x else int(x)
        for at, _, op, with_nodes, with_edges, with_progress, current, total, message, part, a, b, c, v in sorted(zip(*columns, strict=True), key=lambda r: r[:2]):
            # Only an update gives nodes and edges; a session is created with metadata too.
            if part == "node":
                if op == "update" and at > emptied:
                    nodes[a] = given(v)
            elif part == "edge":
                if op == "update" and at > emptied:
                    edges[a, b, c] = (v, at)
            elif part == "member":
                if op in ("update", "create") and at > forgotten:
                    members_[a] = v
            elif op == "delete":
                if head is not None:
                    out.append((key[0], at, DELETED, head[0], -1, 0, 0, "", 0.0, False))
                head, emptied, forgotten = None, at, at
                nodes, edges, members_ = {}, {}, {}
            elif op == "create":
                if head is None:
                    head = (at, 0, 0, 0, "", 0.0, False, None)
                    out.append((key[0], at, CREATED, at, 0, 0, 0, "", 0.0, False))
            else:
                born, *state, edges_at = head or (at, 0, 0, 0, "", 0.0, False, None)
                progress = {"current": whole(current), "total": whole(total), "message": given(message)} if with_progress else None
                state, shown = advance(tuple(state), {"op": op, "progress": progress, "nodes": with_nodes or None, "edges": with_edges or None})
                if op == "clear":
                    emptied, edges_at = at, None
                    nodes, edges = {}, {}
                elif with_edges:
                    edges_at = at
                head = (born, *state, edges_at)
                out.append((key[0], at, UPDATED, born, *shown))
        if emptied >= 0:
            self.nodes.clear()
            self.edges.clear()
        if forgotten >= 0:
            self.metadata.clear()
        for id_, style in nodes.items():
            self.nodes.updateValue((id_,), (style,))
        for edge, value in edges.items():
            self.edges.updateValue(edge, value)
        for name, value in members_.items():
            self.metadata.updateValue((name,), (value,))
        if head is None:
            self.head.clear()
        else:
            self.head.update(head)
        if self.quiet:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if head is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            born, revision, current, total, message, percent, *_ = self.head.get()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000))
            yield pd.DataFrame([(key[0], None, KEEP_ALIVE, born, revision, current, total, message, percent, False)], columns=[c.split()[0] for c in FEED.split(", ")])

    def close(self) -> None:
        pass


def feed_of(events: DataFrame, quiet: float | None = None) -> DataFrame:
    """The feed of a stream of events.  ``quiet``: seconds after which an unchanged session is told to be alive; none without."""
    return parts(events).groupBy("session_id").transformWithStateInPandas(SessionState(quiet), FEED, "append", "processingTime" if quiet else "none")


def start(events: DataFrame, table: str, checkpoint: str, quiet: float | None = None, **trigger) -> StreamingQuery:
    """Run the feed of ``events`` into the versioned ``table``; both paths lie in a folder that all executors share."""
    spark = events.sparkSession
    # Keyed state of several variables needs this provider; a running query keeps the one that it began with.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")

    return feed_of(events, quiet).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def feed(spark: SparkSession, table: str) -> DataFrame:
    """The feed's rows: the versions that are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = [f.getPath().getParent().toString() for f in found]
    return spark.read.schema(FEED).parquet(*paths) if paths else spark.createDataFrame([], FEED)


def followed(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """session_id, event, revision: what followers (session_id, since) of the feed ``rows`` are sent.

    The latest revision where it is not the one they have, or that the session is gone or never was."""
    told = rows.filter(F.col("event") != KEEP_ALIVE)
    last = told.groupBy("session_id").agg(F.max_by(F.struct("event", "revision"), "event_id").alias("last"))
    answers = asked.select("session_id", "since").join(last, "session_id", "left")
    gone = F.col("last").isNull() | (F.col("last.event") == DELETED)
    sent = answers.select("session_id", "since", F.when(gone, DELETED).otherwise(UPDATED).alias("event"), F.when(gone, F.lit(-1)).otherwise(F.col("last.revision")).alias("revision"))
    return sent.filter((F.col("event") == DELETED) | (F.col("revision") != F.col("since"))).select("session_id", "event", "revision")


def wait(spark: SparkSession, table: str, session_id: str, since: int, timeout: float = QUIET, pause: float = 0.25) -> dict:
    """exists, revision and, if nothing changed until then, timeout: a poll that waits for another revision of one session."""
    ends = time.monotonic() + max(0.1, float(timeout))
    asked = spark.createDataFrame([(session_id, since)], "session_id string, since long")
    while True:
        row = followed(feed(spark, table), asked).first()
        if row is not None:
            return {"exists": row["event"] != DELETED, "revision": row["revision"]}
        if time.monotonic() >= ends:
            return {"exists": True, "revision": since, "timeout": True}
        time.sleep(pause)


def feed_batch(events: DataFrame) -> DataFrame:
    """The feed of all ``events`` at once, by windows: what a stream over them tells."""
    by = Window.partitionBy("session_id").orderBy("event_id")
    marked = events.withColumns({"_before": F.lag("op").over(by), "_life": F.coalesce(F.sum((F.col("op") == "delete").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    marked = marked.withColumns({"_born": F.min("event_id").over(Window.partitionBy("session_id", "_life")), "_there": F.col("_before").isNotNull() & (F.col("_before") != "delete")})
    fold = folded(events.filter("op != 'create'")).select("session_id", "event_id", "revision", "current", "total", "message", "percent", "snapshot")
    told = marked.filter((F.col("op").isin("update", "clear")) | ((F.col("op") == "delete") & F.col("_there")) | ((F.col("op") == "create") & ~F.col("_there")))
    name = F.when(F.col("op") == "delete", DELETED).when(F.col("op") == "create", CREATED).otherwise(UPDATED)
    rows = told.select("session_id", "event_id", name.alias("event"), F.col("_born").alias("born")).join(fold, ["session_id", "event_id"], "left")
    none = {"revision": F.when(F.col("event") == DELETED, -1).otherwise(0), "current": F.lit(0), "total": F.lit(0), "message": F.lit(""), "percent": F.lit(0.0), "snapshot": F.lit(False)}
    return rows.select("session_id", "event_id", "event", "born", *[F.coalesce(F.col(c), v).alias(c) for c, v in none.items()])


# --- the state, read back ------------------------------------------------------------------------


def _stored(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def stored_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, born, revision, current, total, message, percent: the sessions that exist."""
    return _stored(spark, checkpoint, "head").select("key.session_id", "value.born", "value.revision", "value.current", "value.total", "value.message", "value.percent")


def stored_nodes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, id, style as it was given."""
    return _stored(spark, checkpoint, "nodes").select("key.session_id", "user_map_key.id", "user_map_value.style")


def stored_edges(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, source, target, relation, style: current ones that are not of the last batch of edges are previous."""
    last = _stored(spark, checkpoint, "head").select("key.session_id", "value.edges_at")
    rows = _stored(spark, checkpoint, "edges").select("key.session_id", "user_map_key.*", "user_map_value.style", "user_map_value.event_id")
    earlier = F.col("event_id") < F.col("edges_at")
    return rows.join(last, "session_id").select("session_id", "source", "target", "relation", F.when(earlier, demoted(F.col("style"))).otherwise(F.col("style")).alias("style"))


def stored_metadata(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, metadata: a JSON object with the members in order of their names."""
    rows = _stored(spark, checkpoint, "metadata").select("key.session_id", "user_map_key.name", "user_map_value.value")
    listed = F.array_sort(F.collect_list(F.struct("name", "value")))
    member = lambda m: F.concat(F.regexp_replace(F.to_json(F.array(m["name"])), r"^\[|\]$", ""), F.lit(":"), m["value"])
    return rows.groupBy("session_id").agg(listed.alias("m")).select("session_id", F.concat(F.lit("{"), F.array_join(F.transform("m", member), ","), F.lit("}")).alias("metadata"))


# --- styles --------------------------------------------------------------------------------------


def _is_object(style: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(style)).startswith("OBJECT"), F.lit(False))


def demoted(style: Column) -> Column:
    """The style of a current edge once others follow it: the word, or the color of a JSON object's; others stay."""
    current = F.lower(F.trim(F.get_json_object(style, "$.color.color"))) == F.get_json_object(F.lit(CURRENT_COLOR), "$.color")
    return F.when(style == CURRENT, PREVIOUS).when(F.coalesce(current, F.lit(False)), merged_json(style, F.lit(f'{{"color": {PREVIOUS_COLOR}}}'))).otherwise(style)


def full_style(style: Column, default: str) -> Column:
    """A JSON object: the default with the members of the style over it; a stage's word gives the default's with that stage."""
    own = F.when(_is_object(style), style).otherwise(F.to_json(F.create_map(F.lit("stage"), style)))
    return merged_json(F.lit(default), F.when(style.isNotNull(), own))
