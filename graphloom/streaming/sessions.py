"""Session overlays as folds over update events in batch, by windows; ``streaming.store`` keeps them as the state of a stream.

Events: session_id, event_id, op (update, clear, delete; create, see ``streaming.store``), nodes array<struct<id, style>>, edges
array<struct<source, target, relation, style>>, metadata (JSON), progress struct<current, total,
message>.  Events of a session are ordered by event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph, cut, k_hop, labels, view_seeds
from graphloom.sources.base import members

EVENT_SCHEMA = "session_id string, event_id long, op string, nodes array<struct<id:string,style:string>>, edges array<struct<source:string,target:string,relation:string,style:string>>, metadata string, progress struct<current:int,total:int,message:string>"
DEFAULT_RELATION = "RELATED"
#: Styles of the last step's edges and of earlier ones.
CURRENT, PREVIOUS = "current", "previous"
REPLAY_LIMIT = 360


def percent(current: Column, total: Column) -> Column:
    """Progress clamped to 0 to 100; null without a total."""
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), current / total * 100.0)))


def folded(events: DataFrame) -> DataFrame:
    """One row per event: revision, carried progress, percent change and whether it is a replay snapshot.

    A delete ends a session; its later events start a new one (``life``).  A snapshot is taken
    when nodes, edges or progress are given and the percentage changed, nodes or edges are given,
    or none has been taken since the start or the last clear."""
    by = Window.partitionBy("session_id").orderBy("event_id")
    rows = events.withColumn("life", F.coalesce(F.sum((F.col("op") == "delete").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("op != 'delete'")
    life = Window.partitionBy("session_id", "life").orderBy("event_id")
    upto = life.rowsBetween(Window.unboundedPreceding, 0)
    given = F.col("progress").isNotNull() & (F.col("op") == "update")
    carried = lambda field, default: F.coalesce(F.last(F.when(given, F.col(f"progress.{field}")), ignorenulls=True).over(upto), F.lit(default))
    rows = rows.withColumns({"revision": F.row_number().over(life), "current": carried("current", 0), "total": carried("total", 0), "message": carried("message", "")})
    rows = rows.withColumn("percent", F.coalesce(F.last(F.when(given, percent(F.col("current"), F.col("total"))), ignorenulls=True).over(upto), F.lit(0.0)))
    rows = rows.withColumns({"percent_before": F.coalesce(F.lag("percent").over(life), F.lit(0.0)), "clears": F.sum((F.col("op") == "clear").cast("int")).over(upto)})
    overlay = F.col("nodes").isNotNull() | F.col("edges").isNotNull()
    may = (F.col("op") == "update") & (overlay | F.col("progress").isNotNull())
    since = Window.partitionBy("session_id", "life", "clears").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.max(may.cast("int")).over(since), F.lit(0)) == 0
    changed = F.abs(F.col("percent") - F.col("percent_before")) > 1e-9
    return rows.withColumn("snapshot", may & (changed | overlay | first))


def replay(fold: DataFrame, limit: int = REPLAY_LIMIT) -> DataFrame:
    """The last ``limit`` snapshots of each session since its last clear: session_id, step, revision, percent."""
    whole = Window.partitionBy("session_id")
    last = fold.withColumn("_l", F.max(F.struct("life", "clears")).over(whole)).filter((F.col("life") == F.col("_l.life")) & (F.col("clears") == F.col("_l.clears")) & F.col("snapshot"))
    recent = Window.partitionBy("session_id").orderBy(F.desc("revision"))
    kept = last.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= limit)
    return kept.select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("revision")) - 1).alias("step"), "revision", "percent", "message")


def _since_clear(events: DataFrame) -> DataFrame:
    """Events after each session's last clear or delete."""
    cut = events.filter("op in ('clear', 'delete')").groupBy("session_id").agg(F.max("event_id").alias("_cut"))
    return events.join(cut, "session_id", "left").filter("op = 'update' and (_cut is null or event_id > _cut)").drop("_cut")


def overlay_nodes(events: DataFrame) -> DataFrame:
    """session_id, id, style: the last style each node was given since the last clear."""
    each = _since_clear(events).select("session_id", "event_id", F.posexplode("nodes").alias("i", "n"))
    return each.groupBy("session_id", F.col("n.id").alias("id")).agg(F.max_by("n.style", F.struct("event_id", "i")).alias("style"))


def overlay_edges(events: DataFrame) -> DataFrame:
    """session_id, source, target, relation, style: an edge of the last batch of edges keeps its style, earlier current ones are previous."""
    rows = _since_clear(events).filter("edges is not null")
    last = rows.groupBy("session_id").agg(F.max("event_id").alias("_last"))
    each = rows.select("session_id", "event_id", F.posexplode("edges").alias("i", "e"))
    kept = each.groupBy("session_id", F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.coalesce("e.relation", F.lit(DEFAULT_RELATION)).alias("relation")).agg(F.max(F.struct("event_id", "i", F.coalesce("e.style", F.lit(CURRENT)).alias("style"))).alias("v"))
    style = F.when((F.col("v.event_id") < F.col("_last")) & (F.col("v.style") == CURRENT), PREVIOUS).otherwise(F.col("v.style"))
    return kept.join(last, "session_id").select("session_id", "source", "target", "relation", style.alias("style"))


def session_metadata(events: DataFrame) -> DataFrame:
    """session_id, metadata: a JSON object with the keys of all updates in order, values with their types, later ones first; clears keep it."""
    cut = events.filter("op = 'delete'").groupBy("session_id").agg(F.max("event_id").alias("_cut"))
    rows = events.join(cut, "session_id", "left").filter("op in ('update', 'create') and metadata is not null and (_cut is null or event_id > _cut)")
    each = rows.select("session_id", "event_id", F.explode(members(F.col("metadata"))).alias("key", "value"))
    last = each.groupBy("session_id", "key").agg(F.max_by(F.to_json("value"), "event_id").alias("value"))
    listed = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("m"))
    return listed.select("session_id", F.to_json(F.map_from_entries(F.transform("m", lambda e: F.struct(e["key"], F.parse_json(e["value"]))))).alias("metadata"))


def styled_edges(edges: DataFrame, nodes: DataFrame, overlay: DataFrame) -> DataFrame:
    """``edges`` (session_id, source, target, relation and more) with a style: the overlay's of the same key, else by both ends' stages.

    ``nodes``: session_id, id, style.  An edge is current if both ends have a stage and one is current."""
    stage = lambda side: nodes.select("session_id", F.col("id").alias(side), F.col("style").alias(f"_{side}"))
    joined = edges.join(overlay.withColumnRenamed("style", "_own"), ["session_id", "source", "target", "relation"], "left").join(stage("source"), ["session_id", "source"], "left").join(stage("target"), ["session_id", "target"], "left")
    return joined.select(*edges.columns, _edge_style().alias("style"))


def _edge_style() -> Column:
    """The edge's own style (_own), else that of its ends' stages (_source, _target)."""
    both = F.col("_source").isNotNull() & F.col("_target").isNotNull()
    return F.coalesce("_own", F.when(both & ((F.col("_source") == CURRENT) | (F.col("_target") == CURRENT)), CURRENT).when(both, PREVIOUS))


def live_sessions(events: DataFrame) -> DataFrame:
    """session_id, revision: the sessions that no later delete ended, and their events since."""
    cut = events.filter("op = 'delete'").groupBy("session_id").agg(F.max("event_id").alias("_cut"))
    rows = events.join(cut, "session_id", "left").filter("_cut is null or event_id > _cut")
    return rows.groupBy("session_id").agg(F.count("*").alias("revision"))


def polled(events: DataFrame, asked: DataFrame) -> DataFrame:
    """session_id, exists, revision (-1 without such a session), changed: answers to ``asked`` (session_id, since_revision)."""
    found = asked.select("session_id", "since_revision").join(live_sessions(events), "session_id", "left")
    revision = F.coalesce("revision", F.lit(-1)).cast("long")
    return found.select("session_id", F.col("revision").isNotNull().alias("exists"), revision.alias("revision"), F.coalesce(revision != F.col("since_revision"), F.lit(True)).alias("changed"))


def session_view(graph: PropertyGraph, events: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """What every session shows of the graph: nodes and edges.

    nodes: session_id, id, label, group, title, style (null: not in the overlay).  edges: session_id,
    edge_idx, source, target, relation, weight, style.  Shown are the nodes within ``hops`` of the
    overlay's nodes, or of its edges' ends where it has no nodes; those ends in any case; and the
    edges between them.  Sessions without an overlay show nothing."""
    own_nodes, own_edges = cut(overlay_nodes(events)), cut(overlay_edges(events))
    near = k_hop(graph, view_seeds(own_nodes, own_edges), hops, by=["session_id"]).select("session_id", "id")
    ends = own_edges.select("session_id", F.explode(F.array("source", "target")).alias("id"))
    # The stages go with the nodes, so both ends of an edge bring theirs.
    chosen = cut(near.unionByName(ends).distinct().join(own_nodes, ["session_id", "id"], "left"))
    nodes = chosen.join(labels(graph.nodes), "id")
    end = lambda side: chosen.select("session_id", F.col("id").alias(side), F.col("style").alias(f"_{side}"))
    inside = graph.edges.join(end("source"), "source").join(end("target"), ["session_id", "target"])
    edges = inside.select("session_id", "edge_idx", "source", "target", F.coalesce("relation", F.lit("")).alias("relation"), "weight", "_source", "_target")
    styled = edges.join(own_edges.withColumnRenamed("style", "_own"), ["session_id", "source", "target", "relation"], "left")
    return nodes.select("session_id", "id", "label", "group", "title", "style"), styled.select("session_id", "edge_idx", "source", "target", "relation", "weight", _edge_style().alias("style"))


def view_counts(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, revision, nodes, edges, highlighted_nodes, highlighted_edges of every live session.

    ``nodes`` and ``edges``: the session's view; highlighted is what its overlay holds."""
    return style_counts(events, nodes, edges).drop("current_nodes", "styled_edges")


def style_counts(events: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``view_counts`` and current_nodes and styled_edges: the view's nodes that are current, and its edges with a style."""
    # Each table is grouped once: a view is much larger than what it is made of.
    number = F.count("*")
    counted = [
        nodes.groupBy("session_id").agg(number.alias("nodes"), F.count_if(F.col("style") == CURRENT).alias("current_nodes")),
        edges.groupBy("session_id").agg(number.alias("edges"), F.count("style").alias("styled_edges")),
        overlay_nodes(events).groupBy("session_id").agg(number.alias("highlighted_nodes")),
        overlay_edges(events).groupBy("session_id").agg(number.alias("highlighted_edges")),
    ]
    out = live_sessions(events)
    for rows in counted:
        out = out.join(rows, "session_id", "left")
    return out.na.fill(0).select("session_id", "revision", "nodes", "edges", "highlighted_nodes", "highlighted_edges", "current_nodes", "styled_edges")


def distinct_steps(steps: DataFrame, *signature: str) -> DataFrame:
    """Steps (session_id, step) whose ``signature`` columns differ from those of the session's step before."""
    now = F.struct(*signature)
    by = Window.partitionBy("session_id").orderBy("step")
    marked = steps.withColumns({"_first": F.row_number().over(by) == 1, "_same": now.eqNullSafe(F.lag(now).over(by))})
    return marked.filter(F.col("_first") | ~F.col("_same")).drop("_first", "_same")


def stage(message: Column) -> Column:
    """The stage of a retrieval that a progress message stands for."""
    text = F.lower(F.coalesce(message, F.lit("")))
    told = lambda part: F.contains(text, F.lit(part))
    return F.when(told("answer generated"), "generated").when(told("generating"), "generating").when(told("retrieval complete"), "retrieved").otherwise("retrieving")


# --- event constructors --------------------------------------------------------------------------

#: Types of the parts of an update that may not be given.
NODES, EDGES, PROGRESS = "array<struct<id:string,style:string>>", "array<struct<source:string,target:string,relation:string,style:string>>", "struct<current:int,total:int,message:string>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _updates(rows: DataFrame, nodes: Column, edges: Column, progress: Column) -> DataFrame:
    metadata = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
    return rows.select("session_id", "event_id", F.lit("update").alias("op"), nodes.alias("nodes"), edges.alias("edges"), metadata.alias("metadata"), progress.alias("progress"))


def record_events(rows: DataFrame) -> DataFrame:
    """Updates of (session_id, event_id, node_ids, style, message): every id in the row's style, current by default.

    Null ids: no nodes given.  A null or empty message: no progress given.  metadata is kept if there."""
    style = F.coalesce("style", F.lit(CURRENT))
    nodes = F.transform("node_ids", lambda i: F.struct(i.cast("string").alias("id"), style.alias("style")))
    said = F.struct(F.lit(None).cast("int").alias("current"), F.lit(None).cast("int").alias("total"), F.col("message"))
    return _updates(rows, nodes, _none(EDGES), F.when(F.coalesce("message", F.lit("")) != "", said))


def progress_events(rows: DataFrame) -> DataFrame:
    """Updates of (session_id, event_id, current, total, message) that only set the progress."""
    return _updates(rows, _none(NODES), _none(EDGES), F.struct(F.col("current").cast("int").alias("current"), F.col("total").cast("int").alias("total"), F.coalesce("message", F.lit("")).alias("message")))


def search_events(rows: DataFrame) -> DataFrame:
    """Updates of search results (session_id, event_id, seed_nodes: ids, one_hop_edges: source, target, relation).

    Seeds without an id and edges without an end are left out; nulls count as empty lists."""
    seeds = F.filter(F.coalesce("seed_nodes", F.array().cast("array<string>")), lambda i: i.isNotNull())
    nodes = F.transform(seeds, lambda i: F.struct(i.alias("id"), F.lit(CURRENT).alias("style")))
    given = F.filter(F.coalesce("one_hop_edges", F.array().cast("array<struct<source:string,target:string,relation:string>>")), lambda e: e["source"].isNotNull() & e["target"].isNotNull())
    edges = F.transform(given, lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), F.coalesce(e["relation"], F.lit(DEFAULT_RELATION)).alias("relation"), F.lit(None).cast("string").alias("style")))
    return _updates(rows, nodes, edges, _none(PROGRESS))


def advance(state: tuple, row: dict) -> tuple[tuple, tuple]:
    """A session's state after an event, and the event's output."""
    revision, current, total, message, percent_, taken = state
    before = percent_
    revision += 1
    snapshot = False
    if row["op"] == "clear":
        taken = False
    else:
        progress = row["progress"]
        if progress is not None:
            current = progress["current"] if progress["current"] is not None else current
            total = progress["total"] if progress["total"] is not None else total
            message = progress["message"] if progress["message"] is not None else message
            if total > 0:
                percent_ = min(100.0, max(0.0, current / total * 100.0))
        overlay = row["nodes"] is not None or row["edges"] is not None
        if overlay or progress is not None:
            snapshot = overlay or abs(percent_ - before) > 1e-9 or not taken
            taken = taken or snapshot
    return (revision, current, total, message, percent_, taken), (revision, current, total, message, percent_, snapshot)
