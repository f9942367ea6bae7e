"""Sessions at any of their revisions.

Every style that a node or edge has had is an entry with the revisions from which and up to which it
held.  Entries are kept under spans of ``EVERY`` revisions: a span has what held at its begin (the
snapshot) and what came later in it (the deltas), so a frame at a revision is an equality join on
session, life and span and a comparison, however long the session is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.streaming.sessions import CURRENT, DEFAULT_RELATION, PREVIOUS, folded

#: Revisions of a span.
EVERY = 64
#: Beyond every revision.
OPEN = (1 << 62) - 1


def _epochs(events: DataFrame) -> DataFrame:
    """Events with life, revision, clears, and ``ends``: the revision of the clear that follows."""
    rows = folded(events).select("session_id", "life", "clears", "revision", "op", "event_id", "nodes", "edges")
    begins = rows.groupBy("session_id", "life", (F.col("clears") - 1).alias("clears")).agg(F.min("revision").alias("ends"))
    return rows.join(begins, ["session_id", "life", "clears"], "left").withColumn("ends", F.coalesce("ends", F.lit(OPEN)))


def _held(each: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries (from, to) of rows (revision, i, style, ends): each until the next of its key, the last of a revision only."""
    whole = ["session_id", "life", "clears", *key]
    last = each.groupBy(*whole, "revision", "ends").agg(F.max_by("style", "i").alias("style"))
    after = F.lead("revision").over(Window.partitionBy(*whole).orderBy("revision"))
    return last.withColumns({"from": F.col("revision").cast("long"), "to": F.coalesce(after, F.col("ends")).cast("long")}).drop("revision", "ends")


def _spans(entries: DataFrame, every: int) -> DataFrame:
    """Entries under each span that they hold in; one that still holds lies under those up to its session's last revision."""
    of = lambda c: F.floor(c / every)
    return entries.filter(F.col("from") < F.col("to")).withColumn("span", F.explode(F.sequence(of(F.col("from")), of(F.least(F.col("to") - 1, F.greatest(F.col("from"), F.col("newest"))))))).drop("newest")


def history(events: DataFrame, every: int = EVERY) -> DataFrame:
    """kind (node, edge), session_id, life, span, key (array), style, from, to: a table to write once and seek in.

    key: the node's id, or source, target and relation."""
    rows = _epochs(events)
    newest = rows.groupBy("session_id", "life").agg(F.max("revision").alias("newest"))
    given = rows.filter("op = 'update'")
    nodes = given.select("session_id", "life", "clears", "revision", "ends", F.posexplode("nodes").alias("i", "n")).select("session_id", "life", "clears", "revision", "ends", "i", F.array("n.id").alias("key"), F.col("n.style").alias("style"))
    held_nodes = _held(nodes, ["key"]).withColumn("kind", F.lit("node"))
    steps = given.filter("edges is not null")
    steps = steps.withColumn("next", F.coalesce(F.lead("revision").over(Window.partitionBy("session_id", "life", "clears").orderBy("revision")), F.col("ends")))
    edges = steps.select("session_id", "life", "clears", "revision", "ends", "next", F.posexplode("edges").alias("i", "e"))
    key = F.array("e.source", "e.target", F.coalesce("e.relation", F.lit(DEFAULT_RELATION)))
    style = F.struct(F.coalesce("e.style", F.lit(CURRENT)).alias("style"), F.col("next").cast("long").alias("next"))
    whole = _held(edges.select("session_id", "life", "clears", "revision", "ends", "i", key.alias("key"), style.alias("style")), ["key"])
    # A current edge is a previous one from the next step with edges on.
    turn = F.least("to", "style.next")
    parts = F.when(F.col("style.style") == CURRENT, F.array(F.struct(F.lit(CURRENT).alias("style"), F.col("from"), turn.alias("to")), F.struct(F.lit(PREVIOUS).alias("style"), turn.alias("from"), F.col("to"))))
    parts = F.coalesce(parts, F.array(F.struct(F.col("style.style").alias("style"), F.col("from"), F.col("to"))))
    held_edges = whole.select("session_id", "life", "clears", "key", F.explode(parts).alias("p")).select("session_id", "life", "clears", "key", "p.style", F.col("p.from"), F.col("p.to")).withColumn("kind", F.lit("edge"))
    columns = ["kind", "session_id", "life", "key", "style", "from", "to"]
    return _spans(held_nodes.select(columns).unionByName(held_edges.select(columns)).join(newest, ["session_id", "life"]), every)


def _asked(asked: DataFrame, every: int) -> DataFrame:
    return asked.withColumn("span", F.floor(F.col("revision") / every))


def frames(table: DataFrame, asked: DataFrame, every: int = EVERY) -> DataFrame:
    """kind, session_id, life, revision, key, style: what each asked session (session_id, life, revision) showed at that revision.

    ``every``: as the table was made."""
    rows = table.join(_asked(asked.select("session_id", "life", "revision"), every), ["session_id", "life", "span"])
    return rows.filter((F.col("from") <= F.col("revision")) & (F.col("revision") < F.col("to"))).select("kind", "session_id", "life", "revision", "key", "style")


def frame_changes(table: DataFrame, asked: DataFrame, every: int = EVERY) -> DataFrame:
    """kind, session_id, life, revision, key, change (added, removed, restyled): what differs from the revision before."""
    at = lambda r, name: frames(table, asked.withColumn("revision", r), every).select("kind", "session_id", "life", (F.col("revision") + (F.lit(1) if name == "before" else F.lit(0))).alias("revision"), "key", F.col("style").alias(name), F.lit(True).alias(f"in_{name}"))
    both = at(F.col("revision") - 1, "before").join(at(F.col("revision"), "now"), ["kind", "session_id", "life", "revision", "key"], "full_outer")
    change: Column = F.when(F.col("in_before").isNull(), "added").when(F.col("in_now").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("now")), "restyled")
    return both.withColumn("change", change).filter("change is not null").select("kind", "session_id", "life", "revision", "key", "change")
