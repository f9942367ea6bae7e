"""Connected components of an edge table, by alternating large and small stars.

Each round replaces every node's edges by edges to the smallest node it sees, first for its
larger neighbours, then for its smaller ones, until nothing changes; what remains are stars
around each component's smallest node.  Minima are aggregated before the shuffle and joined
back, so a node with very many edges is never collected.  Every round is written to the shared
folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: edges (a, b) with a > b, and again such edges."""
    ends = edges.select("a", "b")
    if large:
        seen = ends.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = seen.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = ends.groupBy("a").agg(F.min("b").alias("m"))
        moved = ends.join(least, "a").select("b", "m").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id each linked id can reach; ids without links do not appear.

    ``links``: two columns a and b of ids, in any order and number; empty gives empty."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
    before = mark(edges)
    while before[0]:
        last, edges = edges, written(_stars(_stars(edges, True), False), "stars")
        dropped(last)
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
