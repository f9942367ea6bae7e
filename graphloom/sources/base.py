"""What graph sources share: paths, ordered lines, metadata of unknown keys."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import present, strip
from graphloom.operators.graph import PropertyGraph, as_edges, as_nodes, closed


class GraphSourceError(Exception):
    """A source cannot be read."""


class UnsupportedSourceError(GraphSourceError):
    """A source is not of the kind that was asked for."""


def as_path(source) -> Path:
    if not isinstance(source, (str, Path)):
        raise UnsupportedSourceError(f"a path is needed, not {type(source).__name__}")
    return Path(source)


class GraphSource(ABC):
    """Reads one on-disk graph format into nodes and edges, lazily."""

    name = ""

    @abstractmethod
    def can_read(self, source) -> bool:
        """Whether the files of the format are there; never raises."""

    @abstractmethod
    def read(self, spark: SparkSession, source, **options) -> PropertyGraph: ...

    def stamped(self, graph: PropertyGraph, source, keep: bool) -> PropertyGraph:
        """``graph`` with its path and format in the nodes' metadata, when asked for."""
        if not keep:
            return graph
        extra = json.dumps({"_source_path": str(source), "_source_style": self.name})
        stamp = lambda rows: rows.withColumn("metadata", merged_json(F.lit(extra), F.col("metadata")))
        return PropertyGraph(stamp(graph.nodes), stamp(graph.edges), graph.indexes)


def members(record: Column) -> Column:
    """The members of a JSON object with their types, as a map of variants; empty for anything else."""
    return F.coalesce(F.from_json(record, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merged_json(*objects: Column) -> Column:
    """One JSON object with the keys of all; later ones win.  Null objects count as empty.

    Numbers, booleans, lists, objects and nulls stay what they are."""
    maps = [members(o) for o in objects]
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(_without(out, later), later)
    return F.to_json(out)


def _without(first: Column, later: Column) -> Column:
    return F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(later), k))


def other_fields(record: Column, known: Sequence[str]) -> Column:
    """A JSON object of the fields of ``record`` that are not in ``known``; values keep their types."""
    return F.to_json(F.map_filter(members(record), lambda k, v: ~k.isin(*known)))


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value, ord: the lines with text of text files, in order of file, block and line."""
    # Files go by their numbers: a path in every row would be most of what the sort holds.
    read = spark.read.text(list(paths))
    named = read.select(F.col("_metadata.file_path").alias("_f")).distinct()
    files = named.select("_f", F.row_number().over(Window.orderBy("_f")).alias("_n"))  # a row a file
    text = read.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    placed = text.filter(strip(F.col("value")) != "").join(F.broadcast(files), "_f").select("value", "_n", "_b", "_i")
    return numbered(placed, ["_n", "_b", "_i"])


def numbered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """Ascending numbers in the given order, with gaps.

    After a range shuffle and a sort in each range, partition number and place are in that order,
    and that is what monotonically_increasing_id is made of."""
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return ranged.withColumn(name, F.monotonically_increasing_id()).drop(*order)


def field(record: str, *names: str) -> Column:
    """The first of the fields that is present with text."""
    return F.coalesce(*[present(F.get_json_object(record, f"$.{n}")) for n in names])


def graph(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """A graph of these rows whose missing endpoints are bare nodes."""
    n, e = as_nodes(nodes), as_edges(edges)
    return PropertyGraph(closed(n, e), e)
