"""Exact vector search: blocks of vectors meet blocks of queries, and each pair keeps its best k per query."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import strip

#: Queries of a block and, of these, at a time; numbers in a block of vectors.
QUERY_BLOCK, QUERY_STEP = 1024, 64
BLOCK_NUMBERS = 1 << 21
METRICS = ("cosine", "l2sq", "ip")
COLUMNS = ("id", "document", "metadata", "embedding", "ord")


def coerced(value: Any) -> list[float] | None:
    """A list of floats, or null for anything that is none."""
    if isinstance(value, (str, bytes)) or value is None:
        return None
    try:
        return [float(x) for x in value]
    except (TypeError, ValueError):
        return None


def _distances(metric: str, vectors: np.ndarray, squares: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """A row of distances for each query; a zero norm counts as 1 for cosine.  ``squares``: the vectors' squared norms."""
    if metric == "l2sq":
        return np.stack([((vectors - q) ** 2).sum(1) for q in queries])
    dot = queries @ vectors.T
    if metric == "ip":
        return 1.0 - dot
    norm = lambda s: np.where(s == 0, 1.0, np.sqrt(s))
    return 1.0 - dot / (norm(squares)[None, :] * norm((queries**2).sum(1))[:, None])


class VectorIndex:
    """A table (id, document, metadata, embedding, ord) searched exactly.

    Rows whose dimension differs from a query's are skipped for it; ties go to the smaller ord."""

    def __init__(self, rows: DataFrame, metric: str = "cosine", name: str = "index"):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.rows, self.metric, self.name = rows.select(*COLUMNS), metric, name

    @staticmethod
    def read(spark, path: str, metric: str = "cosine") -> VectorIndex:
        return VectorIndex(spark.read.parquet(path), metric, path)

    def describe_store(self) -> dict:
        return {"library": "spark", "collection_name": self.name, "distance_metric": self.metric}

    def add(self, rows: DataFrame) -> VectorIndex:
        """Upsert: each given column replaces the old value, missing or null ones keep it."""
        have = set(rows.columns)
        if not have & {"document", "metadata", "embedding"}:
            raise ValueError("an upsert needs an embedding, a document or metadata")
        new = rows.select("id", *[F.col(c).alias(f"new_{c}") if c in have else F.lit(None).alias(f"new_{c}") for c in ("document", "metadata", "embedding")], (F.col("ord") if "ord" in have else F.monotonically_increasing_id()).alias("new_ord"))
        last = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), "new_ord").alias("v")).select("v.*")
        merged = self.rows.join(last, "id", "full_outer")
        out = merged.select("id", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("document", "metadata", "embedding")], F.coalesce("ord", F.col("new_ord") + F.lit(1 << 40)).alias("ord"))
        return VectorIndex(out, self.metric, self.name)

    def search(self, queries: DataFrame | list[float], top_k: int = 5, where: Mapping[str, Any] | None = None) -> DataFrame:
        """query_id, id, document, metadata, embedding, distance, rank: the ``top_k`` nearest rows of every query.

        ``queries``: (query_id, vector), or one vector.  ``where``: metadata values that rows must have."""
        spark = self.rows.sparkSession
        rows = self.rows
        for key, value in (where or {}).items():
            rows = rows.filter(has_value(F.col("metadata"), key, value))
        if not isinstance(queries, DataFrame):
            vector = coerced(queries)
            queries = spark.createDataFrame([("", vector)] if vector else [], "query_id string, vector array<double>")
        known = queries.filter("vector is not null and size(vector) > 0").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        hit = T.StructType([known.schema["query_id"], rows.schema["id"], T.StructField("distance", T.DoubleType()), T.StructField("ord", T.LongType())])
        asked, widest = known.agg(F.count("*"), F.max(F.size("vector"))).first()
        if not asked or top_k <= 0:
            found = spark.createDataFrame([], hit)
        else:
            # Blocks of bounded size on either side meet once; each pair keeps the best k of its queries.
            query_blocks = -(-asked // QUERY_BLOCK)
            row_blocks = max(1, -(-self.rows.count() * widest // BLOCK_NUMBERS))
            block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
            numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            left = known.select(block("query_id", query_blocks).alias("q"), numbers(row_blocks).alias("r"), "query_id", "vector")
            right = rows.filter("embedding is not null").select(numbers(query_blocks).alias("q"), block("ord", row_blocks).alias("r"), "id", "ord", "embedding")
            found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(_nearest(self.metric, top_k, hit), hit)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ord"))
        top = found.withColumn("rank", rank).filter(F.col("rank") <= top_k)
        # Rows may share an id, such as parallel edges in an index of edges; place and id together do not.
        return top.join(rows, ["id", "ord"]).select("query_id", "id", "document", "metadata", "embedding", "distance", "rank")


def has_value(metadata: Column, key: str, value: Any) -> Column:
    """Whether a JSON object has this value under a key, of the same type: a boolean, number or string.

    Numbers compare by value.  ``None`` is had by objects whose member is null or missing."""
    path = "$['" + key.replace("'", "\\'") + "']"
    found = F.try_variant_get(F.try_parse_json(metadata), path, "variant")
    kind = F.coalesce(F.schema_of_variant(found), F.lit("VOID"))
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(found, "$", "double") == float(value))
    return (kind == "STRING") & (F.try_variant_get(found, "$", "string") == str(value))


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)


def _nearest(metric: str, k: int, schema: T.StructType):
    """The best k rows of a block for each query of a block."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        of, near, away, places = [], [], [], []
        order = rows.column("ord").to_numpy()
        matrices = {m.shape[1]: (at, m, (m**2).sum(1)) for at, m in _by_size(rows.column("embedding"))} if rows.num_rows else {}
        for asked, vectors in _by_size(queries.column("vector")) if queries.num_rows else []:
            if vectors.shape[1] not in matrices:
                continue
            at, matrix, squares = matrices[vectors.shape[1]]
            for a in range(0, len(asked), QUERY_STEP):
                distances = _distances(metric, matrix, squares, vectors[a : a + QUERY_STEP])
                for q, distance in zip(asked[a : a + QUERY_STEP].tolist(), distances, strict=True):
                    # Equal vectors are equally far, however the product was cut.
                    told = np.round(distance, 12)
                    some = np.flatnonzero(told <= np.partition(told, k - 1)[k - 1]) if len(told) > k else np.arange(len(told))
                    best = some[np.lexsort((order[at[some]], told[some]))[:k]]
                    of.append(np.full(len(best), q))
                    near.append(at[best])
                    away.append(told[best])
                    places.append(order[at[best]])
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([queries.column("query_id").take(pa.array(joined(of, np.int64))), rows.column("id").take(pa.array(joined(near, np.int64))), pa.array(joined(away, float)), pa.array(joined(places, np.int64))], names=schema.names)

    return run


def backfilled(nodes: DataFrame, index: VectorIndex) -> DataFrame:
    """Nodes with a missing embedding filled from their metadata, then from the index."""
    own = F.coalesce("embedding", F.from_json(F.get_json_object("metadata", "$.embedding"), "array<float>"))
    stored = index.rows.select("id", F.col("embedding").alias("_stored"))
    return nodes.join(stored, "id", "left").withColumn("embedding", F.coalesce(own, F.col("_stored").cast("array<float>"))).drop("_stored")


def edge_documents(edges: DataFrame) -> DataFrame:
    """The rows of an edge index: id ``source|relation|target``, document ``source relation target``."""
    return edges.select(F.concat_ws("|", "source", "relation", "target").alias("id"), strip(F.concat_ws(" ", "source", "relation", "target")).alias("document"), "metadata", F.col("edge_idx").alias("ord"))
