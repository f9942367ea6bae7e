"""Operator 6: exact top-k search over 64-bit binary codes by incremental multi-index hashing.

Codes are cut in m segments of about log2(rows) bits, and every distinct code is indexed under
each of its segments.  A query is asked segment by segment for the codes whose segment differs in
exactly r bits, with r growing by one a round.  After round r every code within m * (r + 1) - 1
bits has been met in some segment, so a query is finished as soon as its k-th verified distance
is within that; only unfinished queries go on.

An index block is a segment and a prefix of the segment's value, as long as makes blocks of about
``BLOCK`` codes; up to the whole value.  A query goes only to the blocks whose prefix is within r
bits of its own, so what is sent grows with the queries and, for the prefixes, with a power of the
logarithm of the rows, and a block answers each query with its best few codes, never with all it
met.  Only blocks with many more codes than that are cut in parts, each of which gets the queries
of the block.  Equal codes are one entry with their smallest k + 1 ids, so a code that a third of
all rows share costs as much as any other.

Null codes are neither searched nor found.  Ties go to the smaller id.  Rows that repeat an id
count once.  The query itself is not among its neighbours; fewer than k others give fewer rows.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import written

BITS = 64
K = 10
#: Codes in a block, about; blocks of more than HOT times as many are cut in parts of that size.
BLOCK = 2048
HOT = 4
HIT = "query_id long, code long, least_id long, distance int"


def sign_code(vector: Column) -> Column:
    """Bit i of 64 is whether component i is positive; missing, null and NaN components are not.

    A vector of more components ends the job with an error: a code would stand for its front only."""
    positive = F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), F.lit("1")).otherwise(F.lit("0")))
    too_wide = F.raise_error(F.lit(f"vectors of more than {BITS} components")).cast("long")
    return F.when(F.size(vector) > BITS, too_wide).when(vector.isNotNull() & (F.size(vector) > 0), F.conv(F.rpad(F.substring(F.array_join(positive, ""), 1, BITS), BITS, "0"), 2, -10).cast("long"))


def segment_spans(rows: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: widths of about log2(rows), from 6 to 32 bits."""
    width = max(6, min(32, round(math.log2(max(rows, 2)))))
    m = -(-BITS // width)
    ends = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _search(spans: list[tuple[int, int]], radius: int, keep: int):
    """Best ``keep`` codes of a block for each of its queries, among those whose segment differs in ``radius`` bits."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if index.num_rows and queries.num_rows:
            shift, width = spans[index.column("segment")[0].as_py()]
            mask = np.uint64((1 << width) - 1)
            codes = index.column("code").to_numpy().view(np.uint64)
            ids = index.column("least_id").to_numpy()
            values, of = np.unique((codes >> np.uint64(shift)) & mask, return_inverse=True)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(len(values) + 1))
            for qid, code in zip(queries.column("query_id").to_pylist(), queries.column("code").to_numpy().view(np.uint64), strict=True):
                met = np.flatnonzero(np.bitwise_count(values ^ ((code >> np.uint64(shift)) & mask)) == radius)
                if not len(met):
                    continue
                at = np.concatenate([order[bounds[v] : bounds[v + 1]] for v in met])
                distance = np.bitwise_count(codes[at] ^ code).astype(np.int32)
                if len(at) > keep:
                    near = distance <= np.partition(distance, keep - 1)[keep - 1]
                    at, distance = at[near], distance[near]
                best = np.lexsort((ids[at], distance))[:keep]
                out[0] += [qid] * len(best)
                out[1] += codes[at[best]].view(np.int64).tolist()
                out[2] += ids[at[best]].tolist()
                out[3] += distance[best].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], names=["query_id", "code", "least_id", "distance"])

    return run


def prefix_bits(rows: int, width: int) -> int:
    """Leading bits of a segment's value that tell blocks apart."""
    return max(0, min(width, (max(rows, 1) // BLOCK).bit_length() - 1))


def in_segments(codes: DataFrame, spans: list[tuple[int, int]], bits: list[int], *keep: str) -> DataFrame:
    """``keep``, segment and prefix of every segment of the codes."""
    own = [F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("code", a + w - p).bitwiseAND((1 << p) - 1).cast("int").alias("prefix")) for i, ((a, w), p) in enumerate(zip(spans, bits, strict=True))]
    return codes.select(*keep, F.explode(F.array(*own)).alias("s")).select(*keep, "s.segment", "s.prefix")


def routed(queries: DataFrame, spans: list[tuple[int, int]], bits: list[int], radius: int, cut: DataFrame) -> DataFrame:
    """query_id, code and the blocks (segment, prefix, part) that may hold codes whose segment differs in ``radius`` bits.

    ``cut``: segment, prefix and parts of the blocks that are cut."""
    flips = [sorted(sum(1 << b for b in on) for r in range(min(radius, p) + 1) for on in combinations(range(p), r)) for p in bits]
    by_segment = F.get(F.array(*[F.lit(f).cast("array<int>") for f in flips]), F.col("segment"))
    near = in_segments(queries, spans, bits, "query_id", "code").select("query_id", "code", "segment", "prefix", F.explode(by_segment).alias("flip"))
    near = near.select("query_id", "code", "segment", F.col("prefix").bitwiseXOR(F.col("flip")).alias("prefix"))
    parts = near.join(cut, ["segment", "prefix"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return parts.select("query_id", "code", "segment", "prefix", "part")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the k nearest rows of every query.

    ``rows`` and ``queries``: id, code."""
    known = rows.select(F.col("id").cast("long").alias("id"), F.col("code")).filter("id is not null and code is not null")
    first = Window.partitionBy("code").orderBy("id")
    ids = known.distinct().withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    codes = written(ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("least_id")), "hamming-codes")
    n = codes.count()
    spans = segment_spans(n)
    bits = [prefix_bits(n, w) for _, w in spans]
    placed = in_segments(codes, spans, bits, "code", "least_id")
    cut = written(placed.groupBy("segment", "prefix").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT * BLOCK).select("segment", "prefix", F.ceil(F.col("_n") / BLOCK).cast("int").alias("parts")), "hamming-cut")
    index = placed.join(cut, ["segment", "prefix"], "left").withColumn("part", F.pmod(F.xxhash64("code"), F.coalesce("parts", F.lit(1))).cast("int"))
    index = index.select("segment", "prefix", "part", "code", "least_id")
    asked = queries.select(F.col("id").cast("long").alias("query_id"), F.col("code")).filter("query_id is not null and code is not null").distinct()
    active = written(asked, "hamming-queries")
    best = None
    by_distance = Window.partitionBy("query_id").orderBy("distance", "least_id")
    block = ["segment", "prefix", "part"]
    for radius in range(max(w for _, w in spans) + 1):
        sent = routed(active, spans, bits, radius, cut)
        met = index.groupBy(*block).cogroup(sent.groupBy(*block)).applyInArrow(_search(spans, radius, k + 1), HIT)
        every = met if best is None else best.select(*met.columns).union(met)
        ranked = every.groupBy("query_id", "code", "least_id").agg(F.min("distance").alias("distance")).withColumn("place", F.row_number().over(by_distance)).filter(F.col("place") <= k + 1)
        best = written(ranked, "hamming-best")
        covered = len(spans) * (radius + 1) - 1
        # k + 1 verified codes within the covered distance: nothing unseen can come before them.
        done = best.filter((F.col("place") == k + 1) & (F.col("distance") <= covered)).select("query_id")
        active = written(active.join(done, "query_id", "left_anti"), "hamming-queries")
        if covered >= BITS or not active.take(1):
            break
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    hits = best.select("query_id", "code", "distance").join(codes.select("code", "ids"), "code").select("query_id", F.explode("ids").alias("neighbour_id"), "distance")
    return hits.filter("query_id != neighbour_id").withColumn("rank", rank).filter(F.col("rank") <= k)


def op6_topk_search(embeddings: DataFrame) -> DataFrame:
    """Ten nearest sign codes; queries are the rows whose id is divisible by 100."""
    rows = embeddings.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.filter("id % 100 = 0"))


ORACLE = """
WITH codes AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')::BIT AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance
  FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, neighbour_id, distance, rank FROM ranked WHERE rank <= 10
"""
