"""The Hamming search against brute force, its codes, and what it sends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hamming


def brute_force(codes, queries, k):
    out = []
    for q in queries:
        near = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes.items() if i != q)[:k]
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    return sorted(out)


def test_hot_segments(spark, monkeypatch):
    """Blocks that are cut in parts, one value of a segment in a third of the codes, and ties."""
    monkeypatch.setattr(hamming, "BLOCK", 8)
    rng = np.random.default_rng(7)
    values = rng.integers(-(2**63), 2**63, 900)
    values[:300] = (values[:300] >> 32 << 32) | 12345
    values[300:340] = values[340]
    codes = {i: int(v) for i, v in enumerate(values)}
    rows = spark.createDataFrame(list(codes.items()), "id long, code long").withColumns({c: F.lit(1) for c in ("segment", "part", "place", "query_id")})
    got = hamming.top_k(rows, rows.filter("id % 50 = 0"), 5).collect()
    assert sorted((r["query_id"], r["neighbour_id"], r["distance"], r["rank"]) for r in got) == brute_force(codes, range(0, 900, 50), 5)


def test_sign_codes(spark):
    nan = float("nan")
    rows = [(0, None), (1, []), (2, [1.0]), (3, [-1.0, nan, None, 2.0]), (4, [1.0] * 64), (6, [0.0] * 64)]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: r["c"] for r in frame.select("id", hamming.sign_code(F.col("v")).alias("c")).collect()}
    assert got == {0: None, 1: None, 2: -(2**63), 3: 1 << 60, 4: -1, 6: 0}
    with pytest.raises(Exception, match="more than 64 components"):
        spark.createDataFrame([(5, [1.0] * 65)], "id int, v array<double>").select(hamming.sign_code(F.col("v"))).collect()


def test_routed_rows_follow_the_queries(spark):
    """Sixteen times the rows at the same queries: not sixteen times the routed rows."""
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.xxhash64("id").alias("code"))
    none = spark.createDataFrame([], "segment int, prefix int, parts int")
    counts = {}
    for n in (1 << 20, 1 << 24):
        spans = hamming.segment_spans(n)
        bits = [hamming.prefix_bits(n, w) for _, w in spans]
        counts[n] = hamming.routed(queries, spans, bits, 1, none).count()
    assert counts[1 << 24] <= 2 * counts[1 << 20]
