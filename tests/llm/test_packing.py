"""Packing: nulls, ties, long texts, target weights and accounts between partitions."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import packing

LONG = " ".join(f"word{i % 251}" for i in range(9000))


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    return lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def test_edges(spark, ids):
    """Null texts, sources and ids, repeated rows and columns with inner names: every id once, sequences gapless and of allowed lengths."""
    texts = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, "x y", None), (4, "x y", None), (None, "no id", "b"), (None, "no id", "b"), (5, " \t\n", "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumns({c: F.lit("z") for c in ("row", "ids", "part", "before", "source_no", "source_tokens", "length", "weight")})
    got = packing.op10_pack(docs).collect()
    want = collections.Counter()
    for i, t, _ in texts:
        want[i, len(ids(t))] += len(ids(t))
    have, fill = collections.Counter(), collections.defaultdict(list)
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
        of = [ids(t) for i, t, _ in texts if i == r["doc_id"] and len(ids(t)) == r["doc_tokens"]]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in of)
    assert have == want
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at <= 2048 and at & (at - 1) == 0
    assert packing.op10_pack(docs.limit(0)).count() == 0


def test_weights(spark):
    """Given weights fill windows until a source is used up; nothing is lost."""
    shares = [(s, (s, k), 0, 500) for s in (0, 1) for k in range(200)]
    out = packing.serve(shares, weights={0: 3, 1: 1})
    given = collections.Counter()
    for (s, _), _, n, sequence, _ in out:
        given[s, sequence] += n
    assert all(abs(given[0, q] / 2048 - 0.75) < 2 * packing.QUANTUM / 2048 for q in range(40))
    assert sum(given.values()) == 200_000
    docs = spark.createDataFrame([(i, "a b c d " * 40, ("x", "y", None)[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    plain, weighed = (packing.pack(docs, weights=w).agg(F.sum("length"), F.countDistinct("doc_id")).first() for w in (None, {"x": 5, None: 2}))
    assert plain == weighed


def test_accounts_between_partitions():
    """Who is owed most by the partitions before is served first."""
    shares = [(s, (s, 0), 0, 3000) for s in (0, 1, 2)]
    first = lambda carried: packing.serve(shares, carried=carried)[0][0][0]
    assert (first({0: 0, 1: 5, 2: 3}), first({0: 9, 1: 5, 2: 3}), first(None)) == (1, 0, 0)


@pytest.mark.parametrize("sources,docs", [(30, 30), (7, 200), (1, 40)])
def test_more_partitions_than_tokens_of_a_source(spark, ids, sources, docs):
    """Small sources go to few partitions whole: no empty pieces, and few of them."""
    texts = [(i, "word " * (1 + i * 37 % 90), f"s{i % sources}" if i % sources else None) for i in range(docs)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    window = 64
    got = packing.pack(frame, window=window, quantum=8, partition_tokens=64).collect()
    have, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r["length"] > 0
        have[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == {i: len(ids(t)) for i, t, _ in texts}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    # A piece ends where a document, a sequence, a grain or a turn of a quantum ends.
    tokens = sum(have.values())
    assert len(got) <= docs + len(sequences) + 2 * tokens // window + tokens // 8


def test_grains_even_out_over_partitions(spark):
    """Every partition gets its share of a large source, and small sources fall on different ones."""
    texts = [(i, "a b c d e f g " * 8, "large" if i % 4 else f"small{i % 64}") for i in range(1600)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = packing.pack(frame, partition_tokens=8192)
    per = got.groupBy(F.floor(F.col("sequence_id") / packing.STRIDE).alias("part"), (F.col("source") == "large").alias("large")).agg(F.sum("length").alias("n")).collect()
    large = [r["n"] for r in per if r["large"]]
    assert max(large) - min(large) <= 1
    assert len({r["part"] for r in per if not r["large"]}) >= len(large) // 2
