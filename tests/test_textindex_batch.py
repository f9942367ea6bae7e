"""The search of tables of queries: no work on pairs of words and texts, small steps, floors."""

import pytest

from graphloom.operators import textindex as X
from tests.test_textindex import SCHEMA, made, scanned


def found(index, asked, k):
    return sorted((r["query_id"], r["pos"], r["id"], round(r["score"], 9)) for r in index.search(asked, k).collect())


@pytest.mark.parametrize("dense", [0, 2])
def test_steps_floors_and_packs(spark, monkeypatch, dense):
    """All words by products or all by postings, a few queries a step, floors from a few texts."""
    for name, value in (("BLOCK_ROWS", 40), ("CELLS", 200), ("QUERY_ROWS", 9), ("LEADING", 3), ("DENSE", dense)):
        monkeypatch.setattr(X, name, value)
    rows, queries = made()
    index = X.TrigramIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(2))
    assert found(index, spark.createDataFrame(queries, "query_id long, query string"), 3) == scanned(rows, queries, 3)
    assert "postings" not in vars(index)


def test_blocks_send_what_is_not_below_the_floor(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 10)
    rows = [(f"n{i}", "ab cd" + " ef" * (i < 5), i) for i in range(400)]
    index = X.TrigramIndex.build(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    asked = spark.createDataFrame([(1, w, 1, 3, 4) for w in ("ab", "cd", "ef")], "query_id long, word string, times int, floor_hits long, floor_ord long")
    assert sorted(r["ord"] for r in index._best(index.texts, asked, 1, 5).collect()) == [0, 1, 2, 3, 4]
