"""Substring search by trigrams against a scan of every text."""

import random

import pytest

from graphloom.operators import textindex as X
from tests.test_batch import below_the_join

SCHEMA = "id string, text string, ord long"


def made():
    rng = random.Random(2)
    syllables = ["ba", "na", "an", "É", "x", "😀", "lo", "z\0"]
    rows = [(f"n{i}", None if i % 17 == 0 else " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))), 1000 - i) for i in range(300)]
    queries = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    return rows, queries + [(90, "ba ba n1 banana"), (91, ""), (92, None), (93, "b"), (94, "qq zzzz"), (95, "N2"), (96, " \t")]


def scanned(rows, queries, k):
    out = []
    for q, query in queries:
        words = (query or "").lower().split()
        hits = [(-sum(w in f"{i} {t or ''}".lower() for w in words), o, i) for i, t, o in rows]
        for pos, (h, _, i) in enumerate(sorted(h for h in hits if h[0])[:k]):
            out.append((q, pos, i, round(-h / len(words), 9)))
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_search_equals_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    rows, queries = made()
    index = X.TrigramIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(3))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    got = sorted((r["query_id"], r["pos"], r["id"], round(r["score"], 9)) for r in index.search(asked, 5).collect())
    assert got == scanned(rows, queries, 5)
    assert index.search(asked, 0).count() == 0 and index.search(asked.limit(0), 5).count() == 0


def test_few_candidates_are_verified(spark):
    """A word's candidates are the texts with its rarest trigram, not all texts."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrst"
    rows = [(str(i), "".join(rng.choice(letters) for _ in range(60)), i) for i in range(2000)]
    index = X.TrigramIndex.build(spark.createDataFrame(rows, SCHEMA))
    words = spark.createDataFrame([(rows[7][1][10:20],), (rows[8][1][:6],), ("abc" + "z" * 5,)], "word string")
    got = {r["word"]: r["texts"] for r in index.candidates(words).collect()}
    assert len(got) == 2 and max(got.values()) < 40


def test_texts_are_not_moved(spark):
    index = X.TrigramIndex.build(spark.createDataFrame([("a", "some text", 1), ("b", "more", 2)], SCHEMA))
    found = index.search(spark.createDataFrame([(1, "text some")], "query_id long, query string"), 3)
    assert [tuple(r) for r in found.collect()] == [(1, 0, "a", 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for line in plan.splitlines():
        assert "Exchange" not in line or "haystack" not in line
    assert below_the_join(plan, "haystack")[-1].startswith("FlatMapCoGroupsInArrow")
