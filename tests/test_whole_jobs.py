"""Queries that must cover their whole tables, against SQL of their own on the smallest tables."""

import os

import pytest

from graphloom.plans import catalog
from tests.test_catalog import SF, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
HUNDREDTHS = {"queries": "vec_id % 100 = 0"}
WHOLE = {
    "vector_topk_batch": catalog._topk(catalog.COS, **HUNDREDTHS),
    "vector_topk_l2": catalog._topk(catalog.L2, **HUNDREDTHS),
    "vector_topk_filtered": catalog._topk(catalog.COS, where="label = 3", **HUNDREDTHS),
    "adjacency_list": f"WITH {catalog.KG_EDGES}, b AS (SELECT source AS id, target AS n FROM ke UNION SELECT target, source FROM ke) SELECT id, string_agg(n, ',' ORDER BY n) AS neighbours FROM b GROUP BY id",
    "node_labels": f"WITH {catalog.KG_NODES} SELECT id, text AS label, type AS \"group\", id AS title FROM kn",
    "export_jsonl_roundtrip": f"WITH {catalog.KG_EDGES} SELECT source, target, relation, weight FROM ke",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, duck, name):  # noqa: F811
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(WHOLE[name]).df())


def test_several_blocks_of_queries(spark, monkeypatch):
    from graphloom.operators import vector

    want = rows(catalog.QUERIES["vector_topk_batch"](spark, SF).toPandas())
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    assert rows(catalog.QUERIES["vector_topk_batch"](spark, SF).toPandas()) == want
