"""The two-step exchange gives the direct one's results with rows in proportion to the input."""

import math
import os

import pytest

from graphloom.llm import exchange, jaccard, lm, substrings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 1 << 13)


def shown(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", ["op3", "op4", "op9"])
def test_same_results(spark, small_batches, monkeypatch, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    run = {"op3": lambda: lm.op3_lm_score(docs, labels), "op4": lambda: substrings.op4_substring_dedup(docs), "op9": lambda: jaccard.op9_jaccard_join(docs)}[name]
    assert exchange.plan(docs).group == 0 and exchange.plan(docs).batches > 16
    want = shown(run())
    monkeypatch.setattr(exchange, "DIRECT", 2)
    assert exchange.plan(docs).group > 1
    assert shown(run()) == want


@pytest.mark.parametrize("n", [1025, 7500, 23_800_000])
def test_plan_covers_everything(n):
    gates = math.isqrt(n - 1) + 1
    plan = exchange.Plan(n, gates, gates * -(-n // gates), gates)
    assert plan.ranges >= n and plan.ranges % plan.gates == 0 and plan.group * plan.gates >= n
    assert n * plan.gates <= 1.1 * n**1.5
    # Gates and ranges begin at the same keys.
    per = plan.ranges // plan.gates
    for gate in (0, 1, plan.gates // 2, plan.gates - 1):
        assert exchange.bucket_start(gate, plan.gates) == exchange.bucket_start(gate * per, plan.ranges)


def test_rows_of_messages(spark, small_batches, monkeypatch):
    """Rows grow with the input to the power 1.5, not 2."""
    monkeypatch.setattr(exchange, "DIRECT", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sent = []
    ask = exchange.Plan.ask

    def counting(self, messages, *rest, **more):
        sent.append((self.batches, self.gates, messages.count()))
        return ask(self, messages, *rest, **more)

    monkeypatch.setattr(exchange.Plan, "ask", counting)
    # Ids apart and words apart, so that the second half is no copy.
    substrings.op4_substring_dedup(docs)
    substrings.op4_substring_dedup(docs.union(docs.selectExpr("doc_id + 1000000 as doc_id", "replace(text, 'e', 'q') as text", "lang", "source", "n_chars")))
    (n, gates, first), _, (m, _, second), _ = sent
    assert 1.7 < m / n < 2.3 and first <= n * gates <= 1.2 * n**1.5
    assert second / first <= 1.2 * (m / n) ** 1.5
