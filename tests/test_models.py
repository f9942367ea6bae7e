"""Model columns with offline models."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators.models import EmbeddingService, chat_prompt, generated, reranked
from graphloom.operators.retrieve import LexicalReranker, NO_CONTEXT


def test_embedding_service(spark):
    s = EmbeddingService()
    made = []
    s.register("HuggingFace", lambda model: made.append(model) or (lambda text: [1.0, len(text)]), ["m", "m", "n"])
    assert s.embed("abc", "bge", "m") == s.embed("abc", "hf", "m") == [1.0, 3.0] and made == ["m"]
    assert s.options() == [{"provider": "hashed", "models": ["64"]}, {"provider": "hf", "models": ["m", "n"]}]
    with pytest.raises(ValueError):
        s.embed(" ")
    with pytest.raises(KeyError):
        s.embed("x", "none", "m")
    got = spark.createDataFrame([("a b",), (" ",), (None,)], "t string").select(s.column(F.col("t")).alias("v")).collect()
    assert len(got[0]["v"]) == 64 and got[1]["v"] is None and got[2]["v"] is None


def test_rerank_and_generate(spark):
    rows = spark.createDataFrame([("cat", "a", "the cat"), ("cat", "b", None), ("dog", "c", "dog dog")], "query string, id string, text string")
    got = {r["id"]: r for r in reranked(rows, LexicalReranker()).collect()}
    assert got["a"]["score"] > got["b"]["score"] and 0 < got["b"]["probability"] < 1
    p = spark.createDataFrame([("q", [("user", "hi")], ["[1] x", " "]), ("bad", [], [])], "q string, h array<struct<role:string,content:string>>, c array<string>")
    p = p.select(chat_prompt(F.col("q"), F.col("h"), F.col("c")).alias("prompt"))
    out = [r["answer"] for r in generated(p, lambda t: 1 / 0 if NO_CONTEXT in t else t.splitlines()[1]).collect()]
    assert out[0] == "user: hi" and out[1].startswith("ERROR: ZeroDivisionError")
