"""Embedders, rerankers and generators as pluggable models over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import strip
from graphloom.operators.retrieve import NO_CONTEXT, Reranker, error_policy, hashed_embedder

Embedder = Callable[[str], Sequence[float]]
#: Provider names and what they are also called.
PROVIDERS = {"hf": "hf", "huggingface": "hf", "bge": "hf", "openai": "openai", "hashed": "hashed", "offline": "hashed"}
#: Texts that a reranker sees at a time.
RERANK_BATCH = 64


class EmbeddingService:
    """Embedders by (provider, model), made once each; an offline one is always there."""

    def __init__(self):
        self.factories: dict[str, Callable[[str], Embedder]] = {"hashed": lambda model: hashed_embedder(int(model) if str(model).isdigit() else 64)}
        self.models: dict[str, list[str]] = {"hashed": ["64"]}
        self.made: dict[tuple[str, str], Embedder] = {}

    def register(self, provider: str, factory: Callable[[str], Embedder], models: Sequence[str] = ()) -> None:
        name = PROVIDERS.get(provider.lower(), provider.lower())
        self.factories[name] = factory
        self.models[name] = list(dict.fromkeys(models))

    def embedder(self, provider: str, model: str) -> Embedder:
        name = PROVIDERS.get(str(provider).strip().lower(), str(provider).strip().lower())
        if name not in self.factories:
            raise KeyError(f"no embedder for provider {provider!r}")
        if (name, model) not in self.made:
            self.made[name, model] = self.factories[name](model)
        return self.made[name, model]

    def embed(self, text: str, provider: str = "hashed", model: str = "64") -> list[float]:
        if not str(text or "").strip():
            raise ValueError("cannot embed empty text")
        return [float(x) for x in self.embedder(provider, model)(text)]

    def options(self) -> list[dict]:
        return [{"provider": p, "models": m} for p, m in sorted(self.models.items())]

    def column(self, text: Column, provider: str = "hashed", model: str = "64", policy: str = "raise") -> Column:
        """Vectors of a text column; empty text gives null, and so does a failure under the fallback policy.

        The embedder is made once per task, from its factory."""
        name = PROVIDERS.get(provider.lower(), provider.lower())
        factory, soft = self.factories[name], error_policy(policy) == "fallback"

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            embed = factory(model)

            def one(value):
                if value is None or not value.strip():
                    return None
                try:
                    return [float(x) for x in embed(value)]
                except Exception:
                    if soft:
                        return None
                    raise

            for series in batches:
                yield pd.Series([one(v) for v in series], dtype=object)

        return embedded(text)


def reranked(rows: DataFrame, reranker: Reranker, batch: int = RERANK_BATCH) -> DataFrame:
    """``rows`` (query, id, text) with score and probability, the reranker's logit and its sigmoid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.zeros(len(frame))
            for query, part in frame.groupby("query", sort=False):
                for at in range(0, len(part), batch):
                    chosen = part.iloc[at : at + batch]
                    scores[frame.index.get_indexer(chosen.index)] = reranker.logits(reranker.features(query, chosen["text"].fillna("").tolist()))
            yield frame.assign(score=scores, probability=1.0 / (1.0 + np.exp(-scores)))

    return rows.select("query", "id", "text").mapInPandas(run, "query string, id string, text string, score double, probability double")


def chat_prompt(question: Column, history: Column, chunks: Column, system: str = "You answer from the given context.") -> Column:
    """The generator's prompt: system line, history (role, content), context or its absence, and the question."""
    told = F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    known = F.filter(chunks, lambda c: strip(c) != "")
    body = F.when(F.size(known) > 0, F.array_join(known, "\n")).otherwise(F.lit(NO_CONTEXT))
    return F.concat_ws("\n", F.lit(system), F.when(told != "", told), F.concat(F.lit("Question: "), question), F.concat(F.lit("Context:\n"), body))


def generated(prompts: DataFrame, generator: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """``prompts`` with an answer each; a failure becomes an ``ERROR:`` answer."""

    @F.pandas_udf(T.StringType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return str(generator(text))
            except Exception as error:
                return f"ERROR: {type(error).__name__}: {error}"

        for series in batches:
            yield pd.Series([one(t) for t in series])

    return prompts.withColumn("answer", answer(F.col(column)))
