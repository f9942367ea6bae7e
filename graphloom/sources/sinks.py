"""Writers of graphs, experiment outputs and judge batches."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import PropertyGraph
from graphloom.sources.base import merged_json


def save(graph: PropertyGraph, path: str, mode: str = "overwrite") -> None:
    """``{path}_nodes.parquet`` and ``{path}_edges.parquet``, with all columns."""
    graph.nodes.write.mode(mode).parquet(f"{path}_nodes.parquet")
    graph.edges.write.mode(mode).parquet(f"{path}_edges.parquet")


def _refuse_full(destination: str, overwrite: bool) -> None:
    path = Path(destination)
    if not overwrite and path.exists() and any(path.iterdir()):
        raise FileExistsError(f"{destination} is not empty")


def _merged(own: Column, metadata: Column) -> Column:
    """``merged_json``; objects are taken apart only where the metadata has members."""
    empty = metadata.isNull() | (F.trim(metadata) == "{}")
    return F.when(empty, own).otherwise(merged_json(own, metadata))


def node_lines(nodes: DataFrame, embeddings: bool = False) -> DataFrame:
    """A JSON object per node: id, text, type and the metadata's keys, which win."""
    fields = ["id", "text", "type", *(["embedding"] if embeddings else [])]
    return nodes.select(_merged(F.to_json(F.struct(*fields)), F.col("metadata")).alias("value"), "ord")


def edge_lines(edges: DataFrame, lossy: bool = False) -> DataFrame:
    """A JSON object per edge, or with ``lossy`` the array of its two ends."""
    whole = _merged(F.to_json(F.struct("source", "target", "relation", "weight")), F.col("metadata"))
    return edges.select((F.to_json(F.array("source", "target")) if lossy else whole).alias("value"), "edge_idx")


def export(graph: PropertyGraph, destination: str, *, overwrite: bool = False, component: bool = False, embeddings: bool = False) -> dict:
    """nodes.jsonl and edges.jsonl (folders of parts), a manifest where an index is attached or always for components.

    Returns destination, files and row counts."""
    _refuse_full(destination, overwrite)
    # Sorted before the lines are made: the sort looks at its rows once more, to choose its ranges.
    node_lines(graph.nodes.orderBy("ord"), embeddings and not component).select("value").write.mode("overwrite").text(f"{destination}/nodes.jsonl")
    edge_lines(graph.edges.orderBy("edge_idx"), component).select("value").write.mode("overwrite").text(f"{destination}/edges.jsonl")
    index = graph.index("node_vector")
    if index is not None or component:
        Path(destination, "manifest.json").write_text(json.dumps({"vector_store": index.describe_store() if index is not None else {}}))
    return {"destination": destination, "node_file": f"{destination}/nodes.jsonl", "edge_file": f"{destination}/edges.jsonl", "nodes": graph.nodes.count(), "edges": graph.edges.count()}


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Experiment outputs (graph, retriever, query, outputs), a folder per graph and retriever."""
    outputs.write.mode("overwrite").partitionBy("graph", "retriever").json(path)


#: What a judge is told, and the layout of its answer.
JUDGE_SYSTEM = """---Role---
You are an expert tasked with evaluating two answers to the same question based on three criteria: **Comprehensiveness, Diversity, and Empowerment**.

---Goal---
Evaluate two answers based on:
- **Comprehensiveness**: Detail covering all aspects.
- **Diversity**: Variety of perspectives.
- **Empowerment**: Helping the reader make informed judgments.

For each criterion, choose the better answer (Answer 1 or Answer 2) and explain why. Then, select an overall winner."""
JUDGE_USER = """
Here is the question: {query}

Here are the two answers:
**Answer 1**: {answer_a}
**Answer 2**: {answer_b}

Evaluate both answers. Output your evaluation in the following **JSON format**:
{
  "Comprehensiveness": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Diversity": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Empowerment": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." },
  "Overall Winner": { "Winner": "[Answer 1 or Answer 2]", "Explanation": "..." }
}
"""


def judge_prompt() -> Column:
    """The user's message of rows with query, answer_a and answer_b."""
    parts = re.split(r"\{(query|answer_a|answer_b)\}", JUDGE_USER)
    return F.concat(*[F.coalesce(F.col(x), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def write_batch(requests: DataFrame, path: str, model: str) -> None:
    """Judge requests (custom_id, query, answer_a, answer_b) as lines of a batch file."""
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(said("system", F.lit(JUDGE_SYSTEM)), said("user", judge_prompt()))
    body = F.struct(F.lit(model).alias("model"), messages.alias("messages"), F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    requests.orderBy("custom_id").select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def write_request_metadata(requests: DataFrame, pair_id: str, left: str, right: str, path: str) -> None:
    """What a judge's results do not say, as lines by custom_id: pair_id, query, direction, and the files and models of both answers.

    ``left`` and ``right``: the answer files; forward requests have the left one's answer first."""
    forward = F.col("direction").isin("for", "forward")
    side = lambda one, other: F.when(forward, F.lit(one)).otherwise(F.lit(other))
    stem = lambda name: Path(name).stem
    row = F.struct("custom_id", F.lit(pair_id).alias("pair_id"), "query", F.when(forward, "forward").otherwise("reverse").alias("direction"), side(Path(left).name, Path(right).name).alias("answer_a_file"), side(Path(right).name, Path(left).name).alias("answer_b_file"), side(stem(left), stem(right)).alias("model_a"), side(stem(right), stem(left)).alias("model_b"))
    requests.orderBy("custom_id").select(F.to_json(row).alias("value")).write.mode("overwrite").text(path)
