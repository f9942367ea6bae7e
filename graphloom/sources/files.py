"""Query, answer and judge-result files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.operators.chat import first_field
from graphloom.sources.base import lines

QUERY_FIELDS = ("query", "text", "question", "question_text", "prompt")


def queries(spark: SparkSession, path: str, limit: int = -1) -> DataFrame:
    """query, ord of a JSONL file; an error where there is none."""
    rows = lines(spark, path).select(first_field(F.col("value"), QUERY_FIELDS).alias("query"), "ord").filter("query is not null")
    rows = rows.orderBy("ord").limit(limit) if limit >= 0 else rows
    if not rows.take(1):
        raise ValueError(f"no queries in {path}")
    return rows


def answers(spark: SparkSession, *paths: str) -> DataFrame:
    """query, answer, ord of JSONL files; the last answer of a query wins."""
    rows = lines(spark, *paths).select(strip(F.get_json_object("value", "$.query")).alias("query"), first_field(F.col("value"), ("outputs",)).alias("answer"), "ord").filter("query is not null and query != ''")
    return rows.groupBy("query").agg(F.max_by("answer", "ord").alias("answer"), F.min("ord").alias("ord"))


def answer_files(folder: str) -> list[str]:
    """JSONL files named graph_method, at least two."""
    found = sorted(str(p) for p in Path(folder).glob("*.jsonl") if len(p.stem.split("_")) >= 2)
    if len(found) < 2:
        raise FileNotFoundError(f"two answer files are needed in {folder}")
    return found


def judge_results(spark: SparkSession, pair_id: str, path: str) -> DataFrame:
    """pair_id, custom_id, content of a results file; broken lines are skipped."""
    rows = lines(spark, path).filter(F.get_json_object("value", "$.custom_id").isNotNull())
    return rows.select(F.lit(pair_id).alias("pair_id"), F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.response.body.choices[0].message.content").alias("content"))


REQUEST = "custom_id string, pair_id string, query string, direction string, answer_a_file string, answer_b_file string, model_a string, model_b string"


def request_metadata(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """custom_id, pair_id, query, direction, answer files and models of request metadata: lines, or with ``document`` one JSON document of all requests."""
    if not document:
        return lines(spark, path).select(F.from_json("value", REQUEST).alias("r")).filter("r.custom_id is not null").select("r.*")
    fields = REQUEST.split(", ", 2)[2]
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"pair_id string, requests map<string, struct<{fields.replace(' string', ':string')}>>").alias("d"))
    return whole.select("d.pair_id", F.explode("d.requests").alias("custom_id", "r")).select("custom_id", "pair_id", "r.*")
