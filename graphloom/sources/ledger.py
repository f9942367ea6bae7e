"""The judge's batches: an append-only ledger, and a stream that takes each result file once.

A ledger entry is never rewritten: every change of a batch is appended, and reading folds the
entries to the last of each batch.  Result files are named ``<pair_id>_results.jsonl``; the stream
reads those that came since its last run, to the checkpoint's account, and appends their results
to a table in versions of a trigger each, which a repeated trigger writes anew.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import judge as J

ENTRY = "batch_id string, status string, pair_id string, final_outputs_path string, metadata_path string, seq long"
RESULT = "pair_id string, custom_id string, content string"
SUFFIX = "_results.jsonl"


def append(entries: DataFrame, path: str, seq: int | None = None) -> None:
    """Add entries (batch_id, status and any of the other fields) to the ledger, later than those before.

    ``seq``: their time, now by default."""
    have = set(entries.columns)
    columns = [name.split()[0] for name in ENTRY.split(", ")]
    row = [F.col(c) if c in have else F.lit(time.time_ns() if seq is None else seq) if c == "seq" else F.lit(None).cast("string") for c in columns]
    entries.select(*[v.alias(c) for c, v in zip(columns, row, strict=True)]).write.mode("append").json(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last known value of every field of each batch."""
    rows = spark.read.schema(ENTRY).json(path)
    fields = [c for c in rows.columns if c not in ("batch_id", "seq")]
    return rows.groupBy("batch_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields], F.max("seq").alias("seq"))


def to_download(batches: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """Completed batches whose output file is not among those ``present`` (name); all completed ones with ``force``.

    Of batches with one output file the latest is taken."""
    done = batches.filter("status = 'completed'")
    last = done.groupBy("final_outputs_path").agg(F.max_by(F.struct(*done.columns), F.struct("seq", "batch_id")).alias("b")).select("b.*")
    return last if force else last.join(present.select(F.col("name").alias("final_outputs_path")), "final_outputs_path", "left_anti")


def results(lines: DataFrame) -> DataFrame:
    """pair_id, custom_id, content of lines (value) of result files, a stream's too; broken lines are skipped."""
    pair = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+){SUFFIX.replace('.', '[.]')}(/[^/]*)?$", 1)
    custom_id = F.get_json_object("value", "$.custom_id")
    return lines.filter(custom_id.isNotNull()).select(F.url_decode(F.regexp_replace(pair, r"\+", "%2B")).alias("pair_id"), custom_id.alias("custom_id"), F.get_json_object("value", "$.response.body.choices[0].message.content").alias("content"))


def collect_results(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take the result files that are new in ``folder`` into ``table``; ends when there are none left."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")

    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    return results(lines).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def collected(spark: SparkSession, table: str) -> DataFrame:
    """The results taken so far; of a request that came twice, in whatever files, the last content."""
    rows = spark.read.schema(f"{RESULT}, version long").parquet(table)
    return rows.groupBy("pair_id", "custom_id").agg(F.max_by("content", "version").alias("content"))


def rates(spark: SparkSession, table: str, requests: DataFrame) -> DataFrame:
    """Win rates of the results taken so far.  ``requests``: pair_id, custom_id, direction."""
    return J.win_rates(J.verdicts(collected(spark, table), requests))
