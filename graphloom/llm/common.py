"""Shared pieces of the training-data operators that stay inside Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import shared_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark drops a query's shuffle files when it ends, on all executors, while this is set.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LEFT_TO_EXIT: set[str] = set()


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _new_table(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; the application's tables go when it exits."""
    folder = f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if folder not in _LEFT_TO_EXIT:
        fs, at = _hadoop_path(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _LEFT_TO_EXIT.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _dropping_shuffles(spark: SparkSession, write: Callable[[], None]) -> None:
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        write()
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a zstd parquet table in the shared folder: cuts lineage and outlives any executor.

    The shuffle files that made it go when it is written."""
    spark = df.sparkSession
    path = _new_table(spark, label)
    _dropping_shuffles(spark, lambda: df.write.option("compression", "zstd").parquet(path))
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like ``written``, with the rows of a key together in a bucket: later work by that key moves no rows."""
    spark = df.sparkSession
    path = _new_table(spark, label)
    name = f"graphloom_{path.rpartition('/')[2].replace('-', '_')}"
    _dropping_shuffles(spark, lambda: df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that no later plan reads."""
    for table in tables:
        fs, at = _hadoop_path(table.sparkSession, table._written_to)
        fs.delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Words in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns with clashing names never meet a join."""
    return df.select(*[df[name] for name in names])


def digest(doc_id: Column, seed: str, other: Column | None = None) -> Column:
    """A reproducible pseudo-random hex string per document; null ids share one, or have one for each value of ``other``."""
    without = F.lit("") if other is None else F.concat(F.lit("no id:"), other.cast("string"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), without, F.lit(""))))


def running_sums(rows: DataFrame, group: str, klass: str, digest_col: str, value: str, ties: list[Column], range_rows: int) -> DataFrame:
    """``rows`` plus ``before``: the sum of ``value`` over all earlier rows of the same group.

    Rows are ordered by (class descending, digest, ties).  A group is cut in ranges of class and
    digest prefix that hold about ``range_rows`` rows each; rows are summed inside a range, and
    the ranges' sums are summed over one row per range.  No task holds a whole group.
    """
    per_class = written(rows.groupBy(group, klass).agg(F.ceil(F.count("*") / range_rows).alias("_cuts")), "cuts")
    cut = rows.join(per_class, [group, klass]).withColumn("_range", F.floor(F.conv(F.substring(digest_col, 1, 8), 16, 10).cast("long") * F.col("_cuts") / F.lit(4294967296)).cast("long"))
    ranges = cut.groupBy(group, klass, "_range").agg(F.sum(value).alias("_in_range"))
    over_ranges = Window.partitionBy(group).orderBy(F.col(klass).desc(), "_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(group, klass, "_range", F.coalesce(F.sum("_in_range").over(over_ranges), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, klass, "_range").orderBy(digest_col, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, [group, klass, "_range"]).withColumn("before", F.col("_offset") + F.col("_inside")).drop("_cuts", "_range", "_offset", "_inside")


def veiled(docs: DataFrame, *plain: str) -> DataFrame:
    """``docs`` with all columns but ``plain`` renamed, so that none meets a name used inside an operator."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in plain else f"_veiled{i}") for i, c in enumerate(docs.columns)])


def unveiled(rows: DataFrame, docs: DataFrame, *plain: str) -> DataFrame:
    """The columns of ``docs`` out of rows made from ``veiled(docs, *plain)``."""
    return rows.select(*[F.col(c if c in plain else f"_veiled{i}").alias(c) for i, c in enumerate(docs.columns)])
