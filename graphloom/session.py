"""Session construction and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "graphloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries assume (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.  Only a local master (tests) may do without."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="graphloom-shared-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder; it goes when the application exits."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; any path Spark itself can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed_table(df: DataFrame, label: str, key: str, gather: bool = False) -> DataFrame:
    """``df`` written to the shared folder with the rows of a key together in a bucket: work by that key moves none of them.

    ``gather``: move rows to their buckets once before, so that a bucket is one file; without, each task writes its own."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    name = f"graphloom_{path.rpartition('/')[2].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(buckets, key) if gather else df
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/table").format("parquet").saveAsTable(name)
    return spark.table(name)
