"""A table of vectors by id that is upserted by copy on write.

Rows lie in buckets by a hash of their id.  An upsert rewrites the buckets that it touches beside
the old ones and then commits a manifest, which names the version that each bucket is of.  Making
the manifest is the one step that counts and it fails if there is one of that number: so a write
that fails leaves the old version as it was, of two writers at once one is told to try again, and
readers of a version keep it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class ConcurrentUpsert(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class VectorStore:
    """Versions of a table (id, vector and more columns) at ``path``, in a file system that Spark reaches.

    ``buckets`` counts when the first version is written; later ones keep to it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._files.globStatus(spark_path(self.spark, f"{self.path}/manifests/*.json")) or []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:09d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the last one by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {version if version is not None else ''}")
        kept = self._manifest(known[-1] if version is None else version)
        schema = self.spark.createDataFrame([], kept["schema"]).schema
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in kept["buckets"].items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, order: str = "ord") -> int:
        """Put the last row (by ``order``) of each id in place of its old one; returns the new version.

        New columns are null in old rows that stay; a missing one is null in new rows."""
        known = self.versions()
        old = self._manifest(known[-1]) if known else {"schema": "", "buckets": {}, "count": self.buckets}
        place = lambda d: d.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(old["count"])).cast("int"))
        values = [c for c in rows.columns if c not in ("id", order)]
        last = place(rows.filter("id is not null").groupBy("id").agg(F.max_by(F.struct(*values), order).alias("v")).select("id", "v.*"))
        touched = sorted(r[0] for r in last.select("bucket").distinct().collect())
        stale = [f"{self.path}/data/{old['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in old["buckets"]]
        if stale:
            before = place(self.spark.read.schema(self.spark.createDataFrame([], old["schema"]).schema).parquet(*stale))
            last = before.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)
        version, folder = (known[-1] + 1 if known else 0), uuid.uuid4().hex
        last.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        plain = last.drop("bucket").schema
        fields = {f.name: f for f in self.spark.createDataFrame([], old["schema"]).schema} if old["schema"] else {}
        fields |= {f.name: f for f in plain}
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.values())
        self._commit(version, {"schema": ddl, "count": old["count"], "buckets": old["buckets"] | {str(b): folder for b in touched}})
        return version

    def _commit(self, version: int, manifest: dict) -> None:
        target = spark_path(self.spark, f"{self.path}/manifests/{version:09d}.json")
        try:
            out = self._files.create(target, False)
        except Exception as error:
            raise ConcurrentUpsert(f"version {version} of {self.path} is there already") from error
        out.write(json.dumps(manifest).encode())
        out.close()


def spark_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
