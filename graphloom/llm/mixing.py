"""Operator 5: systematic sampling of documents to target source weights, in DataFrame operations only.

Every document has an expected number of copies: its source's target divided by its source's
size.  Those expectations are prefix-summed within the source in a fixed order, one random
offset per source is added, and a document is emitted once for each integer boundary its
interval crosses.  The order runs through size classes first, so the words taken follow the
target closely and not only the number of copies.

A source may hold any share of the rows and no task ever holds a whole source: see
``common.running_sums``.  Only the table with one row per source is ordered as a whole.

Null source: the last source.  Null text: size 0.  Repeated rows are documents of their own.
A source without words has target 0.  An empty table gives an empty result.  Extra columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import columns, digest, n_words, running_sums, unveiled, veiled, written

#: Rows of one source and size class that are ranked together, about.
RANGE_ROWS = 2000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"


def size_class(size: Column) -> Column:
    """Bit length of the size and the two bits after the leading one, in integers only."""
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0))
    shift = F.greatest(bits - 3, F.lit(0))
    return bits * 8 + F.floor(size / F.pow(F.lit(2.0), shift)).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source_no, source, source_size, target, and its offset in [0, 1).

    A target is min(most * size, level * weight) at the level where targets add up to ``share``
    of all words: where capping and resharing the excess by weight ends.  With sources in the
    order in which a rising level meets their caps, the level that would hold if exactly the
    sources before a row were capped rises up to the right row and falls after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = ((F.col("source_no") - 1) % len(weights) + 1).cast("int")
    caps = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - capped_before) / open_weight
    settled = caps.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":offset:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return settled.select("source_no", "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, copies, text_hash."""
    source = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sizes = written(source, "mix-sizes")
    sources = written(source_targets(sizes, weights, share, most), "mix-sources")
    rows = sizes.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rows = rows.withColumns({"klass": size_class(F.col("size")), "digest": digest(F.col("doc_id"), SEED, F.col("text_hash")), "one": F.lit(1)})
    ranked = running_sums(rows, "source_no", "klass", "digest", "one", [F.col("doc_id").asc_nulls_last(), F.col("size").desc(), F.col("text_hash")], RANGE_ROWS)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(rate * n + F.col("offset"))
    copies = (upto(F.col("before") + 1) - upto(F.col("before"))).cast("long")
    return ranked.select("doc_id", "size", "source", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "text_hash")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    plain = ("doc_id", "text", "source")
    given, docs = docs, veiled(docs, *plain)
    taken = mix(docs, **settings).groupBy("doc_id", "text_hash", "source").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    takes = written(taken.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"), "rows", "copies"), "mix-takes")
    same = lambda d: d["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(d["text"]) == F.col("_hash")) & d["source"].cast("string").eqNullSafe(F.col("_source"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    own = [docs[c] for c in docs.columns]
    single = docs.join(takes.filter("rows = 1"), same(docs)).select(*own, times.alias("_copy")).select(*docs.columns)
    # Equal rows share their copies: one of them stands for all.
    equal = docs.join(takes.filter("rows > 1"), same(docs)).select(*own, "_id", "_hash", "_source", "copies").dropDuplicates(["_id", "_hash", "_source"])
    return unveiled(single.union(equal.select(*docs.columns, times.alias("_copy")).select(*docs.columns)), given, *plain)


def op5_mix_sources(docs: DataFrame) -> DataFrame:
    return columns(mix(docs), "doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, CAST(source AS VARCHAR) AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) AS source_no
  FROM sizes GROUP BY source),
caps AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((source_no - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
targets AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target,
         CAST(('0x' || substr(md5('mix-1:offset:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, t.u,
         row_number() OVER (PARTITION BY s.source ORDER BY
           CASE WHEN s.size > 0 THEN length(bin(s.size)) * 8 + (s.size >> greatest(length(bin(s.size)) - 3, 0)) ELSE 0 END DESC,
           md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id ASC NULLS LAST, s.size DESC) AS place
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM ranked)
SELECT doc_id, size, source, source_size, target,
       CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) AS copies,
       size * CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) AS taken
FROM copied
"""
