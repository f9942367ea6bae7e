"""Operator 8: quality classifier by importance resampling.

Two generative models over the same hashed word n-grams (1 and 2 words, cased): the target's,
counted over documents labelled good (of at most ``FIT_ROWS`` labelled ones, those with the
smallest id digests), and the raw text's, counted over all documents.  A
document's weight is the mean over its n-grams of log target - log raw, so length does not
decide.  Documents are sampled without replacement in proportion to the exponential of
``LENGTH`` times that mean: the k largest sums of log weight and Gumbel noise.

k follows from the labels: a threshold on the mean is chosen on labelled documents that the
target model did not count, so that good documents are kept first of all; k is the number of
all documents at or above it.

Null or empty text: no evidence, weight 0, as any average document.  Without good labels every
document is kept.  Keys that tie with the k-th are all kept.  Rows that repeat an id share its
noise, rows without id have noise by their text.  A labelled id that several rows have counts once, with
the mean of their means, when the threshold is chosen.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import digest, unveiled, veiled, written
from graphloom.llm.tokens import U64, windows, words

BITS = 18
SIZES = (1, 2)
SMOOTHING = 3.0
LENGTH = 500.0
#: Labelled documents that the classifier is fitted on, at most: half of them for the target model,
#: half to choose the threshold.  As their number is bounded, their ids are broadcast.
FIT_ROWS = 50_000
#: The cost of losing a good document, against keeping another.
GOOD_COST = 5.0
#: Cells of the counts that travel in one row.
BLOCK = 1 << 14
SEED = "quality-1"


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, cell) of every n-gram, for each size."""
    w = words(texts)
    doc = w.doc
    out = []
    for n in SIZES:
        h, valid = (w.hash, np.ones(len(w.hash), bool)) if n == 1 else windows(w, n)
        out.append((doc[valid], (h[valid] >> U64(64 - BITS)).astype(np.int64)))
    return out


def _counted(docs: DataFrame) -> np.ndarray:
    """Counts of target (0) and raw (1) n-grams of each size over all of ``docs``: text, target.

    Tasks count into a fixed table; its blocks are summed apart from each other, and the sums,
    2 * len(SIZES) * 2**BITS numbers at any input size, come to the driver."""
    cells = 2 * len(SIZES) << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(SIZES), 1 << BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                target = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
                for k, (doc, cell) in enumerate(features(part.column("text"))):
                    total[1, k] += np.bincount(cell, minlength=1 << BITS)
                    total[0, k] += np.bincount(cell[target[doc]], minlength=1 << BITS)
        flat = total.ravel()
        for b in range(0, cells, BLOCK):
            if flat[b : b + BLOCK].any():
                yield pa.record_batch([pa.array([b // BLOCK], pa.int32()), pa.array([flat[b : b + BLOCK].astype("<i8").tobytes()], pa.binary())], names=["block", "counts"])

    def add(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in blocks:
            for b, v in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(v, "<i8")
        for b, v in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "counts"])

    kind = "block int, counts binary"
    out = np.zeros(cells, np.int64)
    summed = docs.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind)
    for row in summed.toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(bytes(row["counts"]), "<i8")
    return out.reshape(2, len(SIZES), 1 << BITS)


def ratios(counts: np.ndarray) -> np.ndarray:
    """log target - log raw per size and cell, drawn to 0 where there is little of both."""
    target, raw = counts.astype(float)
    share = target.sum(1, keepdims=True) / np.maximum(raw.sum(1, keepdims=True), 1)
    return np.log((target + SMOOTHING) / (raw * share + SMOOTHING)).astype(np.float32)


def weighed(docs: DataFrame, table: np.ndarray, *keep: str) -> DataFrame:
    """The columns ``keep`` and log_ratio, the mean log ratio, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, total, used = part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                for k, (doc, cell) in enumerate(features(part.column("text"))):
                    total += np.bincount(doc, shared.value[k][cell], minlength=n)
                    if k == 0:
                        used += np.bincount(doc, minlength=n)
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(total / np.maximum(used, 1))], names=[*keep, "log_ratio"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("log_ratio", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def threshold(scores: np.ndarray, good: np.ndarray, cost: float = GOOD_COST) -> float:
    """The threshold with the least cost of good ones below and others at or above it.

    Between two scores it lies in the middle; of equally cheap thresholds the lowest is taken."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * cost
    kept = np.concatenate([[(~g).sum()], (~g).sum() - np.cumsum(~g)])
    cuts = np.concatenate([[-np.inf], (s[1:] + s[:-1]) / 2, [np.inf]])
    price = lost + kept
    price[1:-1][s[1:] == s[:-1]] = np.inf
    return float(cuts[int(np.argmin(price))])


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of ``key``, exactly, by histograms of narrowing ranges."""
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n or lo is None:
        return -np.inf
    while True:
        inside = rows.filter((F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi)))
        if lo == hi:
            return lo
        cells = 1000
        cell = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(hi - lo) * cells), F.lit(cells - 1))
        got = sorted(((r["c"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()), reverse=True)
        for _, n, a, b in got:
            if k <= n:
                lo, hi = a, b
                break
            k -= n


class Model:
    """A fitted classifier: the table of log ratios and the key from which documents are kept."""

    def __init__(self, table: np.ndarray, edge: float):
        self.table, self.edge = table, edge

    def judge(self, docs: DataFrame, *keep: str) -> DataFrame:
        """The columns ``keep`` of every row with log_ratio, key and kept."""
        return keyed(weighed(placed(docs), self.table, *dict.fromkeys(["doc_id", *keep, "_noise"]))).withColumn("kept", F.col("key") >= F.lit(float(self.edge)))


def _place(doc_id: str, seed: str, other: Column | None = None) -> Column:
    """A reproducible number in [0, 2**32) per document; null ids have one for each value of ``other``."""
    return F.conv(F.substring(digest(F.col(doc_id), seed, other), 1, 8), 16, 10).cast("long")


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with _noise, the number that a document's Gumbel noise is made of."""
    return docs.withColumn("_noise", _place("doc_id", SEED, F.xxhash64("text")))


def keyed(scores: DataFrame) -> DataFrame:
    """``key``: the log weight of a LENGTH-word text at this rate, plus Gumbel noise."""
    uniform = (F.col("_noise") + 0.5) / F.lit(4294967296.0)
    return scores.withColumn("key", F.col("log_ratio") * LENGTH - F.log(-F.log(uniform)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all of ``docs`` with the marks of ``labels`` (doc_id, quality)."""
    # Repeated labels of a document: good only if all are.
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("good"))
    share = min(1.0, 0.95 * FIT_ROWS / max(1, known.count()))
    marks = F.broadcast(known.filter(_place("_id", SEED + "-sample") < F.lit(int(share * 4294967296))).withColumn("fits", _place("_id", SEED + "-fold") % 2 == 0))
    joined = docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id"), "left")
    table = ratios(_counted(joined.select("text", F.coalesce(F.col("good") & F.col("fits"), F.lit(False)).alias("target"))))
    scores = written(weighed(placed(docs), table, "doc_id", "_noise"), "quality-scores")
    judged = scores.join(marks.filter(~F.col("fits")), F.col("doc_id") == F.col("_id"))
    sample = judged.groupBy("_id").agg(F.avg("log_ratio").alias("log_ratio"), F.first("good").alias("good")).toPandas()  # a row per chosen id at most
    least = threshold(sample["log_ratio"].to_numpy(), sample["good"].to_numpy(dtype=bool))
    if not np.isfinite(least):
        return Model(table, least)
    k = scores.filter(F.col("log_ratio") >= F.lit(least)).count()
    return Model(table, kth_largest(keyed(scores), "key", k) if k else np.inf)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, log_ratio, key, kept."""
    return fit(docs, labels).judge(docs).select("doc_id", "log_ratio", "key", "kept")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    hidden = veiled(docs, "doc_id", "text")
    return unveiled(fit(docs, labels).judge(hidden, *hidden.columns).filter("kept"), docs, "doc_id", "text")


def op8_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
