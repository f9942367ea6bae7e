"""Operator 4: removal of passages that repeat across documents, by fixed-block anchors.

A repeat is a window of ``WINDOW`` consecutive words.  Reference documents are cut into
non-overlapping blocks of ``BLOCK`` words; 13 = 2 * 7 - 1, so wherever a window lies in its
document it holds exactly one whole block.

1. Index and probe.  Every batch of documents sends the hashes of all its rolling 7-word
   windows, marked where they are blocks.  A hash range builds the block index from the marks,
   probes it with everything it got, and answers which hashes hit a block elsewhere.
2. Extend.  A batch extends its hits to all the 13-word windows around them and sends those
   windows' 88-bit hashes with its smallest document id for each.  A range answers whether that
   id is the smallest of all.  So every hit is extended against all documents with the block at
   once, and never pair by pair: a block of thousands of documents costs thousands of entries.
3. Cover.  Each word of a window that also starts in a document with a smaller id goes;
   overlapping windows merge into maximal repeats.

Windows are compared by 64 + 24 hash bits: a wrong removal is expected once in about 10^13
words.  Windows are judged on the input, not on what is left, and never cross documents.

Null text: no words.  Null doc_id: larger than every id, and all null ids count as one document
id.  Rows that repeat an id are never smaller than each other, so none of them loses words to
the other.  An empty table gives an empty result.  Extra columns pass through ``dedup``.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import exchange as X
from graphloom.llm.common import unveiled, veiled
from graphloom.llm.tokens import U64, windows, words

BLOCK = 7
WINDOW = 13
#: Tags of the two rounds of questions.
ANCHORS, EXTENDED = 1, 2
_FLAG_SHIFT = U64(16)
_KEY_MASK = ~U64((1 << 18) - 1)
_NULL_ID = U64(2**64 - 1)


def doc_keys(table: pa.Table) -> np.ndarray:
    """doc_id as unsigned integers in the same order; null last."""
    ids = table.column("doc_id").combine_chunks().cast(pa.int64())
    raw = ids.fill_null(0).to_numpy(zero_copy_only=False).view(U64) ^ U64(1 << 63)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, _NULL_ID, raw)


def text_of(table: pa.Table) -> pa.Array:
    return table.column("text").combine_chunks()


class Anchors:
    """A batch's rolling windows of BLOCK words, sorted by hash, with their flags."""

    def __init__(self, table: pa.Table, block: int):
        keys = doc_keys(table)
        order = np.argsort(keys, kind="stable")
        self.table = table.take(pa.array(order))
        self.ids = keys[order]
        self.words = words(text_of(self.table))
        hashes, valid = windows(self.words, block)
        self.at = np.flatnonzero(valid)
        _, self.rank = np.unique(self.ids, return_inverse=True)
        rank = np.repeat(self.rank, np.diff(self.words.first))[self.at]
        in_doc = self.at - np.repeat(self.words.first[:-1], np.diff(self.words.first))[self.at]
        self.order, starts, self.run = X.runs(hashes[self.at] & _KEY_MASK)
        ends = np.append(starts[1:], len(self.order)) - 1
        self.keys = np.zeros(0, U64)
        if len(starts):
            block_here = np.logical_or.reduceat((in_doc % block == 0)[self.order], starts)
            # Positions ascend by document, and the sort is stable.
            several = rank[self.order[starts]] != rank[self.order[ends]]
            self.keys = (hashes[self.at][self.order[starts]] & _KEY_MASK) | ((block_here | (several << 1)).astype(U64) << _FLAG_SHIFT)

    def hits(self, shared: np.ndarray) -> np.ndarray:
        """Per word position, whether the window there hit a block of another document."""
        out = np.zeros(len(self.words.hash), bool)
        if len(shared):
            out[self.at[self.order]] = shared[self.run]
        return out


class Extended:
    """The WINDOW-word windows around a batch's hits, by hash, with the smallest id of each."""

    def __init__(self, anchors: Anchors, shared: np.ndarray, block: int, window: int):
        w = anchors.words
        hit = np.concatenate([[0], np.cumsum(anchors.hits(shared))])
        hashes, valid = windows(w, window, 1)
        more, _ = windows(w, window, 2)
        reach = window - block + 1
        last = np.minimum(np.arange(len(valid)) + reach, len(valid))
        self.at = np.flatnonzero(valid & (hit[last] > hit[:-1]))
        self.order, starts, self.run = X.runs(hashes[self.at])
        first = self.order[starts] if len(starts) else np.zeros(0, np.int64)
        self.keys = hashes[self.at][first]
        self.more = more[self.at][first] >> U64(40)
        self.rank = np.repeat(anchors.rank, np.diff(w.first))[self.at]
        self.least_rank = self.rank[first]
        self.least_id = np.repeat(anchors.ids, np.diff(w.first))[self.at][first]

    def repeated(self, own_is_least: np.ndarray, n: int) -> np.ndarray:
        """Per word position, whether the window there starts in a smaller document too."""
        out = np.zeros(n, bool)
        if len(self.at):
            least = self.least_rank[self.run]
            ranks = self.rank[self.order]
            out[self.at[self.order]] = (ranks > least) | ~own_is_least[self.run]
        return out


def _answer_anchors(table: pa.Table) -> pa.Table:
    keys, spans, _ = X.merged(table, ANCHORS)
    flags = keys & U64(3)
    order, starts, run = X.runs(keys >> U64(2))
    sizes = np.diff(np.append(starts, len(keys)))
    found = np.bitwise_or.reduceat(flags[order], starts)
    shared = ((found & U64(1)) > 0) & ((sizes > 1) | (found & U64(2) > 0))
    out = np.empty(len(keys), bool)
    out[order] = shared[run]
    bucket = table.column("bucket")[0].as_py()
    return X.rows((b, ANCHORS, bucket, X.pack(X.pack_bits(out[a:z]))) for b, a, z in spans)


def _answer_extended(table: pa.Table) -> pa.Table:
    keys, spans, (more, ids) = X.merged(table, EXTENDED)
    order = np.lexsort((more, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(keys), bool)
    out[order] = ids[order] == least
    bucket = table.column("bucket")[0].as_py()
    return X.rows((b, EXTENDED, bucket, X.pack(X.pack_bits(out[a:z]))) for b, a, z in spans)


def _kept(table: pa.Table, anchors: Anchors, starts: np.ndarray, window: int, hashed: bool) -> pa.Table:
    cover = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + window, len(starts)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    first = anchors.words.first
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    kept = []
    for i, text in enumerate(text_of(table).to_pylist()):
        if text is None or (not hashed and not removed[i]):
            kept.append(text)
            continue
        parts = text.encode().split()
        if removed[i]:
            parts = compress(parts, (~gone[first[i] : first[i + 1]]).tolist())
        kept.append(b" ".join(parts).decode())
    if hashed:
        kept = [hashlib.sha256((k or "").encode()).hexdigest() for k in kept]
    out = table.drop_columns(["batch", "text"])
    return out.append_column("n_words", pa.array(np.diff(first), pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept", pa.array(kept, pa.string()))


def dedup(docs: DataFrame, block: int = BLOCK, window: int = WINDOW, hashed: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, and n_words, n_removed and kept; no other column may have such a name, or batch.

    ``kept`` is the text itself where nothing went, else the kept words joined by one space;
    with ``hashed`` it is the SHA-256 of the kept words joined by one space, for every row."""
    if window != 2 * block - 1:
        raise ValueError("each window must hold exactly one block: window = 2 * block - 1")
    plan = X.plan(docs)
    buckets = plan.gates
    held = X.in_batches(docs, plan.batches, *docs.columns)

    def probe(table: pa.Table) -> pa.Table:
        a = Anchors(table, block)
        return X.rows(X.questions(table.column("batch")[0].as_py(), ANCHORS, buckets, a.keys, drop_bits=16))

    def anchored(table: pa.Table, got: dict) -> tuple[Anchors, Extended]:
        a = Anchors(table, block)
        found = X.answers(got, ANCHORS, a.keys, buckets, bits=True)
        return a, Extended(a, found[0] if found else np.zeros(0, bool), block, window)

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.rows([])
        _, e = anchored(table, X.by_batch(replies))
        return X.rows(X.questions(table.column("batch")[0].as_py(), EXTENDED, buckets, e.keys, e.more, e.least_id))

    kept_schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        got = X.by_batch(replies)
        a, e = anchored(table, got)
        least = X.answers(got, EXTENDED, e.keys, buckets, bits=True)
        starts = e.repeated(least[0], len(a.words.hash)) if least else np.zeros(len(a.words.hash), bool)
        return _kept(a.table, a, starts, window, hashed)

    hits = plan.ask(held.groupBy("batch").applyInArrow(probe, X.MESSAGE), _answer_anchors, {ANCHORS: 16}, (ANCHORS,)).repartition("batch")
    windows_out = held.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, X.MESSAGE)
    replies = hits.unionByName(plan.ask(windows_out, _answer_extended, bits=(EXTENDED,)))
    return held.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cover, kept_schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; the texts of other rows stay as they are."""
    plain = ("doc_id", "text", "n_chars")
    out = dedup(veiled(docs, *plain))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return unveiled(out.withColumns(new), docs, *plain)


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"), hashed=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: Windows of 13 words by their words, each with the smallest document that has it.
ORACLE = r"""
WITH ws AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM ws)),
least AS (SELECT k, min(doc_id) AS m FROM starts GROUP BY k HAVING count(*) > 1),
dup AS (SELECT s.doc_id, s.i FROM starts s JOIN least l ON s.k = l.k AND s.doc_id > l.m),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 13) t(j)),
wordrows AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM ws),
kept AS (
  SELECT r.doc_id, string_agg(r.word, ' ' ORDER BY r.p) FILTER (g.p IS NULL) AS t,
         count(g.p) AS n_removed
  FROM wordrows r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.p = g.p GROUP BY r.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM ws d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
