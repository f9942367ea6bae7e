"""Operator 13: exact copies by an exchange of Golomb-coded fingerprints.

* The documents are written once as a table bucketed by the task that read them: normalised text,
  SHA-256, and the row's place.  Each task writes one bucket, so this shuffles nothing, and later
  stages find the rows of a batch together without moving them.
* A batch sends each owner (an equal range of the fingerprint space) the distinct fingerprints
  that fall there, sorted and Golomb-coded.  A fingerprint is the front of the digest, seven bits
  longer than it takes to number all rows, so a row costs about three bytes on the way.
* An owner answers every batch with a bitmap of what another batch sent too.  A batch adds what it
  holds twice itself.  Rows without a mark are unique and are settled where they lie.
* Only suspects go on: they are grouped by digest and the bytes of the whole text, counted before
  the shuffle, so that a task sends each distinct text once, however hot.  That verifies every
  group; equal fingerprints of different texts end there as groups of one.

Texts are equal after lower-casing A to Z.  Null text: as an empty one.  Of equal texts the row
with the largest doc_id stays; null ids come after all others, so a group without ids keeps one
row, with keep_id null.  Of equal rows exactly one stays, the first in the table written.  Two
different texts with one SHA-256 would end the job with an error.  An empty table gives an empty
result.  Extra columns are ignored, and carried by ``without_copies``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bucketed, parallelism, unveiled, veiled, written
from graphloom.llm.golomb import decode, encode

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a fingerprint beyond those that number all rows: one unique row in 2 ** 7 is suspected wrongly, about.
FALSE_BITS = 7
#: The digest's bits that can be taken.
DIGEST_BITS = 60
#: Buckets and owners, at most: 3.4e7 messages between them.
BUCKETS, OWNERS = 16_384, 2_048


def normalised(text: Column) -> Column:
    """A text as it is compared: A to Z in lower case, null as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _stored(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The rows with batch, pos, text, sha and front (the digest's first bits), bucketed by batch."""
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"), F.spark_partition_id().alias("batch"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"), *carry)
    rows = rows.withColumn("hex", F.sha2("text", 256))
    front = F.conv(F.substring("hex", 1, DIGEST_BITS // 4), 16, 10).cast("long")
    return bucketed(rows.withColumns({"front": front, "sha": F.unhex("hex")}).drop("hex"), "exact", "batch", min(BUCKETS, parallelism(docs.sparkSession)))


def marks(cards: DataFrame, bits: int, owners: int) -> DataFrame:
    """One row per batch: batch, bitmap; bit ``pos`` is set where the row's fingerprint occurs again.

    ``cards``: batch, pos, front."""
    cards = cards.select("batch", "pos", F.shiftright("front", DIGEST_BITS - bits).alias("print"))
    starts = [-(-(o << bits) // owners) for o in range(owners + 1)]
    edges = np.array(starts[:-1], np.int64)

    def of_owners(prints: np.ndarray) -> list[tuple[int, np.ndarray]]:
        at = np.append(np.searchsorted(prints, edges), len(prints))
        return [(int(o), prints[at[o] : at[o + 1]]) for o in np.flatnonzero(np.diff(at))]

    def send(key: tuple, table: pa.Table) -> pa.Table:
        own = of_owners(np.unique(table.column("print").to_numpy()))
        blobs = [encode(p - starts[o], starts[o + 1] - starts[o]) for o, p in own]
        return pa.table({"batch": pa.array([key[0].as_py()] * len(own), pa.int32()), "owner": pa.array([o for o, _ in own], pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        o = key[0].as_py()
        sent = [decode(b, starts[o + 1] - starts[o]) for b in table.column("blob").to_pylist()]
        _, place, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        again = np.split(count[place] > 1, np.cumsum([len(s) for s in sent])[:-1])
        return pa.table({"batch": table.column("batch"), "owner": table.column("owner"), "blob": pa.array([np.packbits(a).tobytes() for a in again], pa.binary())})

    def mark(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        prints, place, count = np.unique(rows.column("print").to_numpy(), return_inverse=True, return_counts=True)
        got = dict(zip(answers.column("owner").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        again = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(got[o], np.uint8), count=len(p)).astype(bool) for o, p in of_owners(prints)]])
        pos = rows.column("pos").to_numpy()
        bitmap = np.zeros(int(pos.max()) + 1 if len(pos) else 0, bool)
        bitmap[pos] = (again | (count > 1))[place]
        return pa.table({"batch": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    messages = cards.groupBy("batch").applyInArrow(send, "batch int, owner int, blob binary")
    answers = messages.groupBy("owner").applyInArrow(answer, "batch int, owner int, blob binary")
    return cards.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(mark, "batch int, bitmap binary")


def decisions(docs: DataFrame, carry: tuple[str, ...] = (), false_bits: int = FALSE_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha, and the columns to carry."""
    stored = _stored(docs, carry)
    bits = min(DIGEST_BITS, max(1, math.ceil(math.log2(stored.count() + 1)) + false_bits))
    bitmaps = written(marks(stored.select("batch", "pos", "front"), bits, min(OWNERS, parallelism(docs.sparkSession))), "exact-marks")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(pos div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.expr("cast(7 - pos % 8 as int)")
    flagged = stored.join(bitmaps.hint("shuffle_hash"), "batch").withColumn("suspect", F.call_function("shiftright", byte, marked).bitwiseAND(1) == 1)
    place = (F.col("batch").cast("long") * (1 << 33) + F.col("pos")).alias("place")
    suspects = flagged.filter("suspect")
    # Bytes decide: a group is one digest and one whole text.
    verified = suspects.groupBy("sha", "text").agg(F.count("*").alias("rows"))
    sizes = verified.groupBy("sha").agg(F.sum("rows").alias("group_size"), F.count("*").alias("texts"))
    # Of equal rows the first in the table; of the ids the largest.
    firsts = suspects.select("sha", "doc_id", place).groupBy("sha", "doc_id").agg(F.min("place").alias("place"))
    keepers = firsts.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("place", "doc_id"), F.min("place")).alias("keeper"))
    one_text = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    groups = written(sizes.join(keepers, "sha").select("sha", "keep_id", "keeper", one_text.alias("group_size")), "exact-groups")
    alone = flagged.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *carry)
    joined = suspects.select("doc_id", place, "sha", *carry).join(groups, "sha")
    return alone.union(joined.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keeper")).alias("kept"), "sha", *carry))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    rows = veiled(docs, "doc_id", "text").withColumn("_own", F.col("text"))
    carry = tuple(c for c in rows.columns if c not in ("doc_id", "text"))
    kept = decisions(rows, carry).filter("kept").withColumn("text", F.col("_own"))
    return unveiled(kept, docs, "doc_id", "text")


def op13_exact_dedup(docs: DataFrame) -> DataFrame:
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = """
WITH normal AS (
  SELECT doc_id, row_number() OVER () AS place,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST, place) = 1 AS kept,
       sha256(text) AS text_sha256
FROM normal
"""
