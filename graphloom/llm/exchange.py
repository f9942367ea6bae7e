"""Two-way exchange between batches of documents and ranges of a hash space.

Many operators here must know, for very many hashed items of every document, something that
only the whole corpus tells: whether an item occurs elsewhere, how often, in which document
first.  One row per item would make the shuffle many times the input and would send every copy
of a hot item to one task.  Instead:

* documents are put in batches by a hash of their id (one shuffle of the texts);
* a batch sorts and dedups its items, so however hot an item is, a batch sends it once;
* it sends each range of the hash space one packed row, with delta-coded hashes;
* a range merges the rows of all batches and answers each of them with one packed row, in the
  order of what it was asked, so answers need no keys.

Ranges and batches are of equal size by construction: no key, source or group of copies can
unbalance them.  All stages are plain shuffles of one lazy plan, so lost executors cost only a
recomputation.

Between n batches and n ranges that would be n * n rows.  Beyond ``DIRECT`` batches the rows go in
two steps instead: a batch addresses about sqrt(n) gates, each a run of ranges; a node stands
between about sqrt(n) batches and one gate, merges their rows and asks the gate's ranges like a
batch of its own, and takes the answers apart again.  That makes about 4 * n * sqrt(n) rows both
ways, each as large as a row would be if there were only sqrt(n) ranges, and no node holds more
than a batch sends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import parallelism

U64 = np.uint64
MESSAGE = "batch int, tag int, bucket int, blob binary"
ARROW_MESSAGE = pa.schema([("batch", pa.int32()), ("tag", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: Bytes of text in a batch, about.
BATCH_BYTES = 4 << 20
#: Batches that send their rows to all ranges directly, at most.
DIRECT = 1024


@dataclass(frozen=True)
class Plan:
    """``batches``; the ``gates`` that they address; the ``ranges`` of the hash space, a whole number to
    each gate; and the batches that share a node on the way (``group``, 0: there are no nodes)."""

    batches: int
    gates: int
    ranges: int
    group: int

    def ask(self, messages: DataFrame, answer: Callable[[pa.Table], pa.Table], dropped: Mapping[int, int] | None = None, bits: tuple[int, ...] = ()) -> DataFrame:
        """Answers to ``messages``: one call of ``answer`` per range, on the rows of all batches.

        ``dropped``: by tag, the low bits of keys that are not sent.  ``bits``: tags whose answers
        are one bit array.  Rows that ``answer`` sends to negative batches come through as they
        are, a group for each such batch: they should be many where the ranges are many."""
        if not self.group:
            return messages.groupBy("bucket").applyInArrow(answer, MESSAGE)
        dropped, ranges = dict(dropped or {}), self.ranges

        def opened(table: pa.Table) -> Iterator[tuple]:
            for tag in sorted(set(table.column("tag").to_pylist())):
                keys, spans, rest = merged(table, tag)
                yield tag, np.argsort(keys, kind="stable"), keys << U64(dropped.get(tag, 0)), spans, rest

        def forward(key: tuple, table: pa.Table) -> pa.Table:
            asked = []
            for tag, order, keys, _, rest in opened(table):
                asked += questions(key[0].as_py(), tag, ranges, keys[order], *[r[order] for r in rest], drop_bits=dropped.get(tag, 0))
            return rows(asked)

        def back(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
            if key[0].as_py() < 0:
                return replies
            got, gate, out = by_batch(replies), key[0].as_py() % self.gates, []
            for tag, order, keys, spans, _ in opened(table):
                found = answers(got, tag, keys[order], ranges, tag in bits)
                placed = []
                for values in found:
                    at = np.empty(len(values), values.dtype)
                    at[order] = values
                    placed.append(at)
                out += [(b, tag, gate, pack(pack_bits(placed[0][a:z])) if tag in bits else pack(*[v[a:z] for v in placed])) for b, a, z in spans if z > a]
            return rows(out)

        node = (F.floor(F.col("batch") / self.group) * self.gates + F.col("bucket")).cast("int")
        posted = messages.groupBy(node.alias("node"))
        replied = posted.applyInArrow(forward, MESSAGE).groupBy("bucket").applyInArrow(answer, MESSAGE)
        return posted.cogroup(replied.groupBy(F.col("batch").alias("node"))).applyInArrow(back, MESSAGE)


def plan(docs: DataFrame, text: str = "text") -> Plan:
    """Batches of about BATCH_BYTES of text, and as many hash ranges."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(parallelism(docs.sparkSession), -(-total // BATCH_BYTES))
    if n <= DIRECT:
        return Plan(n, n, n, 0)
    gates = math.isqrt(n - 1) + 1
    return Plan(n, gates, gates * -(-n // gates), gates)


def in_batches(docs: DataFrame, batches: int, *cols: str) -> DataFrame:
    """``docs`` with a batch number; rows of one doc_id share a batch, null ids are spread by text."""
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    return docs.select(F.pmod(key, F.lit(batches)).cast("int").alias("batch"), *[F.col(c) for c in cols])


# --- packing -----------------------------------------------------------------------------


def planes(x: np.ndarray) -> np.ndarray:
    """Little-endian byte planes of unsigned integers, without the leading zero planes.

    Byte planes keep like bytes together, so that Spark's own shuffle compression works on them."""
    x = x.astype(U64, copy=False)
    need = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :need].T).ravel()


def unplanes(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.reshape(-1).view(U64) if n else np.zeros(0, U64)


def deltas(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers or bytes as one blob: lengths, then byte planes."""
    parts = [(len(a), planes(a)) for a in arrays]
    head = np.array([len(parts)] + [v for n, p in parts for v in (n, len(p))], np.int64)
    return head.tobytes() + b"".join(p.tobytes() for _, p in parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * count, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * count
    for n, size in head.tolist():
        out.append(unplanes(np.frombuffer(blob, np.uint8, size, at), n))
        at += size
    return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits)


def unpack_bits(raw: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(raw.astype(np.uint8), count=n).astype(bool)


# --- questions and answers ------------------------------------------------------------------


def bucket_start(b: int, buckets: int) -> int:
    """First key of a bucket; its low bits are 0, so flags in the low bits of keys never part equal keys."""
    return ((b << 64) // buckets) >> 24 << 24


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Positions at which sorted 64-bit keys pass from one bucket to the next: buckets + 1 of them."""
    edges = np.array([bucket_start(b, buckets) for b in range(buckets)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def questions(batch: int, tag: int, buckets: int, keys: np.ndarray, *rest: np.ndarray, drop_bits: int = 0) -> Iterator[tuple]:
    """Rows that ask about sorted 64-bit ``keys`` with arrays ``rest`` alongside, for buckets that have keys.

    ``drop_bits`` low bits of the keys, which are 0, are not sent."""
    edges = bucket_edges(keys, buckets)
    sent = keys >> U64(drop_bits) if drop_bits else keys
    for b in np.flatnonzero(np.diff(edges)):
        a, z = edges[b], edges[b + 1]
        yield batch, tag, int(b), pack(deltas(sent[a:z]), *[r[a:z] for r in rest])


def rows(items) -> pa.Table:
    items = list(items)
    cols = list(zip(*items)) if items else [[], [], [], []]
    return pa.table([pa.array(c, t.type) for c, t in zip(cols, ARROW_MESSAGE)], schema=ARROW_MESSAGE)


def merged(table: pa.Table, tag: int) -> tuple[np.ndarray, list[tuple[int, int, int]], list[np.ndarray]]:
    """What a bucket got: keys of all rows, (batch, from, to) of each row, and the arrays alongside."""
    keys, spans, rest, at = [], [], [], 0
    tags = table.column("tag").to_numpy()
    batch = table.column("batch").to_numpy()
    blobs = table.column("blob")
    for i in np.flatnonzero(tags == tag):
        got = unpack(blobs[int(i)].as_py())
        k = np.cumsum(got[0], dtype=U64)
        keys.append(k)
        rest.append(got[1:])
        spans.append((int(batch[i]), at, at + len(k)))
        at += len(k)
    if not keys:
        return np.zeros(0, U64), [], []
    return np.concatenate(keys), spans, [np.concatenate(c) for c in zip(*rest)]


def runs(keys: np.ndarray, stable: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start of each run in that order, run of each ordered entry) of equal keys."""
    order = np.argsort(keys, kind="stable" if stable else None)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def by_batch(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """(tag, bucket) -> blob of the answers that one batch got."""
    return {(t, b): v for t, b, v in zip(table.column("tag").to_pylist(), table.column("bucket").to_pylist(), table.column("blob").to_pylist())}


def answers(got: dict[tuple[int, int], bytes], tag: int, keys: np.ndarray, buckets: int, bits: bool = False) -> list[np.ndarray]:
    """The answer arrays for sorted unique ``keys``, put together over the buckets; ``bits``: one bit array."""
    edges = bucket_edges(keys, buckets)
    parts: list[list[np.ndarray]] = []
    for b in np.flatnonzero(np.diff(edges)):
        n = int(edges[b + 1] - edges[b])
        arrays = unpack(got[(tag, int(b))])
        parts.append([unpack_bits(arrays[0], n)] if bits else arrays)
    if not parts:
        return []
    return [np.concatenate(c) for c in zip(*parts)]
