"""Operator 10: mixture-controlled packing of documents into token sequences.

Every document is its token ids and one end id.  Each source is a queue of documents in a fixed
pseudo-random order.  Deficit round-robin serves the queues: each window of ``SEQUENCE`` tokens
credits every source with its share of all tokens, the source furthest behind its share is
served next, and what it was given too little or too much stays on its account in the next
window.  Documents are cut freely, so windows are full.

The proportions are those of all tokens, or given weights: then the sources that are left fill
the windows in proportion once others are used up.

The queues are dealt to P partitions in advance, in grains of a sequence at least: a source of T
tokens is cut in G = min(P, T / grain) equal runs of tokens (one if it has fewer), and run g goes to
partition floor((g * P + o) / G), with o a digest of the source, so small sources go to few
partitions, each to others, and no run is empty.  What a source was dealt too little by then, its
share of the partitions before less its tokens in them, is its account when the partition starts
and decides who is served first, so deficits pass from partition to partition and none waits for
another.  Token positions are prefix sums that never gather a source in one task, and no task sees
all sources.  What is left at a partition's end, less than one window, becomes
sequences whose lengths are powers of two, which need no padding.

Null text: only the end id.  Null source: a queue of its own.  Repeated rows are documents of
their own.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import digest, running_sums, written

SEQUENCE = 2048
END = 1
#: Tokens dealt to one partition, about, and the least that a served queue gives if it has it.
PARTITION_TOKENS = 1 << 20
QUANTUM = 64
#: Pieces of words whose ids a task remembers; it starts anew once it holds more.
REMEMBERED = 300_000
#: Text encoded at a time.
ENCODED_BYTES = 8 << 20
RANGE_ROWS = 2000
#: Sequence ids of one partition: at most this many.
STRIDE = 1 << 20
SEED = "pack-1"

TOKENIZED = "row long, doc_id long, source string, doc_tokens long, ids binary"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stored_type(vocabulary: int) -> str:
    """The narrowest of two id types for tables and shuffles."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters whose lower case and composition are plain, and ASCII marks other than the apostrophe: the
#: tokens of a word of such letters, then such marks, are those of its letters and those of its marks.
_LETTERS = "".join(chr(c) for a, b in ("AZ", "az", "\u00c0\u00d6", "\u00d8\u00f6", "\u00f8\u012f", "\u0131\u0148", "\u014a\u017e") for c in range(ord(a), ord(b) + 1))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


class _Made(dict):
    """Values by key, made where they are missing."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Ids of whole texts through the ids of their words.

    This vocabulary's tokenizer drops white space and never joins tokens across it, so a text's
    ids are its words' ids in order.  Arrow cuts texts in words, and plain words in letters and marks,
    as the tokenizer cuts them; each distinct piece goes to the tokenizer's model once while it is
    remembered.  Any other word goes through the whole tokenizer, and so do texts with a special
    token's string."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stored = stored_type(self.tokenizer.get_vocab_size())
        self.width = np.dtype(self.stored).itemsize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = _Made(self._piece)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.stored).tobytes()

    def _whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(spelled)])

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        distinct = pieces.dictionary_encode()
        return pa.array([self.pieces[p] for p in distinct.dictionary.to_pylist()], pa.binary()).take(distinct.indices)

    def _of_words(self, words: pa.Array) -> pa.Array:
        letters, marks = pc.utf8_rtrim(words, _MARKS), pc.utf8_ltrim(words, _LETTERS)
        plain = pc.equal(pc.add(pc.binary_length(letters), pc.binary_length(marks)), pc.binary_length(words))
        none = pa.scalar("", pa.string())
        ids = pc.binary_join_element_wise(self._of_pieces(pc.utf8_lower(pc.if_else(plain, letters, none))), self._of_pieces(pc.if_else(plain, marks, none)), b"")
        odd = pc.invert(plain)
        return pc.replace_with_mask(ids, odd, pa.array([self._whole(w) for w in words.filter(odd).to_pylist()], pa.binary()))

    def encode(self, text: str) -> bytes:
        """One text's ids, little-endian unsigned 32-bit."""
        ids = self.encode_all(pa.array([text], pa.string()))[0][0].as_py()
        return np.frombuffer(ids, self.stored).astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array, *end: int) -> tuple[pa.Array, np.ndarray]:
        """Ids of each text (null: none) with ``end`` behind if given, in the stored type, and how many they are."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        texts = pc.fill_null(texts, "")
        whole = pa.array(np.any([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special] or [np.zeros(len(texts), bool)], axis=0))
        words = pc.ascii_split_whitespace(pc.if_else(whole, pa.scalar("", pa.string()), texts))
        distinct = words.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, self._of_words(distinct.dictionary).take(distinct.indices)), b"")
        joined = pc.replace_with_mask(joined, whole, pa.array([self._whole(t) for t in texts.filter(whole).to_pylist()], pa.binary()))
        ids = pc.binary_join_element_wise(joined, self.packed(list(end)), b"")
        return ids, pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // self.width


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def sliced(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenized(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """row (a number), doc_id, source, doc_tokens and ids: the ids with the end id, in ``stored_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary_path())
        for batch in batches:
            for part in sliced(batch, "text", ENCODED_BYTES):
                ids, counts = enc.encode_all(part.column("text"), end)
                yield pa.record_batch([part.column("row"), part.column("doc_id"), part.column("source"), pa.array(counts, pa.int64()), ids], names=["row", "doc_id", "source", "doc_tokens", "ids"])
        # The worker lives on and serves other stages, which need its memory.
        enc.pieces.clear()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, TOKENIZED)


def serve(shares: list[tuple], window: int = SEQUENCE, quantum: int = QUANTUM, weights: dict | None = None, carried: dict | None = None) -> list[tuple]:
    """Deficit round-robin over one partition.

    ``shares``: (source, row, start, length) in queue order, each with a token at least.  Returns (row, start, length,
    sequence, offset).  ``weights``: whole numbers by source, else the sources' tokens.
    ``carried``: by source, the tokens that the partitions before owe it.  Credits are kept as integers: a source's weight times tokens dealt so far, less its own
    dealt tokens times all weights."""
    queues: dict = {}
    for source, row, start, length in shares:
        queues.setdefault(source, []).append([row, start, length])
    totals = {s: sum(x[2] for x in q) for s, q in queues.items()}
    everything = sum(totals.values())
    lengths = [window] * (everything // window)
    rest = everything % window
    lengths += [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
    weight = {s: max(1, weights.get(s, 1)) for s in queues} if weights else totals
    whole = sum(weight.values())
    at, given, out, dealt = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), [], 0
    # The next service of a source is due when the tokens dealt reach given / share; of equals, the one that is owed most.
    owed_before = {s: -(carried or {}).get(s, 0) for s in queues}
    due = [(0, owed_before[s], s) for s in queues]
    heapify(due)
    for sequence, size in enumerate(lengths):
        offset = 0
        while offset < size:
            *_, source = heappop(due)
            owed = weight[source] * (dealt + size - offset) // whole - given[source]
            queue = queues[source]
            row, start, length = queue[at[source]]
            take = min(length, size - offset, max(quantum, owed))
            out.append((row, start, take, sequence, offset))
            if take == length:
                at[source] += 1
            else:
                queue[at[source]] = [row, start + take, length - take]
            offset += take
            dealt += take
            given[source] += take
            if at[source] < len(queue):
                heappush(due, (given[source] * whole // weight[source], owed_before[source], source))
    return out


def pack(docs: DataFrame, path: str | None = None, end: int = END, window: int = SEQUENCE, quantum: int = QUANTUM, partition_tokens: int = PARTITION_TOKENS, weights: Mapping[str | None, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``weights``: by source, whole numbers in place of the sources' tokens; 1 for others."""
    tokens = written(tokenized(docs, path, end), "pack-tokens")
    counts = tokens.select("row", "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue"), "source", "doc_tokens")
    sources = written(counts.groupBy("queue").agg(F.sum("doc_tokens").alias("source_tokens")), "pack-sources")
    total = sources.agg(F.sum("source_tokens")).first()[0] or 0
    parts = max(1, -(-total // partition_tokens))
    dealt = sources.withColumns({"grains": F.expr(f"greatest(1, least({parts}, source_tokens div {window}))"), "phase": F.pmod(F.xxhash64("queue"), F.lit(parts))})
    rows = counts.join(dealt, "queue")
    rows = rows.withColumns({"klass": F.lit(0), "digest": digest(F.col("doc_id"), SEED, F.col("row"))})
    placed = running_sums(rows, "queue", "klass", "digest", "doc_tokens", [F.col("row")], RANGE_ROWS)
    # Token x of T is in run floor((x * grains + grains - 1) / T), the last g with floor(T * g / grains) <= x.
    # Products of two large counts need more than 64 bits.
    wide = lambda x: f"cast(({x}) as decimal(19, 0))"
    run_of = lambda x: F.expr(f"({wide(x)} * {wide('grains')} + grains - 1) div source_tokens")
    spread = placed.withColumn("grain", F.explode(F.sequence(run_of("before"), run_of("before + doc_tokens - 1"))))
    cut = lambda g: F.expr(f"({wide('source_tokens')} * {wide(g)}) div grains")
    start = F.greatest(cut("grain") - F.col("before"), F.lit(0))
    stop = F.least(cut("grain + 1") - F.col("before"), F.col("doc_tokens"))
    spread = spread.withColumn("part", F.expr(f"(grain * {parts} + phase) div grains"))
    carried = F.col("source_tokens").cast("double") * F.col("part") / parts - cut("grain")
    told = F.create_map(*[x for k, v in (weights or {}).items() if k is not None for x in (F.lit(k), F.lit(int(v)))]).cast("map<string,bigint>")
    own = F.when(F.col("source").isNull(), F.lit(int((weights or {}).get(None, 1)))).otherwise(F.coalesce(told[F.col("source")], F.lit(1)))
    weight = own if weights else F.lit(None)
    shares = spread.select("part", "queue", "before", "row", start.alias("start"), (stop - start).alias("length"), carried.alias("carried"), weight.cast("long").alias("weight"))

    def serve_part(table: pa.Table) -> pa.Table:
        table = table.sort_by([("queue", "ascending"), ("before", "ascending")])
        part = table.column("part")[0].as_py()
        queues = table.column("queue").to_pylist()
        carried, told = (dict(zip(queues, table.column(c).to_pylist(), strict=True)) for c in ("carried", "weight"))
        pieces = serve(list(zip(queues, *[table.column(c).to_pylist() for c in ("row", "start", "length")], strict=True)), window, quantum, told if weights else None, carried)
        cols = list(zip(*pieces, strict=True))
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([part * STRIDE + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())], names=["row", "start", "length", "sequence_id", "offset"])

    pieces = shares.groupBy("part").applyInArrow(serve_part, "row long, start long, length long, sequence_id long, offset long")
    per_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = encoder(path or vocabulary_path()).stored
        for b in batches:
            lists = b.column("pieces")
            cuts = lists.flatten()
            start, length = cuts.field("start").to_numpy(), cuts.field("length").to_numpy()
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = [memoryview(np.frombuffer(x, stored).astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[d][4 * s : 4 * (s + n)]) for d, s, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
            doc = pa.array(of)
            yield pa.record_batch([b.column("doc_id").take(doc), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), b.column("doc_tokens").take(doc), cuts.field("sequence_id"), cuts.field("offset"), b.column("source").take(doc)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return tokens.join(per_row, "row").select("doc_id", "source", "doc_tokens", "ids", "pieces").mapInArrow(checked, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op10_pack(docs: DataFrame) -> DataFrame:
    return pack(docs)
