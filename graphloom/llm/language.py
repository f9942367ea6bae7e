"""Operator 7: language identification with error-correcting output codes.

Every language has a codeword.  For each bit of the codewords a binary classifier over hashed
byte n-grams (1 to 3 bytes, A-Z folded) tells which half of the languages a text belongs to: its
margin is the mean, over the text's n-grams, of log p(n-gram | bit 1) - log p(n-gram | bit 0).
Decoding sums, over the bits, a logistic loss of margin against codeword, weighted by how well
the bit's classes separate, and takes the codeword with the least loss.  The score is the softmax
of the negative losses; a text whose two best codewords are close is flagged as ambiguous.

The model is fitted on about ``FIT_ROWS`` labelled rows, or all there are, of each language (those with the
smallest id digests); prediction covers every row and the whole of every text.

Null text or a text without letters: ``und`` with score 0.  Null lang is never learned from; a
null doc_id counts as not held out.  Without any labelled row every prediction is ``und``.
Equal losses go to the language first in code-point order.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import digest
from graphloom.llm.tokens import U64, _LOWER, buffers, chunks

#: Labelled rows of each language that the model is fitted on, about, at most.
FIT_ROWS = 5000
#: Tasks that count n-grams for the fit.
FIT_TASKS = 16
BITS = 16
SIZES = (1, 2, 3)
#: Bytes of text whose n-grams are held at a time.
RUN_BYTES = 1 << 18
SMOOTHING = 0.5
#: Margins are multiplied by this before the loss, and the score gap below which a text is ambiguous.
SHARPNESS = 20.0
AMBIGUOUS = 0.2
UNKNOWN = "und"
SEED = "lang-1"
_MULTIPLIER = U64(0x9E3779B97F4A7C15)


def ngrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, offsets, features) of runs of texts: a row of hashed n-grams per byte.

    A long text comes in several runs of its own, whose rows follow each other.
    A feature 2**BITS stands for an n-gram that would pass the end of its text."""
    data, offsets = buffers(texts)
    longest = max(SIZES) - 1
    for a, b in chunks(offsets, RUN_BYTES):
        first, end = int(offsets[a]), int(offsets[b])
        for lo in range(first, max(end, first + 1), RUN_BYTES if b - a == 1 else max(1, end - first)):
            hi = min(end, lo + RUN_BYTES) if b - a == 1 else end
            # The n-grams of the last bytes reach into what follows.
            part = _LOWER[data[lo : min(end, hi + longest)]].astype(U64)
            at = np.clip(offsets[a : b + 1], lo, hi) - lo
            n = hi - lo
            out = np.full((n, len(SIZES)), 1 << BITS, np.int64)
            left = np.repeat(offsets[a + 1 : b + 1] - lo, np.diff(at)) - np.arange(n)
            code = np.zeros(len(part), U64)
            for k, size in enumerate(SIZES):
                code = (code << U64(8))
                code[: max(0, len(part) - size + 1)] |= part[size - 1 :]
                fits = left >= size
                out[fits, k] = (((code[:n][fits] << U64(2)) | U64(size)) * _MULTIPLIER >> U64(64 - BITS)).astype(np.int64)
            yield a, b, at, out


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits in two for few languages, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (s >> i & 1) else -1 for s in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    bits = 15 + 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for seed in range(50):
        code = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        alike = code.astype(np.int32) @ code.T
        np.fill_diagonal(alike, -code.shape[1])
        least = (code.shape[1] - int(alike.max())) // 2
        if least > apart:
            best, apart = code, least
    return best


class Model:
    """Languages, their codewords, and per bit a weight for each n-gram and for the bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.code = codewords(len(self.langs))
        table = np.stack([counts[x] for x in self.langs]).astype(float) if counts else np.zeros((0, 1 << BITS))
        # Every language weighs the same in a bit, however many texts it has.
        table = table / np.maximum(table.sum(1, keepdims=True), 1) * 1e6
        bits = self.code.shape[1] if counts else 0
        self.weights = np.zeros(((1 << BITS) + 1, bits), np.float32)
        self.trust = np.ones(bits)
        for b in range(bits):
            one, zero = (table[self.code[:, b] == s].sum(0) + SMOOTHING for s in (1, -1))
            one, zero = one / one.sum(), zero / zero.sum()
            w = np.log(one) - np.log(zero)
            self.weights[:-1, b] = w
            self.trust[b] = max(float(((one - zero) * w).sum()), 1e-6)
        self.trust /= max(self.trust.mean(), 1e-9) if bits else 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) per row of margins."""
        x = -SHARPNESS * margins[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, x) * self.trust).sum(2)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = chance.max(1)
        second = np.sort(chance, 1)[:, -2] if chance.shape[1] > 1 else np.zeros(len(chance))
        return best, top, top - second < AMBIGUOUS


def fit(docs: DataFrame, rows_per_language: int = FIT_ROWS) -> Model:
    """The model of the rows of ``docs`` with a lang."""
    labelled = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    # A digest bound per language that lets about rows_per_language rows through.
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, rows_per_language / v))])[F.col("lang")]
    place = F.conv(F.substring(digest(F.col("doc_id"), SEED, F.xxhash64("text")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    chosen = labelled.filter(place < share).repartition(FIT_TASKS, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            size = (1 << BITS) + 1
            for a, b, at, features in ngrams(batch.column("text")):
                of = np.repeat(number[a:b], np.diff(at))
                got = np.bincount((of[:, None] * size + features).ravel(), minlength=len(names) * size).reshape(-1, size)
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + got[i, :-1]
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, "<i8") for v in table.column("counts").to_pylist())
        return pa.table([table.column("lang").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    kind = "lang string, counts binary"
    summed = chosen.mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind)
    # One row of 2**BITS numbers per language.
    return Model({row["lang"]: np.frombuffer(bytes(row["counts"]), "<i8") for row in summed.toLocalIterator()})


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            n = len(texts)
            pred, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if m.langs and n:
                margins, used = np.zeros((n, m.code.shape[1])), np.zeros(n, np.int64)
                for a, b, at, features in ngrams(texts):
                    full = np.flatnonzero(np.diff(at))
                    if len(full):
                        margins[a + full] += np.add.reduceat(m.weights[features].sum(1, dtype=np.float32), at[full], axis=0)
                        used[a + full] += np.add.reduceat((features < 1 << BITS).sum(1), at[full])
                margins /= np.maximum(used, 1)[:, None]
                best, top, close = m.decode(margins)
                for i, text in enumerate(texts.to_pylist()):
                    if text and any(map(str.isalpha, text)):
                        pred[i], score[i], unsure[i] = m.langs[best[i]], top[i], close[i]
            yield pa.record_batch([batch.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def op7_language_id(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text", "lang")
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows, model, "doc_id", "held_out")
