"""Operator 3: language-model scoring by cross-entropy difference.

Two matched bigram models, of a target (documents marked as such) and of the background (all
documents), are smoothed in the same way over one vocabulary, the distinct words of the
background:

    p1(w)     = (c(w) + A) / (N + A * V)
    p(w | v)  = (c(v w) + MU * p1(w)) / (c(v) + MU)

A document's loss under a model is the mean of -ln p over its words (the first one by p1); its
score is target loss minus background loss, so lower is closer to the target.  Counts are over
all documents and are not held out: a document counts in the models that score it.

Counts are gathered exactly, by the two-way exchange: a batch sends each distinct word and
bigram once with its counts, a hash range adds them up over all batches and answers with the
sums, and its share of N and V is added up.

Null or empty text: 0 words, losses and score null.  Null doc_id is never marked.  No marked
document: the target model is the uniform one.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm.common import written
from graphloom.llm.substrings import text_of
from graphloom.llm.tokens import U64, windows, words

ADDED = 0.1
MU = 10.0
WORDS, PAIRS, MARKS, TOTALS = 1, 2, 3, 4
#: Negative batches that the ranges' totals are spread over.
TOTAL_GROUPS = 1024
#: Low bits of bigram hashes that are not sent: 48 bits tell bigrams apart.
PAIR_BITS_DROPPED = 16
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


class Grams:
    """Words and bigrams of a batch, sorted by hash, with counts in all and in marked documents."""

    def __init__(self, table: pa.Table, marked: np.ndarray):
        self.words = words(text_of(table))
        pair, valid = windows(self.words, 2)
        self.pair_at = np.flatnonzero(valid)
        in_target = marked[self.words.doc]
        mask = ~U64((1 << PAIR_BITS_DROPPED) - 1)
        self.sets = {}
        for tag, keys, target in ((WORDS, self.words.hash, in_target), (PAIRS, pair[self.pair_at] & mask, in_target[self.pair_at])):
            order, starts, run = X.runs(keys)
            counts = np.diff(np.append(starts, len(keys)))
            hits = np.add.reduceat(target[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
            self.sets[tag] = (order, run, keys[order[starts]] if len(starts) else keys, counts, hits)

    def messages(self, batch: int, buckets: int):
        for tag, drop in ((WORDS, 0), (PAIRS, PAIR_BITS_DROPPED)):
            _, _, keys, counts, hits = self.sets[tag]
            yield from X.questions(batch, tag, buckets, keys, counts, hits, drop_bits=drop)

    def spread(self, tag: int, values: np.ndarray) -> np.ndarray:
        """Values of the distinct keys at the positions of their occurrences."""
        order, run, *_ = self.sets[tag]
        out = np.zeros(len(order))
        if len(order):
            out[order] = values[run]
        return out


def _add_up(table: pa.Table) -> pa.Table:
    """Sums of counts over all batches, and to a negative batch the range's words in all, in marked documents and its distinct ones."""
    bucket = table.column("bucket")[0].as_py()
    out = []
    for tag in (WORDS, PAIRS):
        keys, spans, rest = X.merged(table, tag)
        if not spans:
            continue
        sums = [np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)]
        totals = np.zeros(3, ">i8")
        order, starts, run = X.runs(keys)
        for i, c in enumerate(rest):
            per = np.add.reduceat(c.astype(np.int64)[order], starts)
            sums[i][order] = per[run]
            totals[i] = per.sum()
        totals[2] = len(starts)
        out += [(b, tag, bucket, X.pack(sums[0][a:z], sums[1][a:z])) for b, a, z in spans]
        if tag == WORDS:
            out.append((-1 - bucket % TOTAL_GROUPS, TOTALS, bucket, totals.tobytes()))
    return X.rows(out)


def totals_of(sums: DataFrame) -> list[float]:
    """Words in all, in marked documents, and distinct ones, over all ranges."""
    number = lambda i: F.conv(F.hex(F.substring("blob", 8 * i + 1, 8)), 16, 10).cast("long")
    one = sums.filter(F.col("tag") == TOTALS).agg(*[F.coalesce(F.sum(number(i)), F.lit(0)) for i in range(3)]).first()
    return [float(x) for x in one]


def losses(grams: Grams, got: dict, buckets: int, totals: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Per word -ln p of the target (0) and background (1) model."""
    first = np.zeros(len(grams.words.hash), bool)
    first[grams.words.first[:-1][np.diff(grams.words.first) > 0]] = True
    out = []
    answers = {tag: X.answers(got, tag, grams.sets[tag][2], buckets) for tag in (WORDS, PAIRS)}
    for model, n in ((1, totals[1]), (0, totals[0])):
        if not len(first):
            out.append(np.zeros(0))
            continue
        c = grams.spread(WORDS, answers[WORDS][model].astype(float))
        p1 = (c + ADDED) / (n + ADDED * totals[2])
        p = p1.copy()
        if answers[PAIRS]:
            at = grams.pair_at
            p[at + 1] = (grams.spread(PAIRS, answers[PAIRS][model].astype(float)) + MU * p1[at + 1]) / (c[at] + MU)
        out.append(-np.log(p))
    return out[0], out[1]


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row of ``docs``.

    ``target_ids``: a column doc_id with the ids of the target documents."""
    plan = X.plan(docs)
    batches, buckets = plan.batches, plan.gates
    held = X.in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, "doc_id", "text")
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    key = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    marks = ids.select(key.alias("batch"), F.lit(MARKS).alias("tag"), F.lit(0).alias("bucket"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("blob"))

    def grams(table: pa.Table, extra: pa.Table) -> Grams:
        blobs = b"".join(v for t, v in zip(extra.column("tag").to_pylist(), extra.column("blob").to_pylist(), strict=True) if t == MARKS)
        doc_ids = table.column("doc_id").combine_chunks()
        marked = np.isin(doc_ids.fill_null(0).to_numpy(), np.frombuffer(blobs, ">i8").astype(np.int64)) & doc_ids.is_valid().to_numpy(zero_copy_only=False)
        return Grams(table, marked)

    def count(table: pa.Table, extra: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.rows([])
        return X.rows(grams(table, extra).messages(table.column("batch")[0].as_py(), buckets))

    def apply(table: pa.Table, extra: pa.Table) -> pa.Table:
        g = grams(table, extra)
        n = np.diff(g.words.first)
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in losses(g, X.by_batch(extra), buckets, totals)]
        with np.errstate(invalid="ignore"):
            target, background = ((s[g.words.first[1:]] - s[g.words.first[:-1]]) / n for s in sums)
        empty = n == 0
        return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(np.where(empty, 0.0, x), pa.float64(), mask=empty) for x in (target, background, target - background)]], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    counts = held.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(count, X.MESSAGE)
    sums = written(plan.ask(counts, _add_up, {PAIRS: PAIR_BITS_DROPPED}), "lm-sums")
    totals = totals_of(sums)
    told = sums.filter("batch >= 0").unionByName(marks)
    return held.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(apply, SCORED)


def op3_lm_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents labelled of good quality and not toxic."""
    scored = score(docs, labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


ORACLE = r"""
WITH ws AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
marked AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
tok AS (
  SELECT doc_id, m, unnest(w) AS word, unnest(list_prepend(NULL, w[:-2])) AS prev
  FROM (SELECT ws.doc_id, w, k.doc_id IS NOT NULL AS m FROM ws LEFT JOIN marked k ON ws.doc_id = k.doc_id)),
uni AS (SELECT word, count(*)::DOUBLE AS b, (count(*) FILTER (m))::DOUBLE AS t FROM tok GROUP BY word),
bi AS (SELECT prev, word, count(*)::DOUBLE AS b, (count(*) FILTER (m))::DOUBLE AS t FROM tok WHERE prev IS NOT NULL GROUP BY prev, word),
tot AS (SELECT sum(b) AS nb, sum(t) AS nt, count(*)::DOUBLE AS v FROM uni),
one AS (SELECT word, b, t, (b + 0.1) / (nb + 0.1 * v) AS pb, (t + 0.1) / (nt + 0.1 * v) AS pt FROM uni, tot),
pair AS (
  SELECT bi.prev, bi.word, (bi.b + 10.0 * o.pb) / (p.b + 10.0) AS qb, (bi.t + 10.0 * o.pt) / (p.t + 10.0) AS qt
  FROM bi JOIN one o ON bi.word = o.word JOIN one p ON bi.prev = p.word),
scored AS (
  SELECT k.doc_id, -ln(coalesce(q.qt, o.pt)) AS lt, -ln(coalesce(q.qb, o.pb)) AS lb
  FROM tok k JOIN one o ON k.word = o.word LEFT JOIN pair q ON k.prev = q.prev AND k.word = q.word),
per AS (SELECT doc_id, count(*) AS n, avg(lt) AS lt, avg(lb) AS lb FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS score
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id
"""
