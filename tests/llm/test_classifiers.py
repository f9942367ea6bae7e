"""Language identification and the quality classifier against plain Python, row by row."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language, quality
from graphloom.llm.common import WORD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def language_grams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    for at in range(len(raw)):
        for n in (1, 2, 3):
            if at + n <= len(raw):
                code = int.from_bytes(raw[at : at + n], "big")
                yield ((code << 2 | n) * int(language._MULTIPLIER) % 2**64) >> (64 - language.BITS)


def test_language_by_plain_decoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts: dict = {}
    for i, text, lang in rows:
        if lang is not None and not held(i):
            counts.setdefault(lang, Counter()).update(language_grams(text or ""))
    langs = sorted(counts)
    code = language.codewords(len(langs)).tolist()
    shares = [{g: n / c.total() * 1e6 for g, n in c.items()} for c in (counts[x] for x in langs)]
    cells, weights, trust = 1 << language.BITS, [], []
    for b in range(len(code[0])):
        sides = {}
        for sign in (1, -1):
            total = Counter()
            for share, word in zip(shares, code, strict=True):
                if word[b] == sign:
                    total.update(share)
            whole = total.total() + language.SMOOTHING * cells
            sides[sign] = (total, whole)
        one, zero = (lambda g, of=sides[s]: (of[0].get(g, 0) + language.SMOOTHING) / of[1] for s in (1, -1))
        weights.append(lambda g, one=one, zero=zero: math.log(one(g)) - math.log(zero(g)))
        seen = set(sides[1][0]) | set(sides[-1][0])
        rest = cells - len(seen)
        t = sum((one(g) - zero(g)) * weights[-1](g) for g in seen)
        nothing = -1
        trust.append(max(t + rest * (one(nothing) - zero(nothing)) * weights[-1](nothing), 1e-6))
    mean = sum(trust) / len(trust)
    got = {r["doc_id"]: r for r in language.op7_language_id(docs).collect()}
    for i, text, _ in rows[:80]:
        r = got[i]
        assert r["held_out"] == held(i)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        grams = Counter(language_grams(text))
        margins = [sum(n * w(g) for g, n in grams.items()) / grams.total() for w in weights]
        loss = [sum(math.log1p(math.exp(-language.SHARPNESS * m * bit)) * t / mean for m, bit, t in zip(margins, word, trust, strict=True)) for word in code]
        chance = [math.exp(min(loss) - x) for x in loss]
        best = loss.index(min(loss))
        assert r["lang_pred"] == langs[best] and r["score"] == pytest.approx(chance[best] / sum(chance), abs=1e-3)


def cells_of(words):
    """(size, cell) of every word and pair of words, through the operator's own hash of one n-gram at a time."""
    made = {}

    def cell(gram):
        if gram not in made:
            made[gram] = int(quality.features(pa.array([" ".join(gram)]))[len(gram) - 1][1][0])
        return len(gram) - 1, made[gram]

    return [cell((w,)) for w in words], [cell(p) for p in zip(words, words[1:], strict=False)]


def test_quality_by_plain_importance_resampling(spark):
    """Log ratios, threshold, Gumbel keys and the kept documents of plain Python; null texts weigh 0, ties at the k-th key all stay."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.union(spark.createDataFrame([(100001, None, "en", "s", 0), (100002, "", "en", "s", 0)], docs.schema)).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    marks = {r["_id"]: r for r in labels.filter("quality is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good")).collect()}
    place = lambda i, seed: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
    fits = {i: place(i, quality.SEED + "-fold") % 2 == 0 for i in marks}
    grams = {}
    target, raw = Counter(), Counter()
    for i, text in rows:
        one, two = cells_of(re.findall(WORD, text or ""))
        grams[i] = (one, two)
        raw.update(one + two)
        if i in marks and marks[i]["good"] and fits[i]:
            target.update(one + two)
    share = [sum(n for (k, _), n in target.items() if k == s) / max(1, sum(n for (k, _), n in raw.items() if k == s)) for s in (0, 1)]
    ratio = lambda c: math.log((target[c] + quality.SMOOTHING) / (raw[c] * share[c[0]] + quality.SMOOTHING))
    mean = {i: sum(map(ratio, one + two)) / max(1, len(one)) for i, (one, two) in grams.items()}
    judged = [(mean[i], marks[i]["good"]) for i in mean if i in marks and not fits[i]]
    cuts = sorted(m for m, _ in judged)
    cuts = [-math.inf] + [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False) if a != b] + [math.inf]
    cost = lambda c: sum(quality.GOOD_COST if g else 0 for m, g in judged if m < c) + sum(0 if g else 1 for m, g in judged if m >= c)
    least = min(cuts, key=cost)
    keys = {i: quality.LENGTH * m - math.log(-math.log((place(i, quality.SEED) + 0.5) / 2**32)) for i, m in mean.items()}
    k = sum(m >= least for m in mean.values())
    edge = sorted(keys.values(), reverse=True)[k - 1] if math.isfinite(least) and 0 < k < len(keys) else -math.inf
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert got.keys() == mean.keys() and got[100001]["log_ratio"] == got[100002]["log_ratio"] == 0
    for i, r in got.items():
        assert r["log_ratio"] == pytest.approx(mean[i], abs=1e-4) and r["key"] == pytest.approx(keys[i], abs=0.05)
        if abs(keys[i] - edge) > 0.1:
            assert r["kept"] == (keys[i] >= edge)
    tied = spark.createDataFrame([(v,) for v in (3.0, 2.0, 2.0, 2.0, 1.0)], "v double")
    assert quality.kth_largest(tied, "v", 3) == 2.0 and tied.filter(F.col("v") >= 2.0).count() == 4


def test_long_texts_come_in_runs(monkeypatch):
    """The n-grams of a text are the same however it is cut, and no run is longer than the bound."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["ab", None, "é" * 700 + " Fin", "", "xyz", "q" * 2048, "tail"], pa.string())

    def grams(size):
        monkeypatch.setattr(language, "RUN_BYTES", size)
        got = {}
        for a, b, at, features in language.ngrams(texts):
            assert len(features) <= max(size, 0) or b - a > 1
            for i in range(a, b):
                got.setdefault(i, []).extend(features[at[i - a] : at[i - a + 1]].tolist())
        return got

    whole = grams(1 << 18)
    assert [len(x) for x in whole.values()] == [2, 0, 1404, 0, 3, 2048, 4]
    for size in (64, 100, 1403):
        cut = grams(size)
        assert {i: cut.get(i, []) for i in whole} == whole
