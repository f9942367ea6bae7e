"""Operators without SQL against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from graphloom.llm import fingerprints, jaccard, language, packing, quality, queries
from graphloom.llm.tokens import words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def shown(v):
    if v is None or pd.isna(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(shown(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


def test_words_split_as_the_pattern_does():
    import pyarrow as pa

    odd = ["a b", "", None, "  x y\x0bz ", "é\x1cü\x85w", "a" * 3000000, "\n"]
    w = words(pa.array(odd, pa.string()))
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in odd]
    assert words(pa.array(["x y", "y x y"])).hash.tolist()[1] == words(pa.array(["y"])).hash[0]


def test_fingerprints(docs, texts):
    def pieces(x):
        out = set()
        for p in re.split(r"(?<=[.!?])[\x20\x09\x0B-\x0D]+|\n+", x):
            if p.strip(" "):
                out |= {q.strip(" ") for q in re.findall(r"(?:\S+\s*){1,32}", p, re.A)} if len(p) > fingerprints.LONG else {p.strip(" ")}
        return out

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in fingerprints.op1_fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, doc in enumerate(order):
        text, following = texts[doc], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(pieces(text), pieces(edited)))
        assert r["near_next"] == pytest.approx(like(pieces(text), pieces(following)))


def test_sketches_peel_exactly(spark):
    """Round trip of sketches of every size, and growth on failure."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    cases = []
    for n, m, both in ((0, 0, 0), (1, 0, 5), (3, 3, 100), (40, 0, 0), (300, 200, 50), (5000, 5000, 10)):
        a, b, c = (rng.integers(-(2**63), 2**63, k).tolist() for k in (n, m, both))
        cases.append((n, m, a + c, b + c))
    df = spark.createDataFrame(cases, "n int, m int, a array<long>, b array<long>")
    df = df.withColumns({"pa": fingerprints.sketch(F.col("a"), fingerprints.FINGERPRINT, fingerprints.FINGERPRINT_LOW), "pb": fingerprints.sketch(F.col("b"), fingerprints.FINGERPRINT, fingerprints.FINGERPRINT_LOW)})
    for r in df.select("n", "m", "a", "b", fingerprints.differences(F.col("a"), F.col("b"), F.col("pa"), F.col("pb")).alias("d")).collect():
        assert (len(r["d"]["first"]), len(r["d"]["second"])) == (r["n"], r["m"])
        assert set(r["d"]["first"]) == set(r["a"]) - set(r["b"]) and set(r["d"]["second"]) == set(r["b"]) - set(r["a"])


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        near = collections.Counter(j for x in s for j in where[x])
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return {i: root(i) for i in sets}


def link_counts(sets):
    near = lambda s, t: 100 * len(s & t) >= 75 * len(s | t)
    return {i: sum(near(s, t) for j, t in sets.items() if i != j and t) if s else 0 for i, s in sets.items()}


def test_jaccard(docs, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want, links = components(sets), link_counts(sets)
    for r in jaccard.op9_jaccard_join(docs).collect():
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], links[r["doc_id"]])
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == want


def test_jaccard_on_mutated_copies(spark, monkeypatch):
    """A group of copies at similarities around the threshold, verified in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    made = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 8), replace=False):
            w[at] = f"m{i}_{at}"
        made.append((i, " ".join(w)))
    made += [(200 + i, " ".join([*base[:60], *[f"o{i}_{k}" for k in range(90)]])) for i in range(40)]
    made += [(300 + i, " ".join(f"s{i % 7}w{k}" for k in range(1 + i % 9))) for i in range(60)]
    made += [(400, made[0][1]), (401, made[0][1])]
    sets = {i: shingles(t) for i, t in made}
    want = components(sets)
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = jaccard.op9_jaccard_join(frame).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_links"] for r in got} == link_counts(sets)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame).collect()} == want


def test_pigeonhole_allocation():
    """Linked sets always meet in a unit that the larger one probes, whatever the costs."""
    rng = np.random.default_rng(11)

    def holding(values):
        s = object.__new__(jaccard.Sets)
        s.of = np.concatenate([np.sort(v) for v in values])
        s.sizes = np.array([len(v) for v in values])
        s.first = np.concatenate([[0], np.cumsum(s.sizes)])
        return s

    for _ in range(300):
        n = int(rng.integers(4, 120))
        r = rng.integers(0, 2**64, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 4 + 1))
        s = r[: n - gone] if rng.random() < 0.5 else np.concatenate([r[: n - gone // 2], rng.integers(0, 2**64, gone // 3, dtype=np.uint64)])
        both = len(np.intersect1d(r, s))
        if 100 * both < 75 * (len(r) + len(s) - both) or len(r) == len(s) == both:
            continue
        if len(s) > len(r):
            r, s = s, r
        sets = holding([r, s])
        sig = jaccard.Signatures(sets, np.ones(2, bool))
        probes = sig.allocate(rng.integers(0, 1000, len(sig.sig)), sets)
        asked = set(sig.sig[probes & (sig.doc == 0)].tolist())
        indexed = set(sig.sig[(sig.doc == 1) & (sig.kind != 1)].tolist())
        assert asked & indexed, (len(r), len(s), both)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    pieces = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in packing.op10_pack(docs).collect():
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x)
            at += r["length"]
            assert zlib.crc32(x[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(x)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0 or at == 2048


def test_packing_keeps_proportions():
    shares = [(s, (s, k), 0, n) for s, n, count in ((0, 700, 60), (1, 90, 200), (2, 5, 500)) for k in range(count)]
    out = packing.serve(shares)
    total = sum(n for *_, n in shares)
    share = {s: sum(x[3] for x in shares if x[0] == s) / total for s in (0, 1, 2)}
    given = collections.Counter()
    filled = collections.Counter()
    for (s, _), _, n, sequence, _ in out:
        given[s, sequence] += n
        filled[sequence] += n
    for (s, sequence), n in given.items():
        if filled[sequence] == 2048:
            assert abs(n / 2048 - share[s]) < 2 * packing.QUANTUM / 2048


def test_word_encoder():
    e = packing.WordEncoder(packing.vocabulary_path())
    for x in ["don't can't I'LL <|endoftext|> x", "Ünïcödé İstanbul ŉa Σας ΟΔΟΣ étude café", "a b c d　e", "123abc 4,5.6 _x_ __ 'tis ''", "日本語 🙂🙂 a🙂b", "Å Ω ` ;", "Straße. ǅ (ok)!?", "a\x85b\x1cc"]:
        assert e.encode(x) == np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_batches():
    import pyarrow as pa

    e = packing.WordEncoder(packing.vocabulary_path())
    texts = [None, "", " ", " a  b ", "x <|endoftext|> y", "é ü z\x1c q\tw\x0bz\x0cu\r\n", "can't <|startoftext|>", "ÀÉ... it's 'a 12 a1b !?a ĳ İ ß Ÿ ſ 你好 **x** --- a-b ŉ K", "long " * 3000]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    for size in (1, 8, 1 << 20):
        parts = list(packing.sliced(batch, "text", size))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
        for part in parts:
            ids, counts = e.encode_all(part.column("text"), 1)
            for text, got, n in zip(part.column("text").to_pylist(), ids.to_pylist(), counts.tolist(), strict=True):
                want = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
                assert (np.frombuffer(got, e.stored).tolist(), n) == (want, len(want))
    empty = e.encode_all(pa.array([], pa.string()), 1)
    assert (len(empty[0]), len(empty[1])) == (0, 0)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.QUERIES["op7_language_id"](spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)


def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
    assert min((language.codewords(4)[i] != language.codewords(4)[j]).sum() for i in range(4) for j in range(i)) == 4


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["kept"]) for r in queries.QUERIES["op8_quality_classifier"](spark, sf).collect() if r["doc_id"] in labels]
    assert np.mean([k for q, k in got if q == 1]) >= 0.99 and np.mean([k for q, k in got if q == 0]) <= 0.1


def test_kth_largest(spark):
    values = [5.0, 1.0, 1.0, -3.5, 5.0, 2.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 7)] == sorted(values, reverse=True)[:6]


def test_pipeline_stages(spark, docs, texts):
    """Each stage on its own input: clean documents stay, copies and repeats go, nothing is lost on the way."""
    cols = docs.columns
    data = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, data, SF), f"test-{name}")
        before = {r["doc_id"]: r["text"] for r in data.select("doc_id", "text").collect()}
        if name != "packing":
            assert out.columns == cols
            after = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            kept = {i for i, _ in after}
            assert len(bad & kept) <= 0.2 * len(bad) and len(kept) >= 0.8 * len(before)
        elif name == "near_duplicates":
            want = components({i: shingles(t) for i, t in before.items()})
            assert sorted(i for i, _ in after) == sorted(i for i in want if want[i] == i)
        elif name == "substrings":
            seen: dict = {}
            for i in sorted(before):
                w = WORD.findall(before[i])
                gone = set()
                for k in range(len(w) - 12):
                    if tuple(w[k : k + 13]) in seen and seen[tuple(w[k : k + 13])] < i:
                        gone.update(range(k, k + 13))
                for k in range(len(w) - 12):
                    seen.setdefault(tuple(w[k : k + 13]), i)
                assert dict(after)[i] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else before[i])
        elif name == "mixture":
            assert all(before[i] == t for i, t in after) and max(collections.Counter(i for i, _ in after).values()) <= 2
        else:
            assert out.select("doc_id").distinct().count() == len(before)
        data = out
    assert corpus_pipeline.ORACLE_SQL is None
