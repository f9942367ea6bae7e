"""Operators 11 to 13 against plain Python: unit grammars, near words, exact copies."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact, golomb, middle, variants

ODD = [None, "", "\n", "a", "\n\n", "a\n\nb\n", "one two  three\r\nfour", "x😀y 1😀\n😀", "é.È! B?", "- a\n* b # c", "<P>", "a<S>b\nc", "<M", "12ab  34", "\t x \x0b", "a\x85b c", "l\n" * 5000]


def test_units_are_what_the_grammar_matches(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for name, kind in middle.UNITS.items():
        got = {r["doc_id"]: r["u"] for r in frame.select("doc_id", middle.units(F.col("text"), kind).alias("u")).collect()}
        for i, text in enumerate(ODD):
            assert got[i] == re.findall(kind.grammar, text or ""), (name, text)


@pytest.mark.parametrize("kind", ["line", "token", "character"])
def test_middles(spark, kind):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD * 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("units", F.lit("x"))
    got = middle.fill_in_middle(frame, kind, cut=80)
    forms = set()
    for r in got.withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect():
        units = re.findall(middle.UNITS[kind].grammar, r["text"])
        digest = hashlib.sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        plain = not r["text"] or any(m in r["text"] for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 80
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
        expect = {"plain": r["text"], "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["form"], r["n"], r["output"], r["again"]) == (form, len(units), expect, r["text"])
        assert (r["prefix"], r["middle"]) == ((None, None) if plain else (p, m))
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_middles_are_one_projection(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plan = middle.op11_fill_in_middle(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def plain_words(rows, damaged, least_letters, least_n):
    count = {}
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                count[run] = count.get(run, 0) + 1
    return {w: n for w, n in count.items() if n >= least_n}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, damaged=97, least_letters=5, least_n=3):
    words = plain_words(rows, damaged, least_letters, least_n)
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


def got_variants(frame, **settings):
    return {tuple(r) for r in variants.variants(frame, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("letters,length,least", [("ab", (1, 9), 1), ("abçÿ", (4, 14), 5), ("acgt", (5, 7), 5)])
def test_near_words(spark, letters, length, least):
    rng = random.Random(length[1])
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(60)]
    words = [w for s in stems for w in (s, s[:-1], s + rng.choice(letters), s[:2] + rng.choice(letters) + s[3:])]
    rows = [(i, " ".join(rng.choice(words) * (1 if rng.random() < 0.9 else 2) for _ in range(60))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("zzzzz"))
    assert got_variants(frame, least_letters=least, damaged=11) == plain_variants(rows, 11, least)


def test_chains_end_at_the_most_frequent_word(spark):
    chain = ["abcde", "abcdf", "abcgf", "abhgf", "aihgf", "jihgf", "jihgk", "jihlk", "jimlk"]
    rows = [(2**40 + i, f"{w} ") for i, w in enumerate(w for k, w in enumerate(chain) for _ in range(3 * 2**k))]
    got = {r[0]: r[2] for r in got_variants(spark.createDataFrame(rows, "doc_id long, text string"), damaged=1 << 40)}
    assert got == {w: "jimlk" for w in chain}


def test_words_of_any_length_and_odd_rows(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(5000))
    rows = [(1, f"{long} Ünder ÜNDER"), (1, f"{long} Ünder ÜNDER"), (2, long[:3000] + long[3001:] + " ünder"), (3, long + "; Ünder"), (None, f"{long[:-1]} {long[:-1]} {long[:-1]}"), (None, None), (4, ""), (5, "1234567 ßßßßß ßßßßß ßßßßß×÷")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_variants(frame) == plain_variants(rows)
    assert got_variants(frame.limit(0)) == set()


def test_anagrams_do_not_meet_across_pieces(spark):
    """Words of two letters: few keys, but groups are bounded by the arrangements of a piece."""
    words = [f"{i:018b}".replace("0", "a").replace("1", "b") for i in range(0, 2**18, 37)]
    under = variants.entries(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    by_key = under.groupBy("key").count().agg(F.max("count")).first()[0]
    by_both = under.groupBy("key", "rest").count().agg(F.max("count")).first()[0]
    assert by_key > 2000 and by_both <= 2**7


def test_codes(subtests=None):
    rng = np.random.default_rng(1)
    for width, n in [(1, 1), (2, 2), (1000, 0), (1000, 1), (1000, 1000), (1 << 40, 5000), (1 << 59, 3)]:
        values = np.unique(rng.integers(0, width, n)) if n != width else np.arange(width)
        blob = golomb.encode(values, width)
        assert golomb.decode(blob, width).tolist() == values.tolist()
        if n == 5000:
            assert len(blob) < n * (np.log2(width / n) + 2) / 8 + 32


def plain_copies(rows):
    lowered = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, open_place = (max(known) if known else None), True
        for i in ids:
            out.append((i, keep, len(ids), open_place and i == keep, hashlib.sha256(text.encode()).hexdigest()))
            open_place = open_place and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("false_bits", [exact.FALSE_BITS, -8])
def test_copies(spark, false_bits):
    """With 8 bits too few nearly all rows are suspects, and bytes tell them apart."""
    rng = random.Random(5)
    texts = ["", "Same", "same", "SAME", "ÀB", "àb", "Àb", "long " * 20000] + [f"t{i}" for i in range(300)]
    rows = [(rng.choice([None, rng.randint(1, 200)]), rng.choice([*texts, None, "same", "same"])) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(13).withColumn("batch", F.lit("x"))
    got = exact.decisions(frame, false_bits=false_bits).withColumn("sha", F.lower(F.hex("sha")))
    assert sorted(map(tuple, got.collect()), key=str) == plain_copies(rows)


def test_without_copies_keeps_columns_and_originals(spark):
    frame = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "y"), (2, "a B", "y"), (3, None, "z"), (None, "Q", None)], "doc_id long, text string, sha string").withColumn("batch", F.lit(7))
    got = exact.without_copies(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "a B", "y", 7), (3, None, "z", 7), (None, "Q", None, 7)]


def test_marks_move_no_texts(spark, tmp_path):
    """The table is bucketed by what batches are grouped by: only messages and bitmaps are shuffled."""
    docs = spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], "doc_id long, text string").repartition(3)
    stored = exact._stored(docs, ())
    plan = exact.marks(stored.select("batch", "pos", "front"), 12, 4)._jdf.queryExecution().sparkPlan().toString()
    assert "text" not in plan
    executed = exact.marks(stored.select("batch", "pos", "front"), 12, 4)
    executed.collect()
    text = executed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning(owner") == 1 and text.count("Exchange hashpartitioning(batch") == 1
