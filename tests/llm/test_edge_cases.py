"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import exact, fingerprints, hamming, jaccard, language, licenses, lm, middle, mixing, packing, quality, substrings, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30000))
COPY = " ".join(f"same{i}" for i in range(40))
ROWS = [
    (1, COPY, "en", "a", 1),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (4, " \t\n ", "fr", "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, COPY, "en", "a", 1),
    (6, COPY, "en", "a", 1),
    (7, "é", None, "c", 1),
    (8, "!!! 123", "de", "c", 7),
    (9, COPY + " tail. Another sentence here.\nAnd a line", "en", "a", 1),
    (None, "no id here at all but some words", "en", "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    # Columns with the names that the operators use inside.
    return frame.withColumns({c: F.lit("x") for c in ("batch", "size", "row", "tag", "bucket", "copies", "_id", "key", "component", "place")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (8, 0, 1), (9, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is None else (False, r["doc_id"]) for r in rows)


EVERY = {
    "op1": lambda d, l: fingerprints.op1_fingerprints(d),
    "op2": lambda d, l: licenses.op2_license_scan(d),
    "op3": lambda d, l: lm.op3_lm_score(d, l),
    "op4": lambda d, l: substrings.op4_substring_dedup(d),
    "op5": lambda d, l: mixing.op5_mix_sources(d),
    "op7": lambda d, l: language.op7_language_id(d),
    "op8": lambda d, l: quality.op8_quality_classifier(d, l),
    "op9": lambda d, l: jaccard.op9_jaccard_join(d),
    "op11": lambda d, l: middle.op11_fill_in_middle(d),
    "op13": lambda d, l: exact.op13_exact_dedup(d),
}


@pytest.mark.parametrize("name", EVERY)
def test_one_row_per_document(docs, labels, name):
    got = EVERY[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", [*EVERY, "op10", "op12"])
def test_empty_table(docs, labels, name):
    run = {"op10": lambda d, l: packing.op10_pack(d), "op12": lambda d, l: variants.op12_spelling_variants(d), **EVERY}[name]
    assert run(docs.limit(0), labels).count() == 0
    if name in ("op3", "op8"):
        assert run(docs, labels.limit(0)).count() == len(ROWS)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_fingerprints(docs):
    got = by_id(fingerprints.op1_fingerprints(docs))
    assert got[1]["fingerprint"] == got[6]["fingerprint"] != got[9]["fingerprint"]
    assert got[2]["n_chars"] == 0 and got[3]["near_edited"] == 1.0 and got[5]["n_chars"] == len(LONG)
    # The last id's next document is the one without id, whose next is the first.
    assert got[None]["edited_sha256"] and got[2]["near_next"] == 0.0


def test_fingerprints_of_hot_ids(spark):
    """A third of all rows without id and a third with one id are cut in many ranges; each row's next is the one after it."""
    rows = [(None, f"none {i}. tail") for i in range(200)] + [(7, f"seven {i}. tail") for i in range(200)] + [(i, f"own {i}. tail") for i in range(10, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spread = fingerprints.with_next(docs, 12)
    sizes = [r["count"] for r in spread.groupBy("range").count().collect()]
    assert max(sizes) <= 120 and len(sizes) >= 12
    got = fingerprints.fingerprinted(docs, 12).collect()
    assert len(got) == 600
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for i, (doc, text) in enumerate(order):
        half = len(text) // 2
        want.append((str(doc), hashlib.sha256((text[: len(text) - half] + order[(i + 1) % 600][1][:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)


def test_substrings(docs):
    got = by_id(substrings.op4_substring_dedup(docs))
    assert got[1]["n_removed"] == 0 and got[6]["n_removed"] == 40 and got[9]["n_removed"] == 40
    assert got[2]["n_words"] == 0 and got[5]["n_removed"] == 0 and got[None]["n_removed"] == 0
    whole = substrings.without_repeats(docs)
    kept = by_id(whole)
    assert whole.columns == docs.columns and kept[9]["text"] == "tail. Another sentence here. And a line" and kept[4]["text"] == " \t\n " and kept[2]["text"] is None
    with pytest.raises(ValueError):
        substrings.dedup(docs, 5, 13)


def test_substring_needs_a_smaller_document(spark):
    a, b = COPY.split()[:13], COPY.split()[1:14]
    rows = [(2, " ".join(a)), (1, " ".join(b)), (3, " ".join(["x", *a, "y"])), (4, " ".join(a[:12]))]
    got = by_id(substrings.op4_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 0, 13, 0]


def test_jaccard(docs):
    got = by_id(jaccard.op9_jaccard_join(docs))
    assert got[6]["component_id"] == 1 and got[9]["component_id"] == 1 and got[1]["n_shingles"] == 36
    assert got[2]["component_id"] == 2 and got[2]["n_shingles"] == 0 and got[7]["n_shingles"] == 1
    assert got[None]["component_id"] is None and got[None]["n_shingles"] == 4
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, (1, 2, 3, 4, 5, 7, 8, None)))


def test_language(docs):
    got = by_id(language.op7_language_id(docs))
    assert got[2]["lang_pred"] == got[8]["lang_pred"] == "und" and got[8]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    none = language.op7_language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_mixing(docs):
    got = mixing.op5_mix_sources(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.op5_mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = sum(r["copies"] for r in got)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_mixing_is_near_its_targets(spark):
    """Each source's words come near its target, also where a third of the rows have no id."""
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i * i % 97), ("a", "b", "c", None)[i % 4]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mixing.op5_mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert len(per) == 4
    for r in per:
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"] and r["target"] <= 2 * r["size"]


def test_quality_keeps_everything_without_labels(docs, labels):
    assert {r["kept"] for r in quality.classify(docs, labels.limit(0)).collect()} == {True}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_lm_without_words(docs, labels):
    got = by_id(lm.op3_lm_score(docs, labels))
    assert got[2]["n_tokens"] == 0 and got[2]["score"] is None and got[5]["n_tokens"] == 30000


def test_licences(spark):
    note = "Released under the MIT License."
    rows = [(1, "a/b/c.txt", "x"), (2, "a/LICENSE", note), (3, "a/b/d.txt", "text\nLicensed under the Apache License, Version 2.0."), (4, "z/e.txt", None), (5, None, note), (6, "a/b/c/f.txt", ""), (7, "a/notes.txt", note), (8, "LICENSE", note)]
    got = {r["row"]: r for r in licenses.scan(spark.createDataFrame(rows, "row long, path string, text string").withColumn("licence", F.lit("x"))).collect()}
    assert [got[i]["origin"] for i in range(1, 9)] == ["inherited", "own", "own", "none", "own", "inherited", "own", "own"]
    assert got[6]["licence"] == "MIT" and got[6]["licence_path"] == "a/LICENSE" and got[3]["licence"] == "Apache-2.0"


def test_hamming(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 3), (4, -1), (5, None), (None, 0), (1, 0)], "id long, code long")
    got = hamming.top_k(rows, rows.filter("id in (0, 4)"), 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["neighbour_id"], r["distance"]) for r in got] == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (4, 3, 62), (4, 2, 63), (4, 0, 64)]
    assert hamming.top_k(rows.limit(0), rows, 3).count() == 0


def test_quality_noise_without_ids(spark, labels):
    """Documents without id have noise of their own by their texts; repeated labelled ids count once."""
    rows = [(None, f"word{i} same words here") for i in range(50)] + [(9, f"bad words {i}") for i in range(20)] + [(1, "good words")]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    keys = [r["key"] - r["log_ratio"] * quality.LENGTH for r in got if r["doc_id"] is None]
    assert len(got) == 71 and len({round(k, 6) for k in keys}) == 50
    nine = {round(r["key"] - r["log_ratio"] * quality.LENGTH, 6) for r in got if r["doc_id"] == 9}
    assert len(nine) == 1


def test_totals_of_many_ranges(spark, docs, labels, monkeypatch):
    """Totals come through nodes in groups of their own, and scores stay the same."""
    want = sorted(map(str, lm.op3_lm_score(docs, labels).collect()))
    monkeypatch.setattr(lm, "TOTAL_GROUPS", 3)
    monkeypatch.setattr("graphloom.llm.exchange.DIRECT", 2)
    assert sorted(map(str, lm.op3_lm_score(docs, labels).collect())) == want


def _piped(monkeypatch, spark, docs, labels):
    """The output of every stage over ``docs``, each written before the next."""
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, name: labels if name == "labels" else docs)
    out, data = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        data = corpus_pipeline.written(stage(spark, data, ""), f"edge-{name}")
        out[name] = data
    return out


def test_pipeline(monkeypatch, spark, docs, labels):
    """Nulls, empty and long texts, copies, repeated rows and extra columns through all stages."""
    out = _piped(monkeypatch, spark, docs, labels.limit(0))
    for name in ("quality", "near_duplicates", "substrings", "mixture"):
        assert out[name].columns == docs.columns
        assert {r["batch"] for r in out[name].select("batch").distinct().collect()} == {"x"}
    assert out["quality"].count() == len(ROWS)
    single = out["near_duplicates"].collect()
    assert sorted(str(r["doc_id"]) for r in single) == ["1", "2", "3", "4", "5", "7", "8", "None"]  # 6 is a copy of 1, 9 a near copy
    cut = {r["doc_id"]: r["text"] for r in out["substrings"].collect()}
    assert len(cut) == 8 and cut[1] == COPY and cut[2] is None and cut[3] == "" and cut[5] == LONG
    taken = out["mixture"].collect()
    assert {r["doc_id"] for r in taken} <= set(cut) and all(cut[r["doc_id"]] == r["text"] for r in taken)
    pieces = out["packing"].collect()
    assert all(0 < r["length"] <= 2048 for r in pieces)
    assert {str(r["doc_id"]) for r in pieces} == {str(r["doc_id"]) for r in taken}
    for copies, doc in ((sum(t["doc_id"] == d for t in taken), d) for d in {t["doc_id"] for t in taken}):
        mine = [r for r in pieces if r["doc_id"] == doc]
        assert sum(r["length"] for r in mine) == copies * mine[0]["doc_tokens"]


def test_pipeline_with_labels(monkeypatch, spark, docs, labels):
    out = _piped(monkeypatch, spark, docs, labels)
    assert {str(r["doc_id"]) for r in out["quality"].collect()} <= {str(r[0]) for r in ROWS}
    assert out["packing"].count() > 0


def test_pipeline_of_an_empty_table(monkeypatch, spark, docs, labels):
    out = _piped(monkeypatch, spark, docs.limit(0), labels)
    assert [out[name].count() for name, _ in corpus_pipeline.STAGES] == [0] * 5
