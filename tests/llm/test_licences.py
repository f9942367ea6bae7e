"""The licence scan against brute force, and on notices that need the whole job."""

import math
import re
from collections import Counter

import pytest

from graphloom.llm import licenses

SCHEMA = "row long, path string, text string"


def terms(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute_force(texts, templates, units):
    """Best (similarity, licence) of each text at the threshold or more, with true document frequencies."""
    df = Counter(t for text in texts for t in set(terms(text)))
    vector = lambda text: {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in Counter(terms(text)).items()}
    size = lambda v: math.sqrt(sum(w * w for w in v.values()))
    out = []
    for text in texts:
        found = []
        for unit in units(text):
            u = vector(unit)
            for name, body in templates:
                t = vector(body)
                if u and t:
                    found.append((-round(sum(w * t.get(k, 0) for k, w in u.items()) / (size(u) * size(t)), 6), name))
        best = min(found, default=(0, None))
        out.append((best[1], -best[0]) if -best[0] >= licenses.THRESHOLD else (None, None))
    return out


def scanned(spark, texts, *args):
    rows = [(i, f"d/f{i}", t) for i, t in enumerate(texts)]
    return [(r["licence"], r["similarity"]) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), *args).orderBy("row").collect()]


def test_common_words_beside_a_notice(spark):
    """Words of every text weigh little: a notice among them is found at any number of texts."""
    common = "und die der das ist nicht"
    texts = [f"{common} w{i}" for i in range(3000)]
    texts[5] = f"Released under the MIT License. {common}\n{common}"
    texts[6] = f"This work is licensed under the GNU General Public License, version 3. {common}\n{common}"
    texts[7] = "Released under the MIT License. some rare words here make another sentence"
    got = scanned(spark, texts)
    assert got[5][0] == "MIT" and got[6][0] == "GPL-3.0" and got[7][0] is None
    want = brute_force(texts, sorted(licenses.TEMPLATES.items()), lambda t: t.split("\n"))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got if g[0]] == pytest.approx([w[1] for w in want if w[0]], abs=2e-6)


def pieces(text):
    return [*text.split("\n"), *re.split(licenses.BLANK_LINES, text), text]


def test_headers_and_full_texts(spark):
    """Wrapped headers and whole licence texts are found; each equals brute force over lines, blocks and whole texts."""
    prose = [f"tree {i} and the river {i * 7} of a valley\nstone w{i}" for i in range(300)]
    full = dict((n, t) for n, t in licenses.built_in() if t.count("\n") > 15)
    gpl = "\n".join(" * " + line for line in licenses.HEADERS["GPL-3.0"].split("\n"))
    mit = full["MIT"].replace("<year> <copyright holders>", "2024 A Person")
    texts = [*prose, f"/*\n{gpl}\n */\n\nint main() {{ return 0; }}\n", f"{mit}\n", full["Apache-2.0"], full["GPL-3.0"], full["MPL-2.0"], full["BSD-3-Clause"], licenses.HEADERS["MPL-2.0"].replace(" ", "\n# "), licenses.OPENINGS["GPL-3.0"].replace(" You", "\nYou") + "\n \n" + prose[0]]
    got = scanned(spark, texts)
    assert [g[0] for g in got[300:]] == ["GPL-3.0", "MIT", "Apache-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause", "MPL-2.0", "GPL-3.0"]
    want = brute_force(texts, licenses.built_in(), pieces)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got if g[0]] == pytest.approx([w[1] for w in want if w[0]], abs=2e-6)


def test_own_template_of_several_lines(spark):
    texts = ["You may copy this\nfreely and without fee\nfor ever.", "Nothing to see"]
    assert [g[0] for g in scanned(spark, texts, {"own": texts[0]})] == ["own", None]


def test_null_and_repeated_ids(spark):
    """Every row gets its own result, whatever its id."""
    note = "Released under the MIT License."
    rows = [(None, note, "a"), (None, "plain words", "a"), (3, note, "b"), (3, "plain words too", "b"), (3, "Licensed under the Apache License, Version 2.0.", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), str(r["licence"]), r["origin"]) for r in licenses.op2_license_scan(docs).collect())
    assert got == [("3", "Apache-2.0", "own"), ("3", "MIT", "own"), ("3", "None", "none"), ("None", "MIT", "own"), ("None", "None", "none")]


def test_template_of_one_word(spark):
    assert [g[0] for g in scanned(spark, ["The text\nUnlicense", "no such word"], {"Unlicense": "Unlicense"})] == ["Unlicense", None]


def test_near_licences_are_told_apart(spark):
    """Every known text finds itself, also as a comment and with its header cut by blank lines; near ones are the runner-up."""
    known = licenses.built_in()
    prose = [f"tree {i} and the river {i * 7} of a valley\nstone w{i}" for i in range(100)]
    commented = {n: "\n".join("# " + line for line in licenses.HEADERS[n].split("\n")) + "\n\nx = 1\n" for n in licenses.GNU}
    cut = {n: h.replace("\nThis ", "\n\nThis ").replace("\nYou ", "\n\nYou ") + "\n\n" + prose[0] for n, h in licenses.HEADERS.items() if n in licenses.GNU}
    named = [*known, *commented.items(), *cut.items()]
    rows = [(i, f"d/f{i}", t) for i, t in enumerate([*(t for _, t in named), *prose])]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).orderBy("row").collect()
    assert [g["licence"] for g in got[: len(named)]] == [n for n, _ in named]
    assert {g["licence"] for g in got[len(named) :]} == {None}
    agpl, isc = got[len(known) + list(commented).index("AGPL-3.0")], got[[n for n, t in known if t.count("\n") > 10].index("ISC") + len(known) - sum(t.count("\n") > 10 for _, t in known)]
    assert agpl["runner_up"] == "GPL-3.0" and 0 < agpl["margin"] < 0.3
    assert isc["licence"] == "ISC" and isc["runner_up"] == "0BSD" and isc["margin"] > 0
    assert all(g["margin"] is None for g in got if g["runner_up"] is None)


def test_two_licences_in_one_text(spark):
    both = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    got = licenses.scan(spark.createDataFrame([(0, "d/f", both), (1, "d/g", "plain")], SCHEMA)).orderBy("row").collect()
    assert (got[0]["licence"], got[0]["runner_up"], got[0]["margin"]) == ("Apache-2.0", "MIT", 0.0)
    assert got[1]["licence"] is None and got[1]["origin"] == "none" and got[1]["runner_up"] is None
