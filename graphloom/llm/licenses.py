"""Operator 2: licence scan by sparse TF-IDF cosine and directory inheritance, in DataFrame operations only.

A licence file is one whose name starts with LICENSE, LICENCE, COPYING or NOTICE.  Every line of a
text, every block between blank lines (a header is one) and every whole text are compared with
the templates, which are one-line notices, headers and full licence texts: terms are runs of ASCII letters and digits in lower case, a term's weight is its count times
ln((1 + N) / (1 + df)) + 1 with df over all N texts, also for terms that no template has, and the
similarity is the cosine.  A text's own licence is its most similar template at ``THRESHOLD`` or
more (of equals the first by name).  The licence of the next most similar template of another
name, if that reaches the threshold too, is its ``runner_up``, and ``margin`` is how much less
similar it is: near licences (AGPL and GPL, ISC and MIT) are told apart by the best template, and a
small margin says that this was close or that a text holds two licences.

Known are the names in ``TEMPLATES``, ``HEADERS``, ``TITLES`` and the files of ``FULL_TEXTS``; a licence
that is none of them gets the name of the one that it resembles, or none.

Only pieces that hold a key term are counted: without those, what is left of any template is too
short to reach the threshold.  A piece whose template terms are too few beside its other words is
then left out by an exact bound, and the other terms of what remains are counted over all texts.

A file without a licence of its own takes that of the nearest ancestor directory, its own
directory first, that directly holds a licence file with one; of several the most similar, then
the first path.  Directories are resolved once each and files join their directory.

Null or empty text: no licence of its own.  Null path: in no directory, and nothing inherits
from it.  Every row gets its own result, also where its id is null or repeated.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, written

#: Fixed notices, by licence name.
TEMPLATES = {
    "0BSD": "Released under the BSD Zero Clause License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Titles of licence files, by licence name.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "Creative Commons Legal Code CC0 1.0 Universal",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
}
#: The header of the GNU licences: what it covers, the licence's kind, its version and where to find it.
GNU_HEADER = """This {covered} is free software: you can redistribute it and/or modify it under the terms of the GNU
{kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version.
This {covered} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.
You should have received a copy of the GNU {kind} Public License along with this {covered}. If not, {found}."""
_SEE = "see\n<https://www.gnu.org/licenses/>"
_WRITE = "write to the Free\nSoftware Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
GNU = {
    "AGPL-3.0": {"covered": "program", "kind": "Affero General", "version": "3", "found": _SEE},
    "GPL-2.0": {"covered": "program", "kind": "General", "version": "2", "found": _WRITE},
    "GPL-3.0": {"covered": "program", "kind": "General", "version": "3", "found": _SEE},
    "LGPL-2.1": {"covered": "library", "kind": "Lesser General", "version": "2.1", "found": _WRITE},
    "LGPL-3.0": {"covered": "library", "kind": "Lesser General", "version": "3", "found": _SEE},
}
#: Headers as they stand on top of source files, by licence name.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty.
You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
<https://creativecommons.org/publicdomain/zero/1.0/>.""",
    **{name: GNU_HEADER.format(**words) for name, words in GNU.items()},
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Parts that name a licence where blank lines cut a header.
OPENINGS = {
    "Apache-2.0": " ".join(HEADERS["Apache-2.0"].split("\n")[:2]),
    **{name: " ".join(HEADERS[name].split("\n")[:3]) for name in GNU},
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:""",
}
#: Files with the full texts of licences, by licence name.
FULL_TEXTS = Path(__file__).parent / "licence_texts"
THRESHOLD = 0.7
#: Room for rounding in bounds.
SLACK = 1e-5
#: Terms that are broadcast at most.
BROADCAST_TERMS = 200_000
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)"
BLANK_LINES = r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)*\n"
_NOT_TERM = "[^a-z0-9]+"


def _terms(text: str) -> list[str]:
    return [t for t in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split(" ") if t]


def split_terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _NOT_TERM), "")


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the templates, to be broadcast."""
    return F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("v")).select("v.*"))


def document_frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df): the number of texts that hold each of the wanted (distinct) terms that any does.

    Up to BROADCAST_TERMS wanted terms are sent to the texts; more are joined after terms are
    counted, which shuffles a row for each term of a partition and not for each of a text."""
    found = texts.filter("text is not null").select(F.explode(F.array_distinct(split_terms(F.col("text")))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        return found.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return found.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")


def key_terms(vectors: list[dict[str, float]], df: dict[str, int], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with any of the vectors.

    The cosine is at most the length of a vector's part of terms that the text holds, over its
    whole length; without the key terms what is left of any vector is too short.  Terms that weigh
    much and that few texts hold are taken first."""
    keys: set[str] = set()
    for vector in vectors:
        rest = sum(w * w for w in vector.values())
        least = (max(threshold, 0.0) - SLACK) ** 2 * rest * (1 - SLACK)
        for term in sorted(vector, key=lambda t: ((1 + df.get(t, 0)) / vector[t] ** 2, t)):
            if rest < least:
                break
            keys.add(term)
            rest -= vector[term] ** 2
    return sorted(keys)


class Templates:
    """The templates as vectors over the corpus, and the terms of which every similar text holds one."""

    def __init__(self, texts: DataFrame, templates: list[tuple[str, str]], threshold: float):
        spark = texts.sparkSession
        counted = [(name, Counter(_terms(text))) for name, text in sorted(templates)]
        counted = [(name, terms) for name, terms in counted if terms]
        self.n = texts.count()
        vocabulary = sorted({t for _, terms in counted for t in terms})
        wanted = _literal(spark, [{"term": t} for t in vocabulary], "term string")
        df = {r["term"]: r["df"] for r in document_frequencies(texts, wanted).collect()}  # a row per template term at most
        idf = {t: math.log((1 + self.n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
        self.weights = _literal(spark, [{"term": t, "idf": w} for t, w in idf.items()], "term string, idf double")
        self.vectors, parts = [], []
        for name, terms in counted:
            vector = {t: k * idf[t] for t, k in sorted(terms.items())}
            size = math.sqrt(sum(w * w for w in vector.values()))
            parts += [{"term": t, "template": len(self.vectors), "licence": name, "part": w / size} for t, w in vector.items()]
            self.vectors.append(vector)
        self.parts = _literal(spark, parts, "term string, template int, licence string, part double")
        self.keys = F.array(*[F.lit(t) for t in key_terms(self.vectors, df, threshold)]).cast("array<string>")

    def may_match(self, text: Column) -> Column:
        return F.arrays_overlap(split_terms(text), self.keys)


def built_in() -> list[tuple[str, str]]:
    """Notices, titles, headers and full texts with their licences' names."""
    full = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(FULL_TEXTS.glob("*.txt"))]
    return [*TEMPLATES.items(), *TITLES.items(), *HEADERS.items(), *OPENINGS.items(), *full]


def units(text: Column) -> Column:
    """What is compared with the templates: the lines of a text, its blocks between blank lines, and the whole."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLANK_LINES), F.array(text)))


def own_licences(kept: DataFrame, texts: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """(key, licence, similarity, runner_up, margin) of the files that have a licence of their own.

    ``kept``: key (unique), text of the files that may have one; ``texts``: the text of all."""
    pieces = kept.filter("text is not null").select("key", F.posexplode(units(F.col("text"))).alias("unit", "words"))
    words = pieces.filter(templates.may_match(F.col("words"))).select("key", "unit", F.explode(split_terms(F.col("words"))).alias("term"))
    known = words.join(templates.weights, "term", "left").select("key", "unit", F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), "idf")
    # A row per template term, and one for all other terms of a piece.
    counts = written(known.groupBy("key", "unit", "term", "idf").agg(F.count("*").alias("n")), "licence-terms")
    dots = counts.join(templates.parts, "term").groupBy("key", "unit", "template", "licence").agg(F.sum(F.col("n") * F.col("idf") * F.col("part")).alias("dot"))
    # No weight is below 1 and squares of counts are no less than counts, so a piece is at least this long.
    least = counts.groupBy("key", "unit").agg(F.sqrt(F.sum(F.coalesce((F.col("n") * F.col("idf")) ** 2, F.col("n").cast("double")))).alias("least"))
    possible = written(dots.join(least, ["key", "unit"]).filter(F.col("dot") >= (threshold - SLACK) * F.col("least")).select("key", "unit", "licence", "dot"), "licence-candidates")
    dropped(counts)
    # The other terms of the pieces that are left, with their true frequencies.
    left = possible.select("key", "unit").distinct()
    again = kept.join(left.select("key").distinct(), "key", "left_semi").select("key", F.posexplode(units(F.col("text"))).alias("unit", "words")).join(left, ["key", "unit"], "left_semi")
    terms = again.select("key", "unit", F.explode(split_terms(F.col("words"))).alias("term")).groupBy("key", "unit", "term").agg(F.count("*").alias("n"))
    terms = written(terms.join(templates.weights, "term", "left"), "licence-pieces")
    others = written(terms.filter("idf is null").select("term").distinct(), "licence-others")
    df = written(document_frequencies(texts, others), "licence-df")
    true = F.log((1.0 + templates.n) / (1.0 + F.col("df"))) + 1.0
    weighed = terms.join(df, "term", "left").withColumn("idf", F.coalesce("idf", true))
    size = weighed.groupBy("key", "unit").agg(F.sqrt(F.sum((F.col("n") * F.col("idf")) ** 2)).alias("size"))
    similar = possible.join(size, ["key", "unit"]).select("key", "licence", F.round(F.col("dot") / F.col("size"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    # A row per licence name that a file resembles, so the sorted lists are no longer than there are names.
    by_name = similar.groupBy("key", "licence").agg(F.max("similarity").alias("similarity"))
    ranked = by_name.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "licence"))).alias("ranked"))
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return ranked.select("key", first["licence"].alias("licence"), (-first["order"]).alias("similarity"), second["licence"].alias("runner_up"), F.round(second["order"] - first["order"], 6).alias("margin"))


def ancestors(directory: Column) -> Column:
    """(ancestor, depth) of a directory: itself and all above it."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("ancestor"), n.alias("depth")))


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """row, licence, similarity, origin (own, inherited or none), licence_path, runner_up, margin.

    ``files``: row (any value, null or repeated too), path, text."""
    texts = files.select("text")
    vectors = Templates(texts, list(templates.items()) if templates else built_in(), threshold)
    files = written(files.select(F.monotonically_increasing_id().alias("key"), "row", "path", F.when(vectors.may_match(F.col("text")), F.col("text")).alias("text")), "licence-files")
    own = written(own_licences(files, texts, vectors, threshold), "licences")
    named = files.select("key", "row", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")).join(own, "key", "left")
    holders = named.filter(F.col("licence").isNotNull() & F.col("name").rlike(LICENCE_FILE)).groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "path", "licence")).alias("holder"))
    holders = holders.select(F.col("directory").alias("ancestor"), F.col("holder.path").alias("licence_path"), F.col("holder.licence").alias("given"))
    directories = files.filter("path is not null").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")).distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("up")).select("directory", "up.ancestor", "up.depth")
    nearest = directories.join(holders, "ancestor").groupBy("directory").agg(F.max_by(F.struct("licence_path", "given"), "depth").alias("from"))
    joined = named.join(nearest, "directory", "left")
    has_own = F.col("licence").isNotNull()
    origin = F.when(has_own, "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return joined.select("row", F.coalesce("licence", "from.given").alias("licence"), "similarity", origin.alias("origin"), F.when(has_own, F.col("path")).otherwise(F.col("from.licence_path")).alias("licence_path"), "runner_up", "margin")


#: Where the documents table lies as a file tree: every fiftieth document is a licence file.
PATH_SQL = "concat(coalesce(source, 'none'), '/', doc_id div 1000, '/', doc_id div 100, '/', if(doc_id % 50 = 0, 'LICENSE-', 'doc-'), doc_id)"


def op2_license_scan(docs: DataFrame) -> DataFrame:
    return scan(docs.select(F.col("doc_id").alias("row"), F.expr(PATH_SQL).alias("path"), "text")).withColumnRenamed("row", "doc_id")


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(sorted(built_in())))
    return f"""
WITH tmpl AS (SELECT * FROM (VALUES {rows}) v(template, name, body)),
tt AS (SELECT template, name, term, count(*)::DOUBLE AS n FROM (SELECT template, name, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM tmpl) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS key, doc_id, text, concat(coalesce(source, 'none'), '/', doc_id // 1000, '/', doc_id // 100, '/', CASE WHEN doc_id % 50 = 0 THEN 'LICENSE-' ELSE 'doc-' END, doc_id) AS path FROM documents),
total AS (SELECT count(*)::DOUBLE AS n FROM docs),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM docs) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM (SELECT term FROM tt UNION SELECT term FROM dfs) LEFT JOIN dfs USING (term), total),
pieces AS (SELECT key, row_number() OVER () AS piece, regexp_extract_all(lower(p), '[a-z0-9]+') AS terms
  FROM (SELECT key, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r\\f]*(?:\\n[ \\t\\r\\f]*)*\\n'), [text]))) AS p FROM docs)),
pw AS (SELECT key, piece, term, count(*) * any_value(w) AS w FROM (SELECT key, piece, unnest(terms) AS term FROM pieces) JOIN idf USING (term) GROUP BY key, piece, term),
len AS (SELECT piece, sqrt(sum(w * w)) AS size FROM pw GROUP BY piece),
tw AS (SELECT template, name, term, tt.n * w AS w FROM tt JOIN idf USING (term)),
tl AS (SELECT template, sqrt(sum(w * w)) AS size FROM tw GROUP BY template),
dot AS (SELECT key, piece, template, name, sum(pw.w * tw.w) AS d FROM pw JOIN tw USING (term) GROUP BY ALL),
cos AS (SELECT key, name, round(d / (len.size * tl.size), 6) AS c FROM dot JOIN len USING (piece) JOIN tl USING (template)),
names AS (SELECT key, name, max(c) AS c FROM cos WHERE c >= {THRESHOLD} GROUP BY key, name),
ranks AS (SELECT key, name, c, row_number() OVER (PARTITION BY key ORDER BY c DESC, name) AS rank FROM names),
own AS (SELECT a.key, a.name AS licence, a.c AS similarity, b.name AS runner_up, round(a.c - b.c, 6) AS margin FROM ranks a LEFT JOIN ranks b ON a.key = b.key AND b.rank = 2 WHERE a.rank = 1),
named AS (SELECT docs.key, docs.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS name, licence, similarity, runner_up, margin FROM docs LEFT JOIN own USING (key)),
holders AS (SELECT directory AS ancestor, first(path ORDER BY similarity DESC, path) AS licence_path, first(licence ORDER BY similarity DESC, path) AS given FROM named WHERE licence IS NOT NULL AND name LIKE 'LICENSE%' GROUP BY directory),
nearest AS (SELECT n.key, first(h.licence_path ORDER BY length(h.ancestor) DESC) AS licence_path, first(h.given ORDER BY length(h.ancestor) DESC) AS given FROM named n JOIN holders h ON n.directory = h.ancestor OR starts_with(n.directory, h.ancestor || '/') GROUP BY n.key)
SELECT n.doc_id, coalesce(n.licence, r.given) AS licence, n.similarity,
       CASE WHEN n.licence IS NOT NULL THEN 'own' WHEN r.key IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN n.licence IS NOT NULL THEN n.path ELSE r.licence_path END AS licence_path, n.runner_up, n.margin
FROM named n LEFT JOIN nearest r USING (key)
"""


ORACLE = _oracle()
