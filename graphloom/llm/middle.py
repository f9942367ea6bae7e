"""Operator 11: fill-in-the-middle texts, cut at zero-width boundaries of unit grammars.

A unit grammar says of what units a text consists: lines, blocks, words, runs of a class.  Each
is translated to a regular expression that matches nothing but the place between two characters
of neighbouring classes (a look behind and a look ahead), and ``split`` at those places returns
the units whole, in order, with nothing lost.  A text with no characters has no units, where
split would return one empty piece, so it is handled apart.

Two cuts among the units, drawn from a digest of the document's id, give prefix, middle and
suffix, which are written in one of two orders behind sentinels.  All of it is one projection of
the scan: nothing is shuffled, and a text's row holds all that is needed.

Null text: as an empty one, plain.  Null id: as an empty id.  Repeated rows are documents of their
own with the same cuts.  A text that holds a sentinel stays plain, as it could not be taken apart
again.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "7"
#: Per cent of the texts that are cut, and of those the per cent with the suffix first.
CUT, SUFFIX_FIRST = 100, 50
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"
WHITE = r"\x20\x09-\x0D"
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Units:
    """``grammar``: what a unit is, matched left to right; ``boundary``: the places between units."""

    grammar: str
    boundary: str


def ending(chars: str) -> Units:
    """Units end after each character of the class."""
    return Units(f"[^{chars}]*[{chars}]|[^{chars}]+", f"(?<=[{chars}])(?={ANY})")


def ending_in_run(chars: str) -> Units:
    """Units end after a whole run of the class."""
    return Units(f"[^{chars}]*[{chars}]+|[^{chars}]+", f"(?<=[{chars}])(?=[^{chars}])")


def starting(chars: str) -> Units:
    """Units begin before each character of the class."""
    return Units(f"{ANY}[^{chars}]*", f"(?<={ANY})(?=[{chars}])")


def runs(*classes: str) -> Units:
    """Units are maximal runs of one of the disjoint classes, or of what is in none."""
    grammar = "|".join([f"[{c}]+" for c in classes] + [f"[^{''.join(classes)}]+"])
    return Units(grammar, "|".join(f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" for c in classes))


UNITS = {
    "line": ending(r"\n"),
    "block": ending_in_run(r"\n"),
    "sentence": ending_in_run(".!?"),
    "word": ending_in_run(WHITE),
    "item": starting(r"\-*#"),
    "token": runs("A-Za-z", "0-9", WHITE),
    "character": Units(ANY, f"(?<={ANY})(?={ANY})"),
}


def units(text: Column, kind: Units) -> Column:
    """The units of a text; none of a null or empty one."""
    return F.when(F.length(text) > 0, F.split(text, kind.boundary, -1)).otherwise(F.array().cast("array<string>"))


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, kind: Units | str = "line", cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain), output."""
    kind = UNITS[kind] if isinstance(kind, str) else kind
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), units(text, kind).alias("units"), *[h.alias(f"h{i + 1}") for i, h in enumerate(_draws(F.col("doc_id"), seed))])
    places = F.size("units") + 1
    one, other = F.col("h1") % places, F.col("h2") % places
    marked = F.lit(False)
    for mark in (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.length("text") == 0) | marked | (F.col("h3") % 100 >= cut), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", F.size("units").cast("long").alias("n"), form.alias("form"), F.least(one, other).cast("int").alias("first"), F.greatest(one, other).cast("int").alias("last"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = rows.select("doc_id", "text", "n", "form", part(F.lit(1), F.col("first")).alias("prefix"), part(F.col("first") + 1, F.col("last") - F.col("first")).alias("middle"), part(F.col("last") + 1, F.col("n").cast("int") - F.col("last")).alias("suffix"))
    prefix, suffix, middle = F.concat(F.lit(PREFIX_MARK), "prefix"), F.concat(F.lit(SUFFIX_MARK), "suffix"), F.concat(F.lit(MIDDLE_MARK), "middle")
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("text"))
    return parts.withColumn("output", output)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of that form: what stands between the sentinels, in its first order."""
    between = F.split(output, f"{PREFIX_MARK}|{SUFFIX_MARK}|{MIDDLE_MARK}", -1)
    psm, spm = F.concat(between[1], between[3], between[2]), F.concat(between[2], between[3], between[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(docs: DataFrame) -> DataFrame:
    cut = fill_in_middle(docs)
    chars = lambda part: F.length(part).cast("long")
    return cut.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
