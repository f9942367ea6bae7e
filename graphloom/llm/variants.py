"""Operator 12: spelling variants grouped by anagram hashing.

A letter's value is its number in the alphabet, raised to the fifth power; a word's key is the sum
of its letters' values, the same for all arrangements of them.  Two words that differ by one added
or removed letter have keys that differ by one value; two that differ by one exchanged letter have
keys that are equal once each has given up one letter.  So every word is entered under its own key
and under its key less each of its letters, and one equality join on keys finds all candidates;
``levenshtein`` then verifies the order of the letters.

Words of few different letters (codes, sequences of bases) have very many anagrams.  So a letter
is given up piece by piece: an edit touches one piece of six letters, and what stands outside that
piece must be the same, so a hash of it joins beside the key.  A group then holds arrangements of
the letters of one piece only, whatever the words are.

Words are counted before they are shuffled.  Forms are followed to their ends by doubling: each
round joins the links with themselves, and a form occurs at least twice as often as its word, so
the rounds are at most the logarithm of that of all words.

Null text: no words.  Null id: as an empty id.  Repeated rows are documents of their own and make
the same words.  Runs of letters of any length are words.  A table without words gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, written
from graphloom.llm.exact import LOWER, UPPER

#: What a word consists of once A to Z are in lower case.
LETTERS = "a-zÀ-ÿ"
#: Of so many runs one loses a letter.
DAMAGED = 97
LEAST_LETTERS, LEAST_N, LEAST_RATIO = 5, 3, 2
POWER = 5
#: Letters of a piece, and the most pieces of a word; longer words have longer pieces.
PIECE, PIECES = 6, 64


def occurrences(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """One row per run of letters: word, as the run's digest leaves it."""
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]+"), 0)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.when(h % damaged == 0, (h % F.length("run")).cast("int"))
    rest = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    return runs.select("run", at.alias("at")).select(F.coalesce(rest, "run").alias("word"))


def counted(words: DataFrame, least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N) -> DataFrame:
    """word, n: distinct words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _value(letter: Column) -> Column:
    """a to z are 1 to 26, the others follow; fifth powers, whose sums hardly ever meet by chance."""
    code = F.ascii(letter)
    number = F.when(code < 128, code - 96).otherwise(code - 0xC0 + 27).cast("long")
    power = number
    for _ in range(POWER - 1):
        power = power * number
    return power


def _key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, letter: total + _value(letter))


def entries(words: DataFrame) -> DataFrame:
    """word, n, whole, key, rest: a word under its own key, and under its key less a letter, piece by piece.

    ``rest`` tells the piece, its place and what stands outside it; it is reckoned on the shorter
    word of a pair, so both words of a pair agree on it."""
    rows = words.withColumn("key", _key(F.split("word", "")))
    both = rows.select("word", "n", "key", F.explode(F.array(F.lit(True), F.lit(False))).alias("whole"))
    both = both.withColumn("short", F.length("word") - F.when(F.col("whole"), 0).otherwise(1))
    both = both.withColumn("step", F.greatest(F.lit(PIECE), F.ceil(F.col("short") / PIECES).cast("int")))
    pieces = both.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.col("short") - 1, F.lit(0)), F.col("step"))))
    pieces = pieces.withColumn("stop", F.least(F.col("start") + F.col("step"), "short") + F.when(F.col("whole"), 0).otherwise(1))
    outside = F.xxhash64("short", "start", F.substr("word", F.lit(1), F.col("start")), F.substr("word", F.col("stop") + 1))
    inside = F.array_distinct(F.split(F.substr("word", F.col("start") + 1, F.col("stop") - F.col("start")), ""))
    less = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(F.transform(inside, _value))
    return pieces.select("word", "n", "whole", outside.alias("rest"), "key", F.explode(less).alias("less")).select("word", "n", "whole", (F.col("key") - F.col("less")).alias("key"), "rest")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs, in both directions, that differ by one inserted, deleted or replaced letter."""
    under = written(entries(words), "variants-entries")
    one = under.filter("not whole").select("word", "n", "key", "rest")
    other = under.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "whole", "key", "rest")
    found = one.join(other, ["key", "rest"]).filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    there = F.struct("word", "near", "near_n")
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Exchanges are found from both sides, additions from the longer word only.
    pairs = found.select(F.explode(F.when(F.col("whole"), F.array(there, back)).otherwise(F.array(there))).alias("pair")).select("pair.*")
    return pairs.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms that begins at each word.  ``links``: word, form; no cycles."""
    reached = written(links.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        dropped(reached)
        reached = doubled
        if reached.filter("moved").isEmpty():
            return reached.select("word", "root")


def variants(docs: DataFrame, damaged: int = DAMAGED, least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``least_ratio``: times the word's count that a form's count must reach; more than 1, so that
    chains of forms end."""
    if least_ratio <= 1:
        raise ValueError("least_ratio must be more than 1")
    words = written(counted(occurrences(docs, damaged), least_letters, least_n), "variants-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    led = (-F.col("best.order")) >= least_ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.order")).alias("form_n"))
    formed = written(formed, "variants-forms")
    ends = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: The same pairs from deletions; the checksum is reckoned from its polynomial.
ORACLE = r"""
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents) GROUP BY doc_id, run),
bytes AS MATERIALIZED (
  SELECT run, n, list_transform(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)), lambda b: CAST(b AS BIGINT)) AS b
  FROM runs),
hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INTEGER) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, steps),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "binary") AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
