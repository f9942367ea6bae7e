"""Pairwise evaluation: request rows, verdict parsing, win rates, batch ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the verdict format.
CRITERIA = ("Comprehensiveness", "Diversity", "Empowerment", "Overall Winner")


def winner(value: Column) -> Column:
    """1, 2 or 0 (tie) of a verdict as text; null where it says none of them.

    "answer 1" is looked for before "answer 2", and both before a tie."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    return (
        F.when(F.contains(text, F.lit("answer 1")) | text.isin("1", "a", "answer1"), F.lit(1))
        .when(F.contains(text, F.lit("answer 2")) | text.isin("2", "b", "answer2"), F.lit(2))
        .when(F.contains(text, F.lit("tie")) | F.contains(text, F.lit("draw")) | text.isin("both"), F.lit(0))
    )


def winner_of(value: Column) -> Column:
    """The same of a JSON value: numbers count by their whole part and true as 1; anything else by its text."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int")
    truth = F.when(F.try_variant_get(value, "$", "boolean"), F.lit(1))
    return F.when(kind == "BOOLEAN", truth).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(whole.isin(1, 2), whole)).otherwise(winner(F.try_variant_get(value, "$", "string")))


def unfenced(text: Column) -> Column:
    """Content without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"\A```[A-Za-z]*\n|\n```\z", ""))


def criteria_winners(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, criterion and winner of verdicts in ``content``: a row for each criterion.

    The content is parsed once.  The block under the criterion's exact key counts, else the first
    one under its key in any case; a block without a winner is invalid.  Only where there is no
    such block is one looked for by pattern, in texts that are cut off or no JSON."""
    parsed = rows.select(*keep, "content", F.try_variant_get(F.try_parse_json(unfenced(F.col("content"))), "$", "map<string,variant>").alias("_blocks"))
    each = parsed.select("*", F.explode(F.array(*[F.lit(c) for c in CRITERIA])).alias("criterion"))
    is_block = lambda k: F.startswith(F.coalesce(F.schema_of_variant(F.col("_blocks")[k]), F.lit("")), F.lit("OBJECT"))
    keys = F.filter(F.map_keys("_blocks"), lambda k: (F.lower(k) == F.lower("criterion")) & is_block(k))
    named = each.select("*", F.when(F.array_contains(keys, F.col("criterion")), F.col("criterion")).otherwise(F.get(keys, F.lit(0))).alias("_key"))
    inside = winner_of(F.try_variant_get(F.col("_blocks")[F.col("_key")], "$.Winner", "variant"))
    pattern = F.coalesce(*[F.when(F.col("criterion") == c, F.regexp_extract("content", rf'(?is)"{c}"\s*:\s*\{{[^}}]*"Winner"\s*:\s*"([^"]+)"', 1)) for c in CRITERIA])
    return named.select(*keep, "criterion", F.when(F.col("_key").isNotNull(), inside).otherwise(winner(pattern)).alias("winner"))


def directed(value: Column, reverse: Column) -> Column:
    """A winner in terms of the forward direction."""
    return F.when(reverse & value.isin(1, 2), 3 - value).otherwise(value)


def request_pairs(left: DataFrame, right: DataFrame, limit: int = -1) -> DataFrame:
    """Forward and reverse judge requests of two answer tables (query, answer, ord), joined on the query.

    The order is that of the smaller table, of equals the left one's; ``limit`` counts queries, if it is more than 0."""
    n_left, n_right = left.count(), right.count()
    order = F.col("l.ord") if n_left <= n_right else F.col("r.ord")
    joined = left.alias("l").join(right.alias("r"), F.col("l.query") == F.col("r.query")).select(F.col("l.query").alias("query"), F.col("l.answer").alias("answer_l"), F.col("r.answer").alias("answer_r"), order.alias("ord"))
    numbered = joined.withColumn("n", F.row_number().over(Window.orderBy("ord")))
    if limit > 0:
        numbered = numbered.filter(F.col("n") <= limit)
    sides = F.explode(F.array(F.lit("for"), F.lit("rev"))).alias("direction")
    both = numbered.select("n", "query", "answer_l", "answer_r", sides)
    forward = F.col("direction") == "for"
    return both.select(F.format_string("judge-%06d-%s", F.col("n") - 1, F.col("direction")).alias("custom_id"), "query", "direction", F.when(forward, F.col("answer_l")).otherwise(F.col("answer_r")).alias("answer_a"), F.when(forward, F.col("answer_r")).otherwise(F.col("answer_l")).alias("answer_b"))


def answer_pairs(files: DataFrame) -> DataFrame:
    """Every unordered pair of answer files (name): left, right."""
    return files.alias("a").join(files.alias("b"), F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("left"), F.col("b.name").alias("right"))


def verdicts(results: DataFrame, requests: DataFrame) -> DataFrame:
    """pair_id, criterion, winner (forward terms, null: invalid) of results (pair_id, custom_id, content)."""
    meta = requests.select("pair_id", "custom_id", "direction")
    rows = results.join(meta, ["pair_id", "custom_id"], "left")
    # A result without request metadata falls back on its id.
    told = F.lower(F.trim(F.coalesce(F.col("direction"), F.regexp_extract("custom_id", "-([a-z]+)$", 1))))
    rows = rows.select("pair_id", "content", F.coalesce(told.isin("reverse", "rev", "backward", "back"), F.lit(False)).alias("reverse"))
    return criteria_winners(rows, "pair_id", "reverse").select("pair_id", "criterion", directed(F.col("winner"), F.col("reverse")).alias("winner"))


def percent(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.round(n / d * 100, 2)).otherwise(F.lit(0.0))


def win_rates(rows: DataFrame) -> DataFrame:
    """Counts and rates of every pair and criterion, and of every criterion over all pairs (pair_id null)."""
    w = F.col("winner")
    totals = rows.groupingSets([["pair_id", "criterion"], ["criterion"]], "pair_id", "criterion").agg(F.count_if(w == 1).alias("answer1"), F.count_if(w == 2).alias("answer2"), F.count_if(w == 0).alias("tie"), F.count_if(w.isNull()).alias("invalid"), F.count("*").alias("total"))
    valid = F.col("total") - F.col("invalid")
    return totals.select("pair_id", "criterion", "answer1", "answer2", "tie", "invalid", "total", valid.alias("valid"), *[percent(F.col(c), valid).alias(f"{c}_pct") for c in ("answer1", "answer2", "tie")])
