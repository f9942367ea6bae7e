"""Operator 1: document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text's paragraphs are its lines, cut at sentence ends, and long ones further into blocks of at
most ``BLOCK_WORDS`` words; a paragraph's digest is its 64-bit hash.  A sketch is a table of
cells; every distinct digest is in one cell of each of three subtables, and a cell holds the
count, the xor of the digests and the xor of their checks.  Sketches of two versions subtract
cell by cell, digests in both cancel, and peeling recovers the rest: a cell with count 1 or -1
whose check fits its key gives a digest of one version, which is taken out of its other cells.

The fingerprint is a sketch of fixed size.  Where the difference of two fingerprints does not peel
to nothing, a larger table is made of both and subtracted.  It is cut in groups of cells by the top
bits of the digests, as many as the difference needs: the squares of the counts in a subtable of the
difference add up to about the number of differing digests.  Each group peels on its own, and one
that fails is made again with 2, 8 and 32 times the cells, by other bits.  The result is the digests
that only the first and only the second version has.  Likeness is the Jaccard similarity of the
digest sets, from the numbers of both and of the recovered digests.

Order of documents: descending id, null ids last, equal ids by a hash of the text.  The order is
cut in ranges at ids that occur, and an id (or none) that many rows have is cut further by those
hashes; only rows with the same id and text are never parted.  The first document of a range also
stands, as a ghost, at the end of the range before, so every range knows the document after its
last one.

Null text: empty.  Two texts without paragraphs have likeness 1, one without and one with 0.
Repeated rows are documents of their own.  A single document is its own next.  An empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import parallelism

#: Where a line is cut, what counts as a long piece (characters), and the words in a block of it.
CUT = r"(?<=[.!?])[\x20\x09\x0B-\x0D]+|\n+"
LONG = 400
BLOCK_WORDS = 32
#: log2 of a fingerprint's cells per subtable, and its lowest digest bit.
FINGERPRINT, FINGERPRINT_LOW = 3, 39
#: Differing digests in a group, about, and the top bits that tell groups apart at most.
GROUP = 8
SPLITS = 24
#: (log2 of cells per subtable, lowest digest bit) of a group's attempts; none reaches the top bits.
ATTEMPTS = ((3, 0), (4, 9), (6, 21), (8, 15))
#: Bytes of text in a range of the order, about, and the ranges at most (beyond, they grow and are sorted on disk).
RANGE_BYTES = 16 << 20
MOST_RANGES = 50_000
#: Half steps of peeling: a table that needs more counts as failed.
ROUNDS = 24


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit paragraph digests."""
    pieces = F.filter(F.split(text, CUT), lambda p: F.trim(p) != "")
    blocks = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > LONG, F.regexp_extract_all(p, F.lit(r"(?:\S+\s*){1,%d}" % BLOCK_WORDS), F.lit(0))).otherwise(F.array(p))))
    return F.array_distinct(F.transform(blocks, lambda p: F.xxhash64(F.trim(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _place(digest: Column, subtable: int, bits: int, low: int) -> Column:
    """Cell of a digest in a subtable (0 to 2), numbered over the three."""
    return F.shiftrightunsigned(digest, subtable * bits + low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") + F.lit(subtable << bits)


def _placed(digest: Column, bits: int, low: int, **more: Column) -> Column:
    """A digest with its check and its three cells."""
    return F.struct(digest.alias("key"), _check(digest).alias("check"), *[_place(digest, t, bits, low).alias(f"p{t}") for t in range(3)], *[c.alias(n) for n, c in more.items()])


def _in_cell(placed: Column, j: Column) -> Column:
    return (placed["p0"] == j) | (placed["p1"] == j) | (placed["p2"] == j)


def sketch(digests: Column, bits: int, low: int) -> Column:
    """The table of ``digests``: 3 * 2**bits cells (n, key, check)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
    add = lambda a, d: F.struct((a["n"] + 1).alias("n"), a["key"].bitwiseXOR(d["key"]).alias("key"), a["check"].bitwiseXOR(d["check"]).alias("check"))
    # A one-element array holds the placed digests, so that they are computed once and not per cell.
    once = F.array(F.transform(digests, lambda d: _placed(d, bits, low)))
    return F.flatten(F.transform(once, lambda placed: F.transform(F.sequence(F.lit(0), F.lit((3 << bits) - 1)), lambda j: F.aggregate(F.filter(placed, lambda d: _in_cell(d, j)), zero, add))))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def _no_digests() -> Column:
    return F.array().cast("array<bigint>")


def _keys(found: Column, n: int) -> Column:
    return F.transform(F.filter(found, lambda f: f["n"] == n), lambda f: f["key"])


def peeled(cells: Column, bits: int, low: int) -> Column:
    """(first, second): the digests that only the first and only the second version has; null if peeling fails."""
    pure = lambda c: F.filter(c, lambda x: (F.abs(x["n"]) == 1) & (x["check"] == _check(x["key"])))

    def step(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(pure(state["cells"]), lambda x: _placed(x["key"], bits, low, n=x["n"])))

        def without(cell: Column, j: Column) -> Column:
            here = F.filter(state["found"], lambda f: _in_cell(f, j))
            return F.aggregate(here, cell, lambda c, f: F.struct((c["n"] - f["n"]).alias("n"), c["key"].bitwiseXOR(f["key"]).alias("key"), c["check"].bitwiseXOR(f["check"]).alias("check")))

        # Two half steps a round, so that what was found is computed once: find, then take out.
        took = F.struct(
            F.transform(state["cells"], without).alias("cells"),
            F.filter(state["found"], lambda f: F.lit(False)).alias("found"),
            F.concat(state["first"], _keys(state["found"], 1)).alias("first"),
            F.concat(state["second"], _keys(state["found"], -1)).alias("second"),
            F.lit(False).alias("over"),
        )
        looked = F.struct(state["cells"].alias("cells"), found.alias("found"), state["first"].alias("first"), state["second"].alias("second"), F.lit(True).alias("over"))
        # ``over`` is set while looking; looking twice in a row without a find changes nothing more.
        return F.when(F.size(state["found"]) > 0, took).when(state["over"], state).otherwise(looked)

    none = F.expr("cast(array() as array<struct<key: bigint, check: bigint, p0: int, p1: int, p2: int, n: int>>)")
    start = F.struct(cells.alias("cells"), none.alias("found"), _no_digests().alias("first"), _no_digests().alias("second"), F.lit(False).alias("over"))
    clear = lambda s: F.forall(s["cells"], lambda x: (x["n"] == 0) & (x["key"] == 0) & (x["check"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(clear(s), F.struct(s["first"].alias("first"), s["second"].alias("second"))))


def split_groups(a: Column, b: Column, times: Column) -> Column:
    """Both digest sets in 2**times groups (a, b) by their top bits."""
    kind = "array<struct<a: array<bigint>, b: array<bigint>>>"
    has = lambda d, k, bit: F.call_function("shiftrightunsigned", d, (F.lit(64) - k).cast("int")).bitwiseAND(F.lit(1)) == bit
    half = lambda g, k, bit: F.struct(F.filter(g["a"], lambda d: has(d, k, bit)).alias("a"), F.filter(g["b"], lambda d: has(d, k, bit)).alias("b"))
    halves = lambda groups, k: F.flatten(F.transform(groups, lambda g: F.array(half(g, k, 0), half(g, k, 1)))).cast(kind)
    levels = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.array(F.struct(a.alias("a"), b.alias("b"))).cast(kind), halves)


def apart(cells: Column, bits: int) -> Column:
    """About how many digests differ, from a difference of sketches: the largest sum of squared counts of a subtable."""
    squares = lambda t: F.aggregate(F.slice(cells, (t << bits) + 1, 1 << bits), F.lit(0).cast("long"), lambda s, c: s + c["n"].cast("long") * c["n"])
    return F.greatest(*[squares(t) for t in range(3)])


def differences(a: Column, b: Column, print_a: Column, print_b: Column) -> Column:
    """(first, second): the digests of one side only, from the fingerprints or from larger tables where those do not peel."""
    less = subtracted(print_a, print_b)
    # No estimate exceeds what there is; too low an estimate means groups that take more attempts.
    need = F.least(apart(less, FINGERPRINT), (F.size(a) + F.size(b)).cast("long"))
    times = F.when(need <= GROUP, 0).otherwise(F.least(F.lit(SPLITS), F.ceil(F.log2(need / F.lit(float(GROUP)))).cast("int")))

    def decoded(g: Column) -> Column:
        x, y = g["a"], g["b"]
        tries = [peeled(subtracted(sketch(x, bits, low), sketch(y, bits, low)), bits, low) for bits, low in ATTEMPTS]
        # Groups that no attempt peels: digests that share all their cells in all of the attempts.
        last = F.struct(F.array_except(x, y).alias("first"), F.array_except(y, x).alias("second"))
        nothing = F.struct(_no_digests().alias("first"), _no_digests().alias("second"))
        return F.when(F.size(x) + F.size(y) == 0, nothing).otherwise(F.coalesce(*tries, last))

    groups = F.transform(split_groups(a, b, times), decoded)
    # A one-element array holds the groups, so that they are decoded once and not per side.
    once = F.transform(F.array(groups), lambda g: F.struct(F.flatten(F.transform(g, lambda x: x["first"])).alias("first"), F.flatten(F.transform(g, lambda x: x["second"])).alias("second")))
    small = peeled(less, FINGERPRINT, FINGERPRINT_LOW)
    return F.coalesce(F.when(F.abs(F.size(a) - F.size(b)) <= 3 << FINGERPRINT, small), F.get(once, F.lit(0)))


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Jaccard similarity of two digest sets, given what only either has."""
    shared = F.size(a) - F.size(difference["first"])
    union = F.size(a) + F.size(difference["second"])
    return F.when(union > 0, shared.cast("double") / union.cast("double")).otherwise(F.lit(1.0))


def as_text(cells: Column) -> Column:
    """A sketch as a string: count.key.check of every cell in hexadecimal, and - for empty ones."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, "-").otherwise(F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["check"])))), ":")


def _search(edges: list[int], value: Column) -> Column:
    """How many of the ascending ``edges`` are less than ``value``, by binary search."""
    array = F.array(*[F.lit(e).cast("long") for e in edges])
    steps = F.array(*[F.lit(1 << b) for b in range(len(edges).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(edges)) & (F.get(array, at + s - 1) < value), at + s).otherwise(at))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text (null: empty), place, hash, range and ghost: every range's documents and, as a ghost, the first of the next one."""
    spark = docs.sparkSession
    least = -(1 << 63)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"place": F.coalesce("doc_id", F.lit(least).cast("long")), "hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    amount = base.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not amount["rows"]:
        return base.withColumns({"range": F.lit(0).cast("long"), "ghost": F.lit(0)})
    n = ranges or min(MOST_RANGES, max(4 * parallelism(spark), amount["bytes"] // RANGE_BYTES))
    seen = base.agg(F.percentile_approx("place", [i / n for i in range(1, n)] if n > 1 else [0.5], max(10_000, 10 * n)).alias("cuts"), F.max("place").alias("top")).first()
    room = max(1, -(-amount["rows"] // n))
    # At most n ids have as many rows as a range; each becomes ranges of its own, cut by the texts' hashes.
    hot = {r["place"]: -(-r["n"] // room) for r in base.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * room).collect()}
    edges = sorted({*seen["cuts"], seen["top"], *hot, *(h - 1 for h in hot if h > least)})
    # Range k starts, in descending order, at the k-th largest edge.
    number = F.lit(len(edges) - 1) - _search(edges, F.col("place"))
    parts = F.get(F.array(*[F.lit(hot.get(e, 1)) for e in reversed(edges)]), number)
    part = F.shiftright((F.shiftright("hash", 33) + F.lit(1 << 30)) * parts, 31)
    ranged = base.withColumns({"range": number.cast("long") * F.lit(1 << 24) + part, "ghost": F.lit(0)})
    first = F.min(F.struct(F.bitwise_not("place").alias("order"), "hash")).alias("first")
    firsts = sorted((r["range"], ~r["first"]["order"], r["first"]["hash"]) for r in ranged.groupBy("range").agg(first).collect())
    to = spark.createDataFrame([(firsts[i - 1][0], place, text_hash) for i, (_, place, text_hash) in enumerate(firsts)], "range long, place long, hash long")
    ghosts = base.join(F.broadcast(to), ["place", "hash"]).select(*base.columns, "range", F.lit(1).alias("ghost"))
    return ranged.unionByName(ghosts).repartition("range")


def fingerprinted(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, the two fingerprints and the two likenesses.

    Then the number of paragraphs and of recovered digests: of the text or its edited text only
    (only_before_edit, only_after_edit), and of the text or the next one only (only_here, only_next)."""
    spread = with_next(docs, ranges)
    rows = spread.withColumn("digests", paragraphs(F.col("text"))).withColumn("print", sketch(F.col("digests"), FINGERPRINT, FINGERPRINT_LOW))
    order = Window.partitionBy("range").orderBy("ghost", F.col("place").desc(), "hash")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "digests", "print")]).filter("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))})
    edited = edited.withColumn("edited_digests", paragraphs(F.col("edited"))).withColumn("edited_print", sketch(F.col("edited_digests"), FINGERPRINT, FINGERPRINT_LOW))
    compared = edited.withColumns({f"to_{x}": differences(F.col("digests"), F.col(f"{x}_digests"), F.col("print"), F.col(f"{x}_print")) for x in ("edited", "next")})
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("edited_digests"), F.col("to_edited")).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests"), F.col("to_next")).alias("near_next"),
        F.size("digests").alias("n_paragraphs"),
        *[F.size(F.col(f"to_{x}.{side}")).alias(f"only_{name}") for x, side, name in (("edited", "first", "before_edit"), ("edited", "second", "after_edit"), ("next", "first", "here"), ("next", "second", "next"))],
    )


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprinted(docs)
