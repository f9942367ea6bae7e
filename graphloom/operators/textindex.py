"""Substring search for a table of queries over blocks of texts.

Every query word that is a substring of a node's lower-cased ``id text`` is a hit, so an index of
words does not do.  But a query's word has no white space, so it lies within one token of a text:
a block splits its texts into distinct tokens and looks the tokens' substrings up among all the
queries' words, which is work in proportion to the texts, however many words there are.

Texts lie in blocks of bounded size, bucketed by block, so a search moves the queries and not the
texts.  A block counts the hits of its texts for some queries at a time, words that many texts hold
and many queries ask for by a product of matrices and the others by their postings.  A few texts,
the longest and the first ones, are searched before: the k-th best of them is a floor for each
query, and a block sends on only what is not below it, its best k at most.

The trigram index says beforehand how many texts may hold a word: for each trigram and block the
texts that hold it, as places or as a bitmap, whichever is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import tokens
from graphloom.session import bucketed_table

#: Characters and texts of a block, at most (a longer text is a block of its own).
BLOCK_CHARS, BLOCK_ROWS = 4 << 20, 4096
#: Letters of a gram, and the rarest grams of a word that its candidates must hold.
GRAM, RAREST = 3, 3
POSTINGS = "gram string, block long, held binary, n int"
#: Queries that are sent as one row, counts of hits that a block holds at once, and texts searched before, of each kind.
QUERY_ROWS, CELLS, LEADING = 1024, 1 << 22, 256
#: A word goes into the product of matrices from this share of (text, query) pairs on.
DENSE = 0.01


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with block and pos: a task numbers its blocks, the task's number comes before."""
    block, rows, chars = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        sizes = batch.column("chars").to_pylist()
        numbers, places = [], []
        for size in sizes:
            if rows and (rows == BLOCK_ROWS or chars + size > BLOCK_CHARS):
                block, rows, chars = block + 1, 0, 0
            numbers.append(block)
            places.append(rows)
            rows, chars = rows + 1, chars + size
        yield pa.record_batch([batch.column("id"), batch.column("ord"), batch.column("haystack"), pa.array(numbers, pa.int64()), pa.array(places, pa.int32())], names=["id", "ord", "haystack", "block", "pos"])


def _packed(places: np.ndarray, rows: int) -> bytes:
    """Places below ``rows``, as 16-bit numbers behind a 0 or as a bitmap behind a 1."""
    if 2 * len(places) < rows // 8:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(rows, bool)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def _letters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one run after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _postings(key: tuple, table: pa.Table) -> pa.Table:
    texts, places = table.column("haystack").to_pylist(), table.column("pos").to_numpy()
    letters = _letters(texts)
    lengths = np.array([len(t) for t in texts])
    inner = np.maximum(lengths - GRAM + 1, 0)
    starts = np.cumsum(lengths) - lengths
    at = _runs(starts, inner)
    grams, number = np.unique(letters[at] << np.uint64(42) | letters[at + 1] << np.uint64(21) | letters[at + 2], return_inverse=True)
    rows = int(places.max()) + 1
    pairs = np.unique(number * rows + np.repeat(places, inner))
    counts = np.bincount(pairs // rows, minlength=len(grams))
    mask = np.uint64((1 << 21) - 1)
    spelled = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & mask, grams & mask], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    held = [_packed(x, rows) for x in np.split(pairs % rows, np.cumsum(counts)[:-1])] if len(grams) else []
    return pa.table([pa.array([spelled[GRAM * i : GRAM * (i + 1)] for i in range(len(grams))], pa.string()), pa.array([key[0].as_py()] * len(grams), pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.int32())], names=["gram", "block", "held", "n"])


def _inner(tokens: list[str], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """token, word: the places of the tokens and of the words that are in them, found by hashes of windows and compared by letters."""
    sizes = np.array([len(w) for w in words], np.int64)
    kinds = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
    spelled = {n: _letters([words[i] for i in those]).reshape(-1, n) for n, those in kinds.items()}
    factor = 0x9E3779B97F4A7C15
    while True:
        hashes = {n: np.zeros(len(those), np.uint64) for n, those in kinds.items()}
        for n, letters in spelled.items():
            for i in range(n):
                hashes[n] = hashes[n] * np.uint64(factor) + letters[:, i]
        if all(len(np.unique(h)) == len(h) for h in hashes.values()):
            break
        factor = factor * 5 % (1 << 64)  # two words of one hash
    letters, lengths = _letters(tokens), np.array([len(t) for t in tokens], np.int64)
    token = np.repeat(np.arange(len(tokens)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))
    at, window, out = np.arange(len(letters)), np.zeros(len(letters), np.uint64), []
    seen = np.zeros(1 << 20, bool)
    spread = lambda h: h * np.uint64(0xD1B54A32D192ED03) >> np.uint64(44)
    for n in range(1, max(kinds) + 1):
        long = left[at] >= n
        at = at[long]
        window = window[long] * np.uint64(factor) + letters[at + n - 1]
        if n not in kinds:
            continue
        order = np.argsort(hashes[n])
        inside = hashes[n][order]
        seen[spread(inside)] = True
        some = np.flatnonzero(seen[spread(window)])
        seen[spread(inside)] = False
        place = np.minimum(np.searchsorted(inside, window[some]), len(inside) - 1)
        same = inside[place] == window[some]
        some, place = some[same], order[place[same]]
        for i in range(n):
            same = letters[at[some] + i] == spelled[n][place, i]
            some, place = some[same], place[same]
        out.append((token[at[some]], kinds[n][place]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _held(haystacks: pa.Array, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """word, text: the places of the words and of the texts that hold them, by word and text, each pair once."""
    # White space of words is more than this, so no word goes across.
    pieces = pc.ascii_split_whitespace(haystacks)
    token = pieces.flatten().dictionary_encode()
    kinds = len(token.dictionary)
    holder, word = _inner(token.dictionary.to_pylist(), words)
    order = np.argsort(holder, kind="stable")
    sizes = np.bincount(holder, minlength=kinds)
    said = np.unique(pc.list_parent_indices(pieces).to_numpy().astype(np.int64) * kinds + token.indices.to_numpy())
    text, said = said // kinds, said % kinds
    at = _runs((np.cumsum(sizes) - sizes)[said], sizes[said])
    pairs = np.unique(word[order][at] * len(haystacks) + np.repeat(text, sizes[said]))
    return pairs // len(haystacks), pairs % len(haystacks)


def _counted(word: np.ndarray, text: np.ndarray, rows: int, query: np.ndarray, asked: np.ndarray, times: np.ndarray, queries: int) -> np.ndarray:
    """The hits of every query (below ``queries``) in each of ``rows`` texts.

    word, text: the texts that hold a word, by word.  query, asked, times: the queries' words."""
    top = int(max(word.max(initial=0), asked.max(initial=0))) + 1
    held = np.bincount(word, minlength=top)
    starts = np.cumsum(held) - held
    dense = held * np.bincount(asked, minlength=top) > DENSE * rows * queries
    hits = np.zeros((queries, rows), np.float32)
    if dense.any():
        place = np.cumsum(dense) - 1
        of_query, of_text = np.zeros((queries, place[-1] + 1), np.float32), np.zeros((place[-1] + 1, rows), np.float32)
        mine, those = dense[asked], dense[word]
        of_query[query[mine], place[asked[mine]]] = times[mine]
        of_text[place[word[those]], text[those]] = 1
        hits += of_query @ of_text
    rest = np.flatnonzero(~dense[asked] & (held[asked] > 0))
    sizes = held[asked[rest]]
    part = np.cumsum(sizes) // CELLS
    for some in np.split(rest, np.flatnonzero(np.diff(part)) + 1) if len(rest) else []:
        each = held[asked[some]]
        at = _runs(starts[asked[some]], each)
        hits += np.bincount(np.repeat(query[some], each) * rows + text[at], weights=np.repeat(times[some], each), minlength=queries * rows).reshape(queries, rows)
    return hits


@dataclass(frozen=True)
class TrigramIndex:
    """``texts``: id, ord, haystack, block, pos."""

    texts: DataFrame

    @staticmethod
    def build(nodes: DataFrame) -> TrigramIndex:
        """The index of nodes (id, text, ord), written to the shared folder."""
        haystack = F.lower(F.concat_ws(" ", "id", F.coalesce("text", F.lit(""))))
        rows = nodes.select("id", F.col("ord").cast("long").alias("ord"), haystack.alias("haystack")).withColumn("chars", F.length("haystack").cast("long"))
        schema = T.StructType([rows.schema["id"], rows.schema["ord"], rows.schema["haystack"], T.StructField("block", T.LongType()), T.StructField("pos", T.IntegerType())])
        return TrigramIndex(bucketed_table(rows.mapInArrow(_blocks, schema), "texts", "block"))

    @cached_property
    def postings(self) -> DataFrame:
        """gram, block, held (packed places), n: written when first used; a search does without."""
        made = self.texts.select("block", "pos", "haystack").groupBy("block").applyInArrow(_postings, POSTINGS)
        return bucketed_table(made, "postings", "gram", gather=True)

    def routes(self, words: DataFrame) -> DataFrame:
        """word, grams: the rarest grams of each word (column word) of GRAM letters or more, rarest first; no row if a gram is nowhere."""
        every = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substr("word", i, F.lit(GRAM)))
        long = words.filter(F.length("word") >= GRAM).select("word", F.explode(F.array_distinct(every)).alias("gram"))
        spread = self.postings.select("gram", "n").join(long.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("texts"))
        known = long.join(spread, "gram", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("texts", "gram"))).alias("grams"), (F.count("texts") == F.count("*")).alias("whole"))
        return known.filter("whole").select("word", F.slice(F.transform("grams", lambda g: g["gram"]), 1, RAREST).alias("grams"))

    def candidates(self, words: DataFrame) -> DataFrame:
        """word, texts: an upper bound of the texts that are verified for each word, those with its rarest gram."""
        first = self.routes(words).select("word", F.col("grams")[0].alias("gram"))
        return first.join(self.postings, "gram").groupBy("word").agg(F.sum("n").alias("texts"))

    def _sent(self, texts: DataFrame, asked: DataFrame, packs: int) -> DataFrame:
        """to, asked: every pack of queries' words (asked: query_id, word, times, floor_hits, floor_ord) for every block of ``texts``."""
        packed = asked.groupBy(F.pmod(F.hash("query_id"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("query_id", "word", "times", "floor_hits", "floor_ord")).alias("asked"))
        blocks = texts.select(F.col("block").alias("to")).distinct()
        return blocks.select("to", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack")).join(packed, "pack").select("to", "asked")

    def _best(self, texts: DataFrame, asked: DataFrame, packs: int, top_k: int) -> DataFrame:
        """query_id, id, ord, hits: of each block the best ``top_k`` texts of every query that are not below its floor."""
        hit = T.StructType([asked.schema["query_id"], self.texts.schema["id"], T.StructField("ord", T.LongType()), T.StructField("hits", T.LongType())])

        def answer(key: tuple, found: pa.Table, texts: pa.Table) -> pa.Table:
            asked = pa.chunked_array([c.flatten() for c in found.column("asked").chunks], found.schema.field("asked").type.value_type).combine_chunks()
            names = ["query_id", "id", "ord", "hits"]
            query, out = asked.field("query_id").dictionary_encode(), []
            if texts.num_rows and len(asked):
                texts = texts.sort_by("ord")
                ords, rows = texts.column("ord").to_numpy(), texts.num_rows
                words = asked.field("word").dictionary_encode()
                word, text = _held(texts.column("haystack").combine_chunks(), words.dictionary.to_pylist())
                of, wanted, times = query.indices.to_numpy(), words.indices.to_numpy(), asked.field("times").to_numpy()
                floors = [np.zeros(len(query.dictionary), np.int64) for _ in range(2)]
                for floor, name in zip(floors, ("floor_hits", "floor_ord"), strict=True):
                    floor[of] = asked.field(name).to_numpy()
                order = np.argsort(of, kind="stable")
                of, wanted, times = of[order], wanted[order], times[order]
                step = max(1, CELLS // rows)
                for low in range(0, len(query.dictionary), step):
                    high = min(low + step, len(query.dictionary))
                    mine = slice(*np.searchsorted(of, [low, high]))
                    hits = _counted(word, text, rows, of[mine] - low, wanted[mine], times[mine], high - low)
                    least, last = (f[low:high, None] for f in floors)
                    may = (hits > least) | ((hits == least) & (hits > 0) & (ords <= last))
                    for q in np.flatnonzero(may.any(axis=1)):
                        some = np.flatnonzero(may[q])
                        if len(some) > top_k:
                            some = some[hits[q, some] >= np.partition(hits[q, some], len(some) - top_k)[len(some) - top_k]]
                        # The texts are in order, so the sort by hits leaves ties by ord.
                        best = some[np.argsort(-hits[q, some], kind="stable")[:top_k]]
                        out.append((np.full(len(best), low + q), best, hits[q, best].astype(np.int64)))
            of, best, hits = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            return pa.table([query.dictionary.take(pa.array(of)), texts.column("id").take(pa.array(best)), texts.column("ord").take(pa.array(best)), pa.array(hits, pa.int64())], names=names)

        return self._sent(texts, asked, packs).groupBy("to").cogroup(texts.groupBy("block")).applyInArrow(answer, hit)

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """query_id, pos, id, score: the best nodes of every query (query_id, query), as ``keyword_seeds`` has them for one.

        A block gets the words of all queries, so very large tables of queries are better searched in parts."""
        if top_k <= 0:
            return queries.select("query_id", F.lit(0).alias("pos"), F.lit(None).cast(self.texts.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).limit(0)
        said = queries.select("query_id", tokens(F.col("query")).alias("words"))
        asked = said.select("query_id", F.explode("words").alias("word")).groupBy("query_id", "word").agg(F.count("*").cast("int").alias("times"))
        packs = 1 + queries.count() // QUERY_ROWS
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "ord"))
        # The longest texts hold the most words, and the first ones win ties.
        places = self.texts.select("block", "pos", "ord", F.length("haystack").alias("chars"))
        leading = [places.orderBy(*by).limit(max(LEADING, top_k)).select("block", "pos") for by in ((F.desc("chars"), "ord"), ("ord",))]
        first = self.texts.join(F.broadcast(leading[0].union(leading[1]).distinct()), ["block", "pos"], "left_semi")
        none = [F.lit(0).cast("long").alias("floor_hits"), F.lit(0).cast("long").alias("floor_ord")]
        tried = self._best(first, asked.select("*", *none), packs, top_k)
        floors = tried.withColumn("rank", rank).filter(F.col("rank") == top_k).select("query_id", F.col("hits").alias("floor_hits"), F.col("ord").alias("floor_ord"))
        bounded = asked.join(floors, "query_id", "left").na.fill(0, ["floor_hits", "floor_ord"])
        top = self._best(self.texts, bounded, packs, top_k).withColumn("rank", rank).filter(F.col("rank") <= top_k)
        sizes = said.select("query_id", F.size("words").alias("n"))
        return top.join(sizes, "query_id").select("query_id", (F.col("rank") - 1).alias("pos"), "id", (F.col("hits") / F.greatest(F.col("n"), F.lit(1))).alias("score"))
