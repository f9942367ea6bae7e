"""Operator 9: exact Jaccard join of shingle sets, by partitioning the universe of shingles.

A document's set is its distinct ``SHINGLE``-word shingles.  Two sets R and S with
|S| <= |R| and Jaccard similarity of 3/4 or more differ in at most H = floor((|R| + |S|) / 7)
shingles, and |S| >= 3/4 |R|.  Sizes are cut in bands that grow by 4/3, so a partner lies in the
same band or in the next.  Each band cuts the universe of shingle hashes in more segments than H
can be for its sets and any larger partner; a set's subset in a segment is its signature there.

Pigeonhole with cost-based allocation: give segment i of R a number v_i of 0 (skipped), 1 (equal
subsets) or 2 (subsets that differ in one shingle at most).  If the v_i add up to H + 1, a
partner must meet one of them.  Every set is indexed by the segments of its band, and in every
``NEAR``-th segment by the one-deletion neighbourhood of its subset too.  R, as the larger one,
probes by the segments of its own band and of the band below, in each the cheapest units that add
up, where a unit's cost is the length of the list it meets.  Subsets of frequent passages, empty
subsets and other hot lists are thus skipped as long as others suffice, and none is ever cut off.

Steps: (1) signatures are counted by the two-way exchange, and equal sets fall into classes with
one representative; (2) each representative is verified against the smallest document it shares
most of a few signatures with, which joins groups of near copies by stars; (3) lists that are
probed and still meet two components go to a cluster, named by the list's document with the
smallest hash, which is the same for most lists of a group of copies; the documents of a cluster
are verified exactly by intersecting whole sets, a large cluster in pairs of blocks, of which those
within its main component are left out; only links that join components leave a block; (4)
components are closed over all links.

Null or blank text: an empty set, linked with nothing, its own component.  Null doc_id: counted,
but without links and with a null component and number of links.  Rows that repeat an id are one
node, with the links of all its texts (a document that links with two of them counts twice).  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import exchange as X
from graphloom.llm.common import dropped, written
from graphloom.llm.components import components
from graphloom.llm.substrings import doc_keys, text_of
from graphloom.llm.tokens import U64, mix64, windows, words

SHINGLE = 5
#: Similarity of NUMERATOR / DENOMINATOR or more links.
NUMERATOR, DENOMINATOR = 75, 100
#: One segment in NEAR has a one-deletion neighbourhood; one in SPARE is more than needed, so that hot ones can be skipped.
NEAR = 16
SPARE = 12
#: Segments, of each band a set is cut by, that choose the document it is verified against first.
LEAD = 4
#: Signatures that must name a leader before it is verified first.
NAMED = 2
#: Documents of a block in which a cluster is verified, and shingles compared at a time.
BLOCK = 1536
COLUMNS = 2048
#: Rows of two blocks, or texts, worked on at a time.
ROWS = 256
SETS, COUNTS, LEADERS, MIXED = 1, 2, 3, 4
_SIGN = U64(1 << 63)
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_DROPPED = 16
_KEEP = ~U64((1 << _DROPPED) - 1)


def band_edges() -> np.ndarray:
    """First size of every band: each is more than 4/3 of the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out, np.int64)


_EDGES = band_edges()


def most_differences(larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The most shingles in which two linked sets of these sizes differ."""
    return (larger + smaller) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def segments(band: np.ndarray) -> np.ndarray:
    """Segments by which sets of a band meet those of their own band and of the next; 1 if only equal sets link."""
    top = _EDGES[band + 1] - 1
    h = most_differences(np.minimum(_EDGES[band + 2] - 1, top * DENOMINATOR // NUMERATOR), top)
    return np.where(h > 0, h + 2 + h // SPARE, 1)


class Sets:
    """Sorted distinct shingle hashes of texts: ``of`` holds them all, ``first`` where each text's begin."""

    def __init__(self, texts: pa.Array, size: int = SHINGLE):
        w = words(texts, lower=True)
        hashes, valid = windows(w, size)
        counts = np.diff(w.first)
        short = {k: windows(w, k)[0] for k in set(counts[(counts > 0) & (counts < size)].tolist())}
        out, sizes = [], np.zeros(len(counts), np.int64)
        for i, (a, n) in enumerate(zip(w.first[:-1].tolist(), counts.tolist(), strict=True)):
            if n:
                got = np.unique(hashes[a : a + n - size + 1]) if n >= size else short[n][a : a + 1]
                out.append(got)
                sizes[i] = len(got)
        self.of = np.concatenate(out) if out else np.zeros(0, U64)
        self.sizes = sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each set."""
        both = []
        for salt in (_A, _B):
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(self.of ^ salt), dtype=U64)])
            both.append(mix64(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(U64)))
        return both[0], both[1]


class Signatures:
    """All index entries of some sets, ordered by document.

    Arrays per entry: sig, doc, kind (0: by the segments of the own band, 1: by those of the band
    below, as the larger one), near (entry of a one-deletion neighbourhood), unit (its segment,
    over all), no (its segment in the set), content (shingles in it)."""

    def __init__(self, sets: Sets, only: np.ndarray):
        docs = np.flatnonzero(only & (sets.sizes > 0))
        band = np.searchsorted(_EDGES, sets.sizes[docs], "right") - 1
        parts, base = [], 0
        self.segment_doc, self.segment_kind = [], []
        for kind in (0, 1):
            low = band - kind
            m = np.where(low >= 0, segments(np.maximum(low, 0)), 1)
            use = m > 1
            d, mm = docs[use], m[use]
            salt = low[use].astype(U64) * _B
            if not len(d):
                continue
            sizes = sets.sizes[d]
            at = np.repeat(sets.first[d] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            el = sets.of[at]
            row = np.repeat(np.arange(len(d)), sizes)
            seg = ((el >> U64(32)) * mm[row].astype(U64) >> U64(32)).astype(np.int64)
            offset = np.concatenate([[0], np.cumsum(mm)])
            place = offset[row] + seg
            total = int(offset[-1])
            n = np.bincount(place, minlength=total)
            bounds = np.concatenate([[0], np.cumsum(n)])
            mixed = mix64(el ^ _C)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mixed, dtype=U64)])
            subset = sums[bounds[1:]] - sums[bounds[:-1]]
            seg_row = np.repeat(np.arange(len(d)), mm)
            seg_no = np.arange(total) - offset[seg_row]
            where = salt[seg_row] + seg_no.astype(U64) * _A
            exact = mix64(mix64(subset) + n.astype(U64) * _C + where)
            near = np.flatnonzero((seg_no % NEAR == 0)[place])
            p = place[near]
            less = mix64(mix64(subset[p] - mixed[near]) + (n[p] - 1).astype(U64) * _C + where[p])
            for sig, r, unit, is_near, no in ((exact, seg_row, np.arange(total), False, seg_no), (less, row[near], p, True, seg_no[p])):
                parts.append((sig, d[r], np.full(len(sig), kind, np.int8), np.full(len(sig), is_near), base + unit, no, n[unit]))
            self.segment_doc.append(d[seg_row])
            self.segment_kind.append(np.full(total, kind, np.int8))
            base += total
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (U64, np.int64, np.int8, bool, np.int64, np.int64, np.int64)]
        order = np.argsort(cols[1], kind="stable")
        self.sig, self.doc, self.kind, self.near, self.unit, self.no, self.content = (c[order] for c in cols)
        self.first = np.searchsorted(self.doc, np.arange(len(sets.sizes) + 1))
        self.segment_doc = np.concatenate(self.segment_doc) if parts else np.zeros(0, np.int64)
        self.segment_kind = np.concatenate(self.segment_kind) if parts else np.zeros(0, np.int8)

    def allocate(self, cost: np.ndarray, sets: Sets) -> np.ndarray:
        """Per entry, whether its document probes it: the cheapest units that add up to H + 1.

        ``cost``: per entry, what its list would cost.  A document allocates for each band in which
        it may be the larger set.  A segment's second unit is never cheaper than its first."""
        units = len(self.segment_doc)
        plain = np.bincount(self.unit[~self.near], cost[~self.near], minlength=units)
        second = np.maximum(plain, np.bincount(self.unit[self.near], cost[self.near], minlength=units))
        has_second = np.zeros(units, bool)
        has_second[self.unit[self.near]] = True
        seg = np.concatenate([np.arange(units), np.flatnonzero(has_second)])
        price = np.concatenate([plain, second[has_second]])
        level = np.concatenate([np.zeros(units, np.int8), np.ones(int(has_second.sum()), np.int8)])
        group = self.segment_doc[seg] * 2 + self.segment_kind[seg]
        order = np.lexsort((seg, level, price, group))
        g = group[order]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        size = sets.sizes[self.segment_doc[seg[order]]]
        kind = self.segment_kind[seg[order]]
        below = _EDGES[np.searchsorted(_EDGES, size, "right") - 1] - 1
        smaller = np.where(kind == 0, size, np.minimum(size, below))
        # No set of the band below is large enough: nothing to probe there.
        need = np.where(DENOMINATOR * smaller >= NUMERATOR * size, most_differences(size, smaller) + 1, 0)
        taken = order[rank < need]
        chosen = np.zeros((2, units), bool)
        chosen[level[taken], seg[taken]] = True
        return np.where(self.near, chosen[1][self.unit], chosen[0][self.unit])


def _uniques(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their counts, smallest id, order, run)."""
    order, starts, run = X.runs(keys, stable=False)
    if not len(starts):
        return keys, np.zeros(0, np.int64), ids, order, run
    return keys[order[starts]], np.diff(np.append(starts, len(keys))), np.minimum.reduceat(ids[order], starts), order, run


def _back(values: np.ndarray, order: np.ndarray, run: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), values.dtype)
    out[order] = values[run]
    return out


class Batch:
    """What a batch asks first: its sets' fingerprints, its signatures, and a few for leaders."""

    def __init__(self, table: pa.Table, size: int):
        self.table = table
        self.sets = Sets(text_of(table), size)
        self.ids = doc_keys(table)
        known = table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        self.linked = known & (self.sets.sizes > 0)
        one, two = self.sets.prints()
        live = np.flatnonzero(self.linked)
        keys, _, least, order, run = _uniques(one[live], self.ids[live])
        self.live, self.classes = live, (order, run)
        self.print_keys, self.print_ids = keys, least
        first = order[np.searchsorted(run, np.arange(len(keys)))] if len(keys) else order
        self.print_more = two[live][first]
        # Of equal sets in the batch only the smallest id's first row has signatures.
        lead = np.zeros(len(self.ids), bool)
        if len(live):
            by = np.lexsort((self.ids[live][order], run))
            lead[live[order[by[np.searchsorted(run, np.arange(len(keys)))]]]] = True
        self.lead = lead
        self.signatures = Signatures(self.sets, lead)
        s = self.signatures
        self.sig_keys, self.sig_counts, _, self.sig_order, self.sig_run = _uniques(s.sig & _KEEP, self.ids[s.doc])
        self.led = np.flatnonzero(~s.near & (s.no < LEAD) & (s.content > 0))
        self.lead_keys, _, self.lead_ids, self.lead_order, self.lead_run = _uniques(s.sig[self.led], self.ids[s.doc[self.led]])

    def messages(self, batch: int, buckets: int):
        yield from X.questions(batch, SETS, buckets, self.print_keys, self.print_more, self.print_ids)
        yield from X.questions(batch, COUNTS, buckets, self.sig_keys, self.sig_counts, drop_bits=_DROPPED)
        yield from X.questions(batch, LEADERS, buckets, self.lead_keys, self.lead_ids)


def _answer(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    out = []
    keys, spans, rest = X.merged(table, SETS)
    if len(keys):
        more, ids = rest
        order = np.lexsort((more, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        least = np.empty(len(keys), U64)
        least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        out += [(b, SETS, bucket, X.pack(least[a:z])) for b, a, z in spans]
    keys, spans, rest = X.merged(table, COUNTS)
    if len(keys):
        order, starts, run = X.runs(keys)
        total = np.add.reduceat(rest[0].astype(np.int64)[order], starts)
        count = _back(np.where(total > 1, np.minimum(total, 65535), 0), order, run)
        out += [(b, COUNTS, bucket, X.pack(count[a:z])) for b, a, z in spans]
    keys, spans, rest = X.merged(table, LEADERS)
    if len(keys):
        order, starts, run = X.runs(keys)
        least = _back(np.minimum.reduceat(rest[0][order], starts), order, run)
        out += [(b, LEADERS, bucket, X.pack(least[a:z])) for b, a, z in spans]
    return X.rows(out)


FOUND = "batch int, doc_id long, n_shingles long, class_id long, leader long, hub boolean, entries binary, text string"


def _signed(ids: np.ndarray) -> np.ndarray:
    return (ids ^ _SIGN).view(np.int64)


def _found(table: pa.Table, got: dict, buckets: int, size: int, stars: bool) -> pa.Table:
    """A row per document; representatives with shared signatures carry their entries of lists that may be compared.

    For ``stars``, documents that have a leader or may be one keep their text."""
    b = Batch(table, size)
    n = len(b.ids)
    classes = b.ids.copy()
    answer = X.answers(got, SETS, b.print_keys, buckets)
    if answer:
        classes[b.live] = _back(answer[0], *b.classes)
    s = b.signatures
    answer = X.answers(got, COUNTS, b.sig_keys, buckets)
    costs = (_back(answer[0], b.sig_order, b.sig_run) if answer else np.zeros(0, U64)).astype(np.int64)
    active = np.zeros(n, bool)
    active[s.doc[costs > 0]] = True
    active &= b.lead & (classes == b.ids)
    leader, has, hub = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    answer = X.answers(got, LEADERS, b.lead_keys, buckets)
    if answer:
        docs, to = s.doc[b.led], _back(answer[0], b.lead_order, b.lead_run)
        own = np.bincount(docs[(to == b.ids[docs]) & (costs[b.led] > 0)], minlength=n)
        hub = (own >= NAMED) & active
        other = (to != b.ids[docs]) & active[docs]
        # The leader that most of a document's signatures name; of equals the smallest.
        order = np.lexsort((to[other], docs[other]))
        d, t = docs[other][order], to[other][order]
        if len(d):
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(d)))
            at = at[times >= NAMED]
            best = np.lexsort((t[at], -times[times >= NAMED], d[at]))
            dd = d[at][best]
            top = best[np.concatenate([[True], dd[1:] != dd[:-1]])] if len(dd) else best
            leader[d[at][top]] = _signed(t[at][top])
            has[d[at][top]] = True
    probes = s.allocate(costs, b.sets)
    wanted = np.flatnonzero((costs > 0) & (probes | (s.kind == 0)) & active[s.doc])
    wanted = wanted[np.lexsort((s.sig[wanted], s.doc[wanted]))]
    bounds = np.searchsorted(s.doc[wanted], np.arange(n + 1))
    keys, flags = s.sig[wanted], probes[wanted]
    blobs = [X.pack(X.deltas(keys[a:z]), X.pack_bits(flags[a:z])) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    null_id = ~table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    texts = pc.if_else(pa.array((has | hub) & stars), text_of(table), pa.scalar(None, pa.string()))
    return pa.table(
        [table.column("batch"), table.column("doc_id"), pa.array(b.sets.sizes, pa.int64()), pa.array(_signed(classes), pa.int64(), mask=null_id), pa.array(leader, pa.int64(), mask=~has), pa.array(hub), pa.array(blobs, pa.binary()), texts],
        names=["batch", "doc_id", "n_shingles", "class_id", "leader", "hub", "entries", "text"],
    )


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, probed) of the rows' entries."""
    rows, sigs, probed = [], [], []
    for i, blob in enumerate(table.column("entries").to_pylist()):
        keys, bits = X.unpack(blob)
        rows.append(np.full(len(keys), i))
        sigs.append(np.cumsum(keys, dtype=U64))
        probed.append(X.unpack_bits(bits, len(keys)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(probed)


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(U64) ^ _SIGN


def _ask_mixed(table: pa.Table, buckets: int) -> Iterator[tuple]:
    """Per list: its document with the smallest hash here, a component, whether it has several, and whether it is probed here."""
    row, sigs, probed = _entries(table)
    ids, comp = _unsigned(table.column("doc_id")), _unsigned(table.column("component"))
    order = np.lexsort((mix64(ids ^ _A)[row], sigs))
    keys = sigs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    c = comp[row][order]
    several = np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first) if len(first) else first
    asked = np.logical_or.reduceat(probed[order], first) if len(first) else first
    flags = several.astype(U64) | asked.astype(U64) << U64(1)
    yield from X.questions(table.column("batch")[0].as_py(), MIXED, buckets, keys[first], ids[row][order][first], c[first], flags)


def _answer_mixed(table: pa.Table) -> pa.Table:
    """Of lists that are probed and meet two components, the document with the smallest hash; it names a cluster."""
    bucket = table.column("bucket")[0].as_py()
    keys, spans, rest = X.merged(table, MIXED)
    if not len(keys):
        return X.rows([])
    ids, comp, flags = rest
    order = np.lexsort((mix64(ids ^ _A), keys))
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    c = comp[order]
    found = np.bitwise_or.reduceat(flags[order], first)
    several = (np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first)) | (found & U64(1) > 0)
    asked = several & (found & U64(2) > 0)
    flag, cluster = _back(asked.astype(U64), order, run), _back(np.where(asked, ids[order][first], U64(0)), order, run)
    return X.rows((b, MIXED, bucket, X.pack(flag[a:z], cluster[a:z])) for b, a, z in spans)


MEMBER = "cluster long, id long, component long"


def _members(table: pa.Table, got: dict, buckets: int) -> pa.Table:
    """A row for each cluster that a document is in."""
    row, sigs, _ = _entries(table)
    order, starts, run = X.runs(sigs, stable=False)
    answer = X.answers(got, MIXED, sigs[order[starts]] if len(starts) else sigs, buckets)
    doc, cluster = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if answer:
        flag, key = _back(answer[0], order, run) > 0, _signed(_back(answer[1], order, run))
        if flag.any():
            doc, cluster = np.unique(np.stack([row[flag], key[flag]]), axis=1)
    ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    return pa.table([pa.array(cluster, pa.int64()), pa.array(ids[doc], pa.int64()), pa.array(comp[doc], pa.int64())], names=["cluster", "id", "component"])


def _linked(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each of ``left`` links with each of ``right``; intersections are a product of the 0/1 matrix of the shared shingles."""
    n = len(sets)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        both += part[left] @ part[right].T
    out = np.zeros(both.shape, bool)
    for a in range(0, len(left), ROWS):
        common = both[a : a + ROWS].astype(np.int64)
        out[a : a + ROWS] = DENOMINATOR * common >= NUMERATOR * (sizes[left[a : a + ROWS], None] + sizes[None, right] - common)
    return out


def block_counts(linked: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, cluster: int, clusters: list[np.ndarray], copies: np.ndarray) -> np.ndarray:
    """Per document its links in this block pair, each to as many as there are copies of the other text.

    A pair counts in the first of the clusters that both are in, and not between rows of one id."""
    counted = linked & (label[left][:, None] != label[right][None, :])
    n = len(label)
    owner = np.repeat(np.arange(n), [len(c) for c in clusters])
    names = np.concatenate(clusters) if n else np.zeros(0, np.int64)
    owner, names = owner[names < cluster], names[names < cluster]
    _, column, times = np.unique(names, return_inverse=True, return_counts=True)
    several = times[column] > 1
    owner, column = owner[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        counted &= part[left] @ part[right].T == 0
    out = np.zeros(n, np.int64)
    for a in range(0, len(left), ROWS):
        some = left[a : a + ROWS]
        out[some] += counted[a : a + ROWS] @ copies[right]
        if left[0] != right[0]:
            out[right] += copies[some] @ counted[a : a + ROWS]
    return out


def block_links(ids: list[int], comps: list[int], block: list[int], sets: list[np.ndarray], cluster: int = 0, clusters: list[np.ndarray] | None = None, copies: list[int] | None = None) -> list[tuple]:
    """(a, b, null): links between documents of different components, as many as join them; of two blocks only those across.

    With ``clusters`` and ``copies`` of every document also (a, null, n): its links, see ``block_counts``."""
    sizes, side = np.array([len(x) for x in sets]), np.array(block)
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    label = np.unique(comps, return_inverse=True)[1]
    linked = _linked(sizes, sets, left, right)
    out: list[tuple] = []
    if clusters is not None:
        numbers = block_counts(linked, label, left, right, cluster, clusters, np.array(copies, np.int64))
        out += [(ids[i], None, int(numbers[i])) for i in np.flatnonzero(numbers)]
    for i, doc in enumerate(left.tolist()):
        while len(other := right[linked[i] & (label[right] != label[doc])]):
            out.append((ids[doc], ids[int(other[0])], None))
            label[label == label[other[0]]] = label[doc]
    return out


LINK = "a long, b long, n long"


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1, 2)], names=["a", "b", "n"])


def _verify(size: int, counting: bool):
    """Links of block pairs whose rows follow each other, and their numbers if ``counting``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> list[tuple]:
            if len({r[1] for r in held}) < 2:
                return []
            more = (key[0], [np.array(r[3], np.int64) for r in held], [r[4] for r in held]) if counting else ()
            return block_links([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], [r[-1] for r in held], *more)

        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            sets = Sets(batch.column("text"), size)
            cols = [batch.column(c).to_pylist() for c in ("cluster", "p", "q", "doc_id", "component", "b", *(["clusters", "copies"] if counting else []))]
            for i, (cluster, p, q, *row) in enumerate(zip(*cols, strict=True)):
                if (cluster, p, q) != key:
                    out += done()
                    key, held = (cluster, p, q), []
                held.append((*row, sets.of[sets.first[i] : sets.first[i + 1]].copy()))
            if out:
                yield _links(out)
        out = done()
        if out:
            yield _links(out)

    return run


def cluster_links(members: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b, null) within clusters: as many as join the components that link.

    ``members``: cluster, id, component; ``texts``: doc_id, text.  Where members have the columns
    clusters (of the id, all of them) and copies (of its text), also rows (a, null, n) that add up
    to each id's number of links.  A cluster beyond BLOCK documents is
    compared in pairs of blocks.  The blocks of its largest component meet only those of others."""
    per = members.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster")
    # Written, so that its size is known: a small table is broadcast and the members stay where they are.
    large = per.agg(F.sum("n").alias("_n"), F.max("n").alias("_main"), F.max_by("component", "n").alias("main")).filter(F.col("_n") > BLOCK)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    large = written(large.select("cluster", "main", blocks(F.col("_main")).alias("mains"), blocks(F.col("_n") - F.col("_main")).alias("others")), "jaccard-large")
    cut = members.join(large, "cluster", "left").withColumns({"mains": F.coalesce("mains", F.lit(0)), "others": F.coalesce("others", F.lit(1)), "is_main": F.coalesce(F.col("component") == F.col("main"), F.lit(False))})
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    cut = cut.withColumn("b", block + F.when(F.col("is_main"), F.lit(0)).otherwise(F.col("mains")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)))
    counting = "clusters" in members.columns
    more = ["clusters", "copies"] if counting else []
    pairs = cut.select("cluster", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"), "b", "id", "component", *more)
    rows = texts.join(pairs, F.col("doc_id") == F.col("id")).select("cluster", "p", "q", "b", "doc_id", "component", "text", *more)
    return rows.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q").mapInArrow(_verify(size, counting), LINK)


def _verify_stars(size: int):
    """Links of followers with the hubs that stand before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: list[np.ndarray] = []
        key = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            sets = Sets(batch.column("text"), size)
            for i, (hub, salt, follower, doc) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("star", "salt", "follower", "doc_id")], strict=True)):
                if (hub, salt) != key:
                    key, hubs = (hub, salt), []
                own = sets.of[sets.first[i] : sets.first[i + 1]]
                if not follower:
                    hubs.append(own.copy())
                    continue
                for other in hubs:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if DENOMINATOR * both >= NUMERATOR * (len(own) + len(other) - both):
                        out.append((doc, hub, None))
                        break
            if out:
                yield _links(out)

    return run


def star_links(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) of documents with their leaders.  A leader goes to one place for each BLOCK followers."""
    followers = found.filter("leader is not null").select(F.col("leader").alias("star"), "doc_id", "text")
    stars = written(followers.groupBy("star").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "jaccard-leaders")
    hubs = found.filter("hub").join(stars, F.col("doc_id") == F.col("star")).select("star", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("follower"), "doc_id", "text")
    large = stars.filter("salts > 1").select(F.col("star").alias("_star"), "salts")
    salted = followers.join(large, F.col("star") == F.col("_star"), "left")
    rows = salted.select("star", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(True).alias("follower"), "doc_id", "text")
    return hubs.union(rows).repartition("star", "salt").sortWithinPartitions("star", "salt", "follower").mapInArrow(_verify_stars(size), LINK)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id.

    With ``count_links`` also n_links, the number of documents it links with (its copies included).
    Then no pair is left out because its components are joined already: there are no stars, and
    every probed list of several documents is verified whole."""
    plan = X.plan(docs)
    buckets = plan.gates
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = X.in_batches(given, plan.batches, "doc_id", "text")

    def ask_first(table: pa.Table) -> pa.Table:
        return X.rows(Batch(table, size).messages(table.column("batch")[0].as_py(), buckets))

    def find(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _found(table, X.by_batch(replies), buckets, size, not count_links)

    counted = plan.ask(held.groupBy("batch").applyInArrow(ask_first, X.MESSAGE), _answer, {COUNTS: _DROPPED})
    found = written(held.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(find, FOUND), "jaccard-found")
    none = docs.sparkSession.createDataFrame([], LINK)
    stars = none if count_links else written(star_links(found, size), "jaccard-stars")
    placed = components(stars).withColumnRenamed("id", "_id")
    listed = found.filter("entries is not null").select("batch", "doc_id", "entries")
    located = listed.join(placed, F.col("doc_id") == F.col("_id"), "left").select("batch", "doc_id", "entries", F.coalesce("component", "doc_id").alias("component"))

    def ask_again(table: pa.Table) -> pa.Table:
        return X.rows(_ask_mixed(table, buckets))

    def enter(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _members(table, X.by_batch(replies), buckets)

    mixed = plan.ask(located.groupBy("batch").applyInArrow(ask_again, X.MESSAGE), _answer_mixed)
    members = written(located.groupBy("batch").cogroup(mixed.groupBy("batch")).applyInArrow(enter, MEMBER), "jaccard-members")
    within = members
    if count_links:
        classes = found.filter("class_id is not null and n_shingles > 0").select("class_id", "doc_id").distinct().groupBy("class_id").agg(F.count("*").alias("copies"))
        classes = written(classes.filter("copies > 1"), "jaccard-classes")
        # No more names than the document has lists.
        names = members.groupBy("id").agg(F.collect_set("cluster").alias("clusters"))
        within = members.join(names, "id").join(classes, F.col("id") == F.col("class_id"), "left").select("cluster", "id", "component", "clusters", F.coalesce("copies", F.lit(1)).alias("copies"))
    links = written(stars.union(cluster_links(within, given, size)), "jaccard-links")
    dropped(members, *([] if count_links else [stars]))
    reached = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("id", "_id")
    out = found.select("doc_id", "n_shingles", "class_id").join(reached, F.col("class_id") == F.col("_id"), "left")
    more = []
    if count_links:
        counts = links.filter("n is not null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
        out = out.join(counts, F.col("class_id") == F.col("_a"), "left").join(classes.withColumnRenamed("class_id", "_c"), F.col("class_id") == F.col("_c"), "left")
        more = [F.when(F.col("class_id").isNotNull(), F.coalesce("_n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")]
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"), *more)


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest id.

    Of rows that repeat an id one stays.  Rows without an id all stay."""
    found = written(near_duplicates(docs.select("doc_id", "text"), size).select("doc_id", "component_id").filter("doc_id is not null"), "jaccard-components")
    leave = found.filter("component_id != doc_id").select("doc_id")
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "jaccard-repeated")
    stay = docs.join(leave, "doc_id", "left_anti").select(*docs.columns)
    single = stay.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return single.union(stay.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, count_links=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
