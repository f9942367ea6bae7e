"""Vectorised word splitting and hashing on Arrow string columns (executor side).

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).  UTF-8 never
uses those bytes inside a character, so bytes and characters give the same words.  Everything
works on the column's own buffer in numpy; no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: Random constants of the hash functions, made from one seed.
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_BASES = [int(x) | 1 for x in _RNG.integers(0, 2**64, 4, dtype=U64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = 1 << (n - 1).bit_length()
        base = _BASES[which]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(n, b, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _POWERS[which] = (both[0], both[1])
    return have


def _sums(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(which, max(1, len(values)))[0][: len(values)], out=out[1:])
    return out


@dataclass
class Words:
    """Words of a run of texts: ``hash`` per word, ``first`` (len(texts) + 1) word positions."""

    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each; a longer text is a range of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def words(texts: pa.Array, lower: bool = False) -> Words:
    """64-bit word hashes of every text, in order; ``lower`` folds A-Z."""
    data, offsets = buffers(texts)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part = data[lo:hi]
        if not len(part):
            continue
        inside = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[a : b + 1] - lo] = True
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = _sums(_BYTE[_LOWER[part] if lower else part], 0)
        inverse = _powers(0, len(part))[1]
        hashes.append(mix64((sums[end] - sums[start]) * inverse[start] ^ ((end - start).astype(U64) << U64(56))))
        where = np.searchsorted(start, offsets[a : b + 1] - lo)
        counts[a:b] = np.diff(where)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=first[1:])
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, U64), first)


def windows(w: Words, size: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid): at each word position the hash of ``size`` words from there; valid where they lie in one text."""
    n = len(w.hash)
    valid = np.zeros(n, bool)
    if n:
        left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)
        valid = left >= size
    if n < size:
        return np.zeros(n, U64), valid
    out = np.zeros(n, U64)
    step = 1 << 19
    for a in range(0, n - size + 1, step):
        part = w.hash[a : a + step + size - 1]
        sums = _sums(part, which)
        m = len(part) - size + 1
        out[a : a + m] = mix64((sums[size:] - sums[:-size]) * _powers(which, len(part))[1][:m])
    return out, valid
