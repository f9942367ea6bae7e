"""Golomb-coded sets: sorted whole numbers as the gaps between them, in a Golomb code whose parameter is a power of two."""

from __future__ import annotations

import math

import numpy as np


def parameter(values: int, width: int) -> int:
    """Low bits of a gap that are written as they are, for so many values spread evenly over ``width``."""
    return max(0, int(math.log2(max(1.0, width / max(1, values) * math.log(2)))))


def encode(sorted_values: np.ndarray, width: int) -> bytes:
    """Distinct sorted values in [0, width): their count, the gaps' quotients in unary, then the remainders."""
    n = len(sorted_values)
    k = parameter(n, width)
    gaps = np.diff(sorted_values.astype(np.int64), prepend=np.int64(-1)) - 1
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    rests = (gaps[:, None] >> np.arange(k) & 1).astype(np.uint8)
    head = np.array([n, len(unary)], "<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rests.ravel()).tobytes()


def decode(blob: bytes, width: int) -> np.ndarray:
    """The values again."""
    n, length = np.frombuffer(blob, "<i8", 2).tolist()
    k = parameter(n, width)
    raw = np.frombuffer(blob, np.uint8, offset=16)
    cut = -(-length // 8)
    ends = np.flatnonzero(np.unpackbits(raw[:cut], count=length))
    rests = np.unpackbits(raw[cut:], count=n * k).reshape(n, k).astype(np.int64) << np.arange(k)
    gaps = (np.diff(ends, prepend=-1) - 1 << k) + rests.sum(axis=1)
    return np.cumsum(gaps + 1) - 1
