"""Hashed character n-grams of whole texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that one vectorised step handles (a longer text is a step of its own).
STEP_CHARS = 1 << 16
_MULTIPLIER = np.uint32(0x9E3779B1)


def hashed(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of each run of ``size`` code points."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = np.full(n, size, dtype=np.uint32)
    for j in range(size):
        h *= _MULTIPLIER
        h ^= codes[j:j + n]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def buckets(texts: Sequence[str], sizes: Sequence[int], bits: int,
            step: int = STEP_CHARS) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For ranges of texts: (first text, past last, [(text of each n-gram,
    its bucket)] for each size). A text is padded by a space at both ends;
    n-grams never cross texts."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo + 1, len(texts[lo])
        while hi < len(texts) and chars + len(texts[hi]) <= step:
            chars += len(texts[hi])
            hi += 1
        part = [f" {t} " for t in texts[lo:hi]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) for t in part])
        owner = np.repeat(np.arange(lo, hi), np.diff(ends, prepend=0))
        out = []
        for size in sizes:
            h = hashed(codes, size, bits)
            whole = owner[:len(h)] == owner[size - 1:size - 1 + len(h)]
            out.append((owner[:len(h)][whole], h[whole]))
        yield lo, hi, out
        lo = hi
