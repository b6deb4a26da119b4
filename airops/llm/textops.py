"""Numpy helpers on batches of texts: word and shingle hashes, byte hashes.

All hashes are 64-bit and stable across processes and machines, so that they
may be shuffled on. Texts are handled in slices of bounded bytes; a text is
never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

#: The white space that separates words: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one vectorised step handles (a longer text is a step of its own).
STEP_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 4096)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * STEP_BYTES:  # a very long text's table is not kept
            _powers[base] = have
    return have[:n]


class ByteHash:
    """Hashes of any byte range of a buffer, equal for equal bytes wherever they stand."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self._inverse = _power_table(_BASE_INVERSE, n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * _power_table(_BASE, n), out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


#: Bytes beyond which a word is hashed by blake2b instead of eight bytes at a time.
LONG_WORD = 256
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range: each eight bytes are scrambled into it in turn, so
    that no pattern inside a word makes two words agree (words of up to eight bytes
    and one length never do)."""
    lanes = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, dtype=np.uint8)]),
                       strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * _U(0x2545F4914F6CDD1D))
    who = np.flatnonzero(size <= LONG_WORD)
    at, left = start[who], size[who]
    while len(who):
        out[who] = mix(out[who] ^ (lanes[at] & _LANE_MASK[np.minimum(left, 8)]))
        more = left > 8
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return out


def steps(texts: Sequence[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``limit`` bytes each, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if len(texts) > lo:
        yield lo, len(texts)


class Words:
    """The words of some texts: ``hash`` in text order, text ``i`` owning
    ``first[i]:first[i + 1]``; ``start`` and ``end`` are byte offsets in ``buf``,
    where text ``i`` begins at ``at[i]``."""

    def __init__(self, texts: Sequence[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        space = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.at)
        self.hash = word_hashes(self.buf, self.start, self.end)


def windows_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values (order matters)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= _U(_BASE)
        out += h[j:j + n]
    return mix(out + _U(width))


def shingles(w: Words, i: int, width: int = 5, every: np.ndarray | None = None) -> np.ndarray:
    """The shingle hashes of text ``i`` in order; a text with fewer words has its
    whole sequence as one. ``every``: ``windows_hash(w.hash, width)`` if at hand."""
    lo, hi = w.first[i], w.first[i + 1]
    if hi - lo < width:
        return windows_hash(w.hash[lo:hi], hi - lo) if hi > lo else np.zeros(0, dtype=np.uint64)
    every = windows_hash(w.hash[lo:hi], width) if every is None else every[lo:hi - width + 1]
    return every


def as_bytes(column, fold: bool = False) -> list[bytes]:
    """UTF-8 of a pandas text column, null as empty; ``fold`` lower-cases A-Z."""
    out = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]
    return [t.lower() for t in out] if fold else out
