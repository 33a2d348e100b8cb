"""Shingle sets of whole texts as 64-bit hashes, computed on the bytes of many texts at once with numpy."""

from __future__ import annotations

import functools

import numpy as np

from .common import SPACES

U = np.uint64
BLOCK = 1 << 22
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i up to BLOCK."""
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(BLOCK + 1, base, U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of at most BLOCK bytes."""
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers()
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * power[:len(data)], out=total[1:])
    return first, mix((total[end] - total[first]) * inverse[first] + (end - first).astype(U) * U(_BASE))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word; A-Z count as a-z. Blocks end at white
    space; a run of over BLOCK bytes without any is hashed piece by piece and chained."""
    at, first, hashes = 0, [], []
    open_word = False
    while at < len(data):
        stop = min(len(data), at + BLOCK)
        if stop < len(data):
            spaces = np.flatnonzero(_SPACE[data[at:stop]])
            stop = at + int(spaces[-1]) + 1 if len(spaces) else stop
        f, h = _block_words(data[at:stop])
        f = f + at
        if open_word and len(h) and f[0] == at:
            hashes[-1][-1] = mix(hashes[-1][-1:] * U(_INVERSE) + h[:1])[0]
            f, h = f[1:], h[1:]
        if len(h):
            first.append(f)
            hashes.append(h)
        open_word = not _SPACE[data[stop - 1]]
        at = stop
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(first), np.concatenate(hashes)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; the whole
    sequence as one where it has fewer than k words; none without words."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    first, w = word_hashes(data)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(first, starts)
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * U(_INVERSE) + mix(w[j:j + n] + U(j))
    h = mix(h)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= k:
            out.append(np.unique(h[lo:hi - k + 1]))
        elif hi > lo:
            s = U(hi - lo)
            for x in w[lo:hi]:
                s = mix(np.array([s * U(_INVERSE) + x], U))[0]
            out.append(np.array([s], U))
        else:
            out.append(np.zeros(0, U))
    return out
