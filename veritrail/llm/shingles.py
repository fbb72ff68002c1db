"""Vectorised word and shingle hashes over flat UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for ``size`` places at least; kept for the next call."""
    while len(_tables[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(int(base), len(_tables[k]), 1 << 64))
            _tables[k] = np.concatenate([_tables[k], _tables[k] * step])
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the n + 1 offsets of documents among them.

    A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = (total[stops] - total[starts]) * inverse[starts]
    hashes = mix(hashes + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a document, with document offsets.

    A document of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    counts = np.diff(offsets)
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(counts)), per_doc)
    first = np.arange(out_offsets[-1]) - out_offsets[doc] + offsets[doc]
    width = np.minimum(counts[doc], size)
    value = width.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    factor = 0x9FB21C651E98DF25
    for k in range(size):
        term = padded[first + k] * np.uint64(factor)
        value = value + np.where(width > k, term, np.uint64(0))
        factor = (factor * 0xD1342543DE82EF95 + 2) & 0xFFFFFFFFFFFFFFFF | 1
    return mix(value), out_offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, with document offsets."""
    hashes, bounds = shingle_hashes(*word_hashes(data, offsets), size)
    parts, sizes = [], np.zeros(len(bounds), np.int64)
    for i in range(len(bounds) - 1):
        own = hashes[bounds[i] : bounds[i + 1]]
        if len(own) > 1:
            own = np.sort(own)
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
