"""Vectorised hashing of words and word shingles over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the index of each row's first word (and the end).

    Works on pieces of half a MB, cut between words, so that long texts need no more memory."""
    starts_row = np.zeros(len(raw) + 1, bool)
    starts_row[at] = True
    hashes, places, a = [], [], 0
    while a < len(raw):
        b = min(len(raw), a + _CHUNK)
        if b < len(raw):
            ok = np.flatnonzero(_SPACE[raw[a + 1 : b + 1]] | starts_row[a + 1 : b + 1])
            if len(ok):
                b = a + 1 + int(ok[-1])
            else:  # one long word
                while b < len(raw) and not _SPACE[raw[b]] and not starts_row[b]:
                    b += 1
        x = raw[a:b]
        solid = ~_SPACE[x]
        first = starts_row[a:b].copy()
        first[0] = True
        before = np.zeros(len(x), bool)
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (first | ~before))
        after = np.ones(len(x), bool)
        after[:-1] = ~solid[1:] | first[1:]
        end = np.flatnonzero(solid & after)
        if len(start):
            p, q = _power(len(x) + 1)
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((_LOWER[x] if lower else x).astype(np.uint64) * p[: len(x)], out=total[1:])
            h = (total[end + 1] - total[start]) * q[start]
            hashes.append(mix(h + (end - start + 1).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
            places.append(start + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), at, side="left")


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its 5-word shingles (of its only sequence if shorter)."""
    w, row = words(raw, at)
    n = len(w)
    s = np.zeros(0, np.uint64)
    if n >= 5:
        s = w[: n - 4] * _MULT[0]
        for k in range(1, 5):
            s += w[k : n - 4 + k] * _MULT[k]
        s = mix(s)
    for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
        if b - a >= 5:
            x = np.sort(s[a : b - 4])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield mix((w[a:b] * _MULT[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
