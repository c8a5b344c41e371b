"""Vectorised word shingles: 64-bit hashes of five-word windows of whole texts.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased
(other letters stay). A document's set holds the hashes of its distinct five-word
windows; with one to four words, of the whole sequence; without words it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1 at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each row's first word, with the total at the end).

    Work arrays cover ``most`` bytes at a time, cut where a word starts."""
    gap = _GAP[raw]
    begins = ~gap
    begins[1:] &= gap[:-1]
    inside = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[inside] |= ~gap[inside]
    starts = np.flatnonzero(begins)
    # a word ends at the next gap or the next row's start, whichever comes first
    stops = np.concatenate([np.flatnonzero(gap), offsets[1:]])
    stops.sort(kind="stable")
    ends = stops[np.searchsorted(stops, starts, side="right")]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        lo, hi = int(starts[at]), int(ends[end - 1])
        pw, ipw = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((_FOLD[raw[lo:hi]].astype(np.uint64) + np.uint64(1)) * pw[: hi - lo], out=sums[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mixed((sums[e] - sums[s]) * ipw[s] + (e - s).astype(np.uint64))
        at = end
    return out, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each row."""
    words, first = word_hashes(raw, offsets)
    n = len(words)
    spans = np.zeros(max(0, n - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH):
        spans += words[k : k + len(spans)] * _STEP[k]
    spans = mixed(spans)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield np.unique(spans[a : b - WIDTH + 1])
        elif b > a:
            x = words[a:b] * _STEP[: b - a]
            yield mixed(np.array([x.sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
