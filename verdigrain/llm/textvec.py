"""Vectorised words and hashes over the bytes of many texts at once.

A word is a run of digits, ASCII letters (lower-cased first) and anything that isn't ASCII.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that are kept; longer tables are made each time.
_KEPT = 1 << 20


def _tables(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) >= n:
        return _powers
    size, made = 1 << max(12, int(n - 1).bit_length()), []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if size <= _KEPT:
        _powers[:] = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of units that doesn't depend on where the span stands."""
    power, inverse = _tables(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * power[: len(units)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts, and each text's first word's number (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of runs of `width` words; fewer words are one run of all of them."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    value = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        value = value * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(value)]
    return np.unique(mixed(value))


def same_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of two arrays are equal, pair by pair; no span is empty."""
    if not len(size):
        return np.zeros(0, bool)
    stop = np.cumsum(size)
    inner = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
    differ = a[np.repeat(a_at, size) + inner] != b[np.repeat(b_at, size) + inner]
    return ~np.logical_or.reduceat(differ, stop - size)


class Words:
    """Numbers for words by their bytes: equal numbers are equal words, whatever their hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; words are compared in bulk with the first of their hash."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        whole, size = data.tobytes(), ends - starts
        number = lambda k: self.known.setdefault(whole[starts[k] : ends[k]], len(self.known))
        found = np.fromiter(map(number, one.tolist()), np.int64, len(one))[which]
        same = size == size[one][which]
        same[same] = same_spans(data, starts[same], data, starts[one][which[same]], size[same])
        for k in np.flatnonzero(~same).tolist():
            found[k] = number(k)
        return found


def numbered_shingles(numbers: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of `width` words at every word of texts, equal for equal runs only, and where each text's begin.

    Pairs of numbers are numbered anew, then pairs of those, so that no product overflows.
    """
    counts = np.maximum(np.diff(first) - width + 1, 0)
    stops = np.cumsum(counts)
    at = np.repeat(first[:-1] - (stops - counts), counts) + np.arange(int(stops[-1]) if len(stops) else 0)
    edges = np.concatenate([[0], stops])
    if not len(at):
        return np.zeros(0, np.int64), edges
    value, long = numbers, 1
    while long < width:
        step = min(long, width - long)
        n = len(value) - step
        value = np.unique(value[:n] * (int(value.max()) + 1) + value[step : step + n], return_inverse=True)[1]
        long += step
    return value[at], edges
