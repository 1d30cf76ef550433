"""Vectorised words and word n-grams of a batch of texts, as 64-bit hashes.

All texts of a batch lie in one byte array; words, n-grams and sliding minima are found with a few
NumPy passes over it, so a text of any length costs the same per byte. A text is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are taken together; one longer text makes a block of its own.
BLOCK = 4 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def alphanumeric() -> tuple[np.ndarray, bool]:
    """Words of digits, letters and non-ASCII characters; A-Z are lower-cased."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    return inside, True


def spaced() -> tuple[np.ndarray, bool]:
    """Words between ASCII white space, unchanged."""
    inside = np.ones(256, bool)
    inside[0x20] = inside[0x09:0x0E] = False
    return inside, False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = (int(base), 0)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n > 4 * BLOCK:
            return have  # not kept: memory goes back after a very long text
        _POWERS[key] = have
    return have[:n]


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """The polynomial hash of values[start:end], modulo 2**64, for many spans at once."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts]


@dataclass
class Words:
    """Words of some texts: bytes [start, end) of `data`, hash; text i has words first[i]:first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, n: int, second: bool = False) -> np.ndarray:
        """Hash of the n words from each word on; the last n - 1 of a text run into the next text."""
        size = len(self.hash)
        if size < n:
            return np.zeros(0, np.uint64)
        at = np.arange(size - n + 1)
        step = _BASE if second else _STEP
        return mix(_spans(self.hash, at, at + n, step) + np.uint64(n))

    def starts_of(self, n: int) -> np.ndarray:
        """Word positions from which n words of the same text follow."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hash))
        return np.flatnonzero(left >= n)


def find(data: np.ndarray, bounds: np.ndarray, kind: tuple[np.ndarray, bool]) -> Words:
    """data: bytes of the texts one after another; bounds: their borders, one more than texts."""
    inside, lower = kind
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[0x41:0x5B] += 32
        data = table[data]
    mask = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = mask[:-1]
    cut = bounds[:-1][np.diff(bounds) > 0]
    before[cut] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = mask[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    hashes = mix(_spans(_VALUES[data], start, end, _BASE)) if len(start) else np.zeros(0, np.uint64)
    return Words(data, start, end, hashes, np.searchsorted(start, bounds))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, borders) of a text column, about `size` bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, places, content = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(places, places[row] + size, "right")) - 1)
        last = min(last, len(column))
        yield row, last, content[places[row] : places[last]], places[row : last + 1] - places[row]
        row = last


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of values[i : i + width], the first of equals, for every i."""
    best, where = values[: len(values) - width + 1].copy(), np.arange(len(values) - width + 1)
    for j in range(1, width):
        other = values[j : j + len(best)]
        smaller = other < best
        best[smaller] = other[smaller]
        where[smaller] = np.flatnonzero(smaller) + j
    return where
