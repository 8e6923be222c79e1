"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

An Arrow string column is one byte buffer with offsets, so the words of a whole
slice of texts are found and hashed by a handful of array operations; no Python
object is made per word.  A hash is a polynomial over random byte values modulo
2**64 with a final mix.  Callers compare bytes or accept 64-bit collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1

SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@dataclass
class Tokens:
    """Words of consecutive texts: hashes, byte ranges in ``data``, word bounds and byte offsets of each text."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


class Splitter:
    """Splits texts into words at the bytes of ``delimiters`` (after A-Z became a-z if ``lower``)."""

    def __init__(self, delimiters: bytes, lower: bool = True):
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        inside = np.ones(256, dtype=bool)
        inside[list(delimiters)] = False
        self.fold = fold
        self.inside = inside[fold]
        self.values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, dtype=np.uint64)[fold]
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 65536)
            for name, base in (("powers", _ODD), ("inverses", _ODD_INVERSE)):
                table = np.full(n, base, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def tokens(self, column: pa.Array) -> Iterator[Tokens]:
        """The words of every text of an Arrow string column, null as empty, slice by slice."""
        data, offsets = text_bytes(column)
        for lo, hi in slices(offsets):
            yield self._slice(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def within(self, data: np.ndarray) -> np.ndarray:
        """Which bytes belong to words."""
        return self.inside[data]

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of texts at ``offsets`` of ``data`` begin and end, and the first word of each text."""
        n = len(data)
        inside = self.within(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:n]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)

    def _slice(self, first: int, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        n = len(data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return Tokens(first, data, none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64), offsets)
        self._grow(n + 1)
        starts, ends, bounds = self.edges(data, offsets)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts])
        return Tokens(first, data, hashes, starts, ends, bounds, offsets)

    def ranges(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges of words, each of fewer than two thousand."""
        self._grow(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


class LineSplitter(Splitter):
    """Lines instead of words, empty ones too; a text without characters has none."""

    def __init__(self) -> None:
        super().__init__(b"\n", lower=False)

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(data == 10)
        some = offsets[1:] > offsets[:-1]
        starts = np.sort(np.concatenate([offsets[:-1][some], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([offsets[1:][some], breaks]), kind="stable")
        lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + some
        return starts, ends, np.concatenate([[0], np.cumsum(lines)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts in them."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes together; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words, by its first word; runs may cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_STEP) + hashes[j : j + n]
    return mixed(total + np.uint64(k))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, sorted."""
    ordered = np.sort(values)
    keep = np.ones(len(ordered), dtype=bool)
    keep[1:] = ordered[1:] != ordered[:-1]
    return ordered[keep]


def shingle_sets(t: Tokens, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each text; fewer words are one shingle, none is none."""
    runs = grams(t.hashes, k)
    for lo, hi in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist()):
        if hi - lo >= k:
            yield distinct(runs[lo : hi - k + 1])
        else:
            yield grams(t.hashes[lo:hi], hi - lo) if hi > lo else runs[:0]
