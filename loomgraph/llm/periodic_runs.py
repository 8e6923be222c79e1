"""Periodic runs of words inside a text, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal) and at
least ``max(LEAST_WORDS, LEAST_EXPONENT * q)`` words that cannot be extended.

1.  Words become numbers; prefix doubling sorts all suffixes.  Every doubling names
    the blocks of 2, 4, 8 ... words, and the places of a block are one interval of
    the suffix array.
2.  A wavelet tree over the suffix array answers range successors: the next place
    of a block at or after a position.  For a run of period q, the power of two b
    with ``(2b - 1) / 3 <= q <= (4b - 2) / 3`` is such that the run contains a block
    at a multiple of b which stands again q words later.  So each block asks for its
    places in the window of those distances.
3.  The window is no longer than the block, so these places form an arithmetic
    progression.  One or two give candidate periods themselves.  Three or more have
    the block's own period as their difference; then the stretch of that period
    around the block breaks inside the run, and the distance to where the stretch of
    the progression breaks is the only candidate.
4.  A candidate is extended in both directions by the names of the blocks, longest
    first.  Of equal stretches the one of the smallest period stays.

Texts are worked on in slices of about a megabyte, a longer text alone; a slice of n
words takes O(n log n) steps of array operations and O(n log n) memory, whatever it
holds.  Nothing is shuffled.  A null or empty text, or one of white space only, has
no words and no runs, and collapses to an empty text.  Words are compared by 64-bit
hashes.  Repeated rows get equal results, and columns of the input cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.rows import map_texts
from loomgraph.llm.wordhash import SPACES, Splitter, Tokens, mixed

LEAST_WORDS = 6
LEAST_EXPONENT = 4
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Wavelet:
    """A wavelet tree over numbers below 2**bits, one level an array; all queries take arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            high = (values >> bit & 1).astype(bool)
            low_before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~high, out=low_before[1:])
            self.levels.append((bit, low_before))
            values = np.concatenate([values[~high], values[high]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of ``[lo, hi)`` are less than ``bound``."""
        count = np.zeros(len(lo), dtype=np.int64)
        for bit, low_before in self.levels:
            lows, low_ends = low_before[lo], low_before[hi]
            up = (bound >> bit & 1).astype(bool)
            count += np.where(up, low_ends - lows, 0)
            lo = np.where(up, low_before[-1] + lo - lows, lows)
            hi = np.where(up, low_before[-1] + hi - low_ends, low_ends)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The number of ``[lo, hi)`` that has ``n`` smaller ones there."""
        value = np.zeros(len(lo), dtype=np.int64)
        for bit, low_before in self.levels:
            lows, low_ends = low_before[lo], low_before[hi]
            up = n >= low_ends - lows
            n = np.where(up, n - (low_ends - lows), n)
            value |= up.astype(np.int64) << bit
            lo = np.where(up, low_before[-1] + lo - lows, lows)
            hi = np.where(up, low_before[-1] + hi - low_ends, low_ends)
        return value


class Blocks:
    """Names of all blocks of 2**k numbers: equal blocks have the name that is the start of their interval."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, n: int):
        """``keys`` of the words at ``places`` among ``n``; every other place is unlike all others."""
        order = np.argsort(keys, kind="stable")
        self.suffixes = np.concatenate([places[order], np.setdiff1d(np.arange(n), places, assume_unique=True)])
        name = np.empty(n, dtype=np.int32)
        name[self.suffixes] = np.arange(n, dtype=np.int32)
        self.names, self.queries, self.kept = [], [], None
        live, ordered, k = np.arange(len(keys)), keys[order], 0
        while True:
            new = np.ones(len(live), dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            firsts = np.flatnonzero(new)
            sizes = np.diff(firsts, append=len(live))
            name[self.suffixes[live]] = np.repeat(live[firsts], sizes)
            self.names.append(name)
            again = np.repeat(sizes > 1, sizes)
            size = np.repeat(sizes, sizes)[again]
            live = live[again]
            at = self.suffixes[live]
            if k:
                if self.kept is None:
                    self.kept = live
                aligned = at & (1 << k) - 1 == 0
                self.queries.append((1 << k, at[aligned], name[at[aligned]], size[aligned]))
            if not len(live):
                break
            pairs = name[at].astype(np.int64) * n + name[at + (1 << k)]
            order = np.argsort(pairs, kind="stable")
            ordered = pairs[order]
            self.suffixes[live] = at[order]
            name = name.copy()
            k += 1

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from ``a`` on equal those from ``b`` on."""
        start = a
        for k in range(len(self.names) - 1, -1, -1):
            equal = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a, b = a + equal, b + equal
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before ``a`` equal those before ``b``; ``a`` is less than ``b``."""
        start = a
        for k in range(len(self.names) - 1, -1, -1):
            before, other = a - (1 << k), b - (1 << k)
            equal = (before >= 0) & (self.names[k][np.maximum(before, 0)] == self.names[k][np.maximum(other, 0)])
            step = equal.astype(np.int64) << k
            a, b = a - step, b - step
        return start - a


def _candidates(blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of stretches that may be runs."""
    places, periods = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if blocks.kept is None or not len(blocks.kept):
        return places[0], periods[0]
    n = len(blocks.suffixes)
    tree = Wavelet(blocks.suffixes[blocks.kept], n.bit_length())
    for length, at, name, size in blocks.queries:
        lo = np.searchsorted(blocks.kept, name)
        hi = lo + size
        nearest = at + -(-(2 * length - 1) // 3)
        beyond = at + -(-(4 * length - 1) // 3)
        before = tree.below(lo, hi, np.minimum(nearest, n))
        hits = tree.below(lo, hi, np.minimum(beyond, n)) - before
        found = hits > 0
        at, lo, hi, before, hits, nearest, beyond = (x[found] for x in (at, lo, hi, before, hits, nearest, beyond))
        first = tree.nth(lo, hi, before)
        two = hits > 1
        second = tree.nth(lo[two], hi[two], before[two] + 1)
        few = hits < 3
        pair = few[two]
        places += [at[few], at[two][pair]]
        periods += [first[few] - at[few], second[pair] - at[two][pair]]
        many = ~few
        at, first, step = at[many], first[many], second[~pair] - first[many]
        breaks = at + blocks.ahead(at, at + step)
        period = first + blocks.ahead(first, first + step) - breaks
        sound = (period >= nearest[many] - at) & (period < beyond[many] - at)
        places.append(at[sound])
        periods.append(period[sound])
    return np.concatenate(places), np.concatenate(periods)


def runs_of(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length, period) of every run of the texts, ordered by these."""
    texts = len(t)
    owner = np.repeat(np.arange(texts), np.diff(t.bounds))
    places = np.arange(len(t.hashes)) + owner  # one place after each text stands for its end
    keys = mixed(t.hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    blocks = Blocks(keys, places, len(places) + texts)
    at, period = _candidates(blocks)
    start = at - blocks.behind(at, at + period)
    length = at + blocks.ahead(at, at + period) + period - start
    long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    heads = t.bounds[:-1] + np.arange(texts)
    text = np.searchsorted(heads, start, side="right") - 1
    start = start - heads[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _joined(t: Tokens, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words that are not dropped, joined by one space, and where each text ends among them."""
    if not len(t.hashes):
        return t.data[:0], np.zeros(len(t), dtype=np.int64)
    edges = np.zeros(len(t.data) + 2, dtype=np.int8)
    kept = np.flatnonzero(~dropped)
    edges[t.starts[kept]] += 1
    edges[t.ends[kept]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    owner = np.searchsorted(t.bounds, kept, side="right")
    followed = np.zeros(len(kept), dtype=bool)
    followed[:-1] = owner[1:] == owner[:-1]
    gaps = t.ends[kept[followed]]  # the byte after a word that another follows is white space of the same text
    data = np.append(t.data, np.uint8(0))
    data[gaps] = 0x20
    inside[gaps] = True
    written = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(inside, out=written[1:])
    last = np.concatenate([t.ends, [0]])[np.maximum(t.bounds[1:] - 1, -1)]
    ends = np.maximum.accumulate(np.where(np.diff(t.bounds) > 0, written[last], 0))
    return data[inside], ends


class _Finder:
    def __init__(self) -> None:
        self.splitter = None

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        self.splitter = self.splitter or Splitter(SPACES, lower=False)
        counts, sizes, found, pieces, offsets, written = [], [], [], [], [np.zeros(1, dtype=np.int64)], 0
        for t in self.splitter.tokens(column):
            text, start, length, period = runs_of(t)
            change = np.zeros(len(t.hashes) + 1, dtype=np.int64)
            begin = t.bounds[text] + start
            np.add.at(change, begin + period, 1)
            np.add.at(change, begin + length, -1)
            data, ends = _joined(t, np.cumsum(change[:-1]) > 0)
            counts.append(np.diff(t.bounds))
            sizes.append(np.bincount(text, minlength=len(t)))
            found.append((start, length, period))
            pieces.append(data)
            offsets.append(ends + written)
            written += len(data)
        columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, dtype=np.int64)] * 3
        runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
        places = np.concatenate(offsets)
        buffers = [None, pa.py_buffer(places.tobytes()), pa.py_buffer(np.concatenate(pieces).tobytes() if pieces else b"")]
        texts = pa.Array.from_buffers(pa.large_string(), len(places) - 1, buffers).cast(pa.string())
        return {"n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "runs": lists, "text": texts}


def collapsed(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: n_words, runs, text.

    ``runs`` are ordered by start, then period, and count words from 0.  ``text`` has
    the words that no run contains after its first period, joined by one space.
    """
    return map_texts(docs, text, _Finder(), RESULT, keep)
