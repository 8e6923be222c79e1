"""Line deduplication by content-defined chunks of lines.

Lines are hashed, and a rolling hash over the last ``WINDOW`` line hashes marks about
every second line.  A chunk ends after a marked line once it holds two lines; which lines are marked depends on the lines right before them
alone, so the boundaries inside a shared block agree wherever it stands.  One of more
than ``LONGEST`` lines counts as several of that length and a rest.  A short block
may by chance hold no whole chunk, so each text is cut ``CUTS`` times, by independent
rolling hashes.

Chunks are counted over all texts by hash, and those that may be repeated are grouped by
128 bits.  The bytes of a chunk are compared with those of the first of its group; if
they are equal, its lines are removed, and so are the lines above and below as long
as they equal those around the first, up to ``BESIDE`` lines each way (64 bits of
hash), which is farther than most chunks reach, and the next chunks go on from there.  So of a block that holds one shared chunk
every line goes, wherever its edges are.  A removed line always has an equal one at an
earlier place; hence the first occurrence of every line stays.

The shortest repeat that can go has two lines.  Chunks are chosen by hash, so which
short repeats hold one is chance: in a trial of random blocks at random offsets
21 % of two lines, 58 % of three, 83 % of four, 96 % of six and all of 400 blocks of
thirteen lines went whole (``tests/llm/test_repeats.py`` holds these shares).

A null or empty text stays as it is (null becomes empty); blank lines count as lines,
but chunks without a word are not compared.  A text of nothing but repeats becomes
empty.  Equal rows are repeats of each other, with or without an id: the first keeps
its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import KEY, Found, Passages, Texts, later, located, repeated, replaced, rewritten
from loomgraph.llm.wordhash import SPACES, LineSplitter, Tokens, mixed

WINDOW = 2
CUTS = 4
LONGEST = 64
BESIDE = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xA0761D6478BD642F)


def rolling(t: Tokens) -> np.ndarray:
    """Hash of the last ``WINDOW`` lines up to each line; the first lines of a text have fewer."""
    place = np.arange(len(t.hashes)) - np.repeat(t.bounds[:-1], np.diff(t.bounds))
    total = np.zeros(len(t.hashes), dtype=np.uint64)
    for back in range(WINDOW - 1, -1, -1):
        earlier = np.zeros(len(t.hashes), dtype=np.uint64)
        earlier[back:] = t.hashes[: len(t.hashes) - back]
        total = total * _STEP + np.where(place >= back, earlier, np.uint64(0))
    return mixed(total)


def cut(t: Tokens, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the chunks of two lines or more."""
    n = len(marked)
    heads = np.zeros(n, dtype=bool)
    heads[t.bounds[:-1][np.diff(t.bounds) > 0]] = True
    # Of consecutive marked lines every second ends a chunk; the first line of a text never does.
    new = marked.copy()
    new[1:] &= ~marked[:-1]
    new |= heads
    since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    odd = np.maximum.accumulate(np.where(new, np.arange(n) * 2 + heads, 0)) & 1
    ends = marked & (since % 2 == odd)
    starts = heads.copy()
    starts[1:] |= ends[:-1]
    since = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    starts |= (since > 0) & (since % LONGEST == 0)
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], n)
    some = end - begin > 1
    return begin[some], end[some]


def chunks(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(first line, line after the last) of the chunks of all cuts that hold a word, each once."""
    spaces = np.isin(t.data, np.frombuffer(SPACES, dtype=np.uint8))
    words = np.append(0, np.cumsum(~spaces))
    code = rolling(t)
    found = [cut(t, (code >> np.uint64(7 * j) & np.uint64(1)).astype(bool)) for j in range(CUTS)]
    begin, end = (np.concatenate(x) for x in zip(*found))
    code = np.unique(begin * (LONGEST + 1) + end - begin)
    begin, end = code // (LONGEST + 1), code // (LONGEST + 1) + code % (LONGEST + 1)
    some = words[t.ends[end - 1]] > words[t.starts[begin]]
    return begin[some], end[some]


class Chunks(Passages):
    more = "content binary, above array<long>, below array<long>, n_lines int"

    def __init__(self) -> None:
        self.splitter = None

    def slices(self, column: pa.Array) -> Iterator[Tokens]:
        self.splitter = self.splitter or LineSplitter()
        return self.splitter.tokens(column)

    def found(self, column: pa.Array, wanted) -> Iterator[Found]:
        for t in self.slices(column):
            if not len(t.hashes):
                continue
            begin, end = chunks(t)
            h = self.splitter.ranges(t.hashes, begin, end).view(np.int64)
            text = np.searchsorted(t.bounds, begin, side="right") - 1
            if wanted is None:
                yield Found(text + t.first, h, h, begin)
                continue
            some = wanted(h)
            begin, end, h, text = begin[some], end[some], h[some], text[some]
            g = self.splitter.ranges(mixed(t.hashes ^ _OTHER), begin, end).view(np.int64)
            content = t.data.tobytes()
            more = {
                "content": pa.array([content[a:b] for a, b in zip(t.starts[begin].tolist(), t.ends[end - 1].tolist())], pa.binary()),
                "above": _beside(t, begin - 1, -1, np.minimum(begin - t.bounds[text], BESIDE)),
                "below": _beside(t, end, 1, np.minimum(t.bounds[text + 1] - end, BESIDE)),
                "n_lines": pa.array(end - begin, pa.int32()),
            }
            yield Found(text + t.first, h, g, begin - t.bounds[text], more)

    def without(self, column: pa.Array, positions: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Texts without the lines of the ranges (first, number); lines in all and removed."""
        texts, counts, removed = Texts(), [], []
        for t in self.slices(column):
            mine = positions.slice(t.first, len(t))
            lists = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first, n = (c.to_numpy(zero_copy_only=False) for c in mine.flatten().flatten())
            begin = np.repeat(t.bounds[:-1], lists) + first
            change = np.zeros(len(t.hashes) + 1, dtype=np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + n, -1)
            gone = np.cumsum(change[:-1]) > 0
            before = np.append(0, np.cumsum(gone))
            # A line goes with the break behind it, the last lines of a text with the break before them.
            keep = np.ones(len(t.data), dtype=bool)
            if gone.any():
                change = np.zeros(len(t.data) + 1, dtype=np.int64)
                out = np.flatnonzero(gone)
                np.add.at(change, t.starts[out], 1)
                np.add.at(change, np.minimum(t.ends[out] + 1, t.offsets[np.searchsorted(t.bounds, out, side="right")]), -1)
                keep = np.cumsum(change[:-1]) <= 0
                some = np.flatnonzero(np.diff(t.bounds) > 0)
                some = some[gone[t.bounds[some + 1] - 1]]
                stays = np.maximum.accumulate(np.where(gone, -1, np.arange(len(gone))))[t.bounds[some + 1] - 1]
                stays = stays[stays >= t.bounds[some]]
                keep[t.ends[stays]] = False
            texts.add(t.data, keep, t.offsets)
            counts.append(np.diff(t.bounds))
            removed.append(before[t.bounds[1:]] - before[t.bounds[:-1]])
        arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (counts, removed)]
        return texts.array(), *arrays


def _beside(t: Tokens, start: np.ndarray, step: int, n: np.ndarray) -> pa.ListArray:
    """Hashes of the ``n`` lines from ``start`` on, upwards or downwards."""
    ends = np.cumsum(n)
    lines = np.repeat(start, n) + step * (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(t.hashes[lines].view(np.int64)))


def _agreeing(mine: str, its: str) -> str:
    """SQL: how many lines of two lists of hashes agree from the start."""
    unlike = f"array_position(zip_with({mine}, {its}, (x, y) -> coalesce(x = y, false)), false)"
    return f"CAST(IF({unlike} = 0, least(size({mine}), size({its})), {unlike} - 1) AS INT)"


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, is_stored: bool = False) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: text, n_pieces (lines), n_removed.

    ``is_stored`` tells that ``docs`` is a plain scan of Parquet files, which is then not copied.
    """
    texts = located(docs, doc_id, text, keep, is_stored)
    lines = Chunks()
    again = later(repeated(texts, lines), [F.col(c) for c in ("content", "above", "below")]).where("content = first.content")
    up, down = _agreeing("above", "first.above"), _agreeing("below", "first.below")
    again = again.select(*KEY, F.expr(f"struct(at - {up} AS first, n_lines + {up} + {down} AS n)").alias("range"))
    positions = again.groupBy(*KEY).agg(F.collect_set("range").alias("positions"))
    return rewritten(texts, positions, lines.without, T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated blocks of lines removed from ``text``."""
    return replaced(docs, deduplicated(docs, doc_id, text), text)
