"""Substring deduplication by sliding sentence spans.

Words are runs of other bytes than 0x20 and 0x09 to 0x0D.  A sentence ends with a word
that ends in ``.``, ``!`` or ``?``, before a line break, and with the text.  One of more
than ``LONGEST`` words counts as several: it is cut after each word whose pair hash
(of the word and the one before it) is a minimum among ``WINDOW`` pair hashes in a
row, the last of equal ones.  Such a cut depends on the words near it alone and cuts
lie at most ``WINDOW`` words apart, so those inside a shared passage agree wherever in
a sentence it begins: a run of ``4 * WINDOW + 14`` shared words inside two long
sentences has a common span.

From every sentence a span runs over at least ``LEAST_SENTENCES`` sentences, until
it has ``LEAST_WORDS`` words.  Spans are hashed and matched over all texts, and
every sentence under a span that is not the first of its kind is removed, with the
white space behind it.  Spans are compared by their words (128 bits of hash): other
white space makes no difference.  All of it is array work on slices of texts; no
object is made per word or sentence.

A null or empty text, and one too short for a span, stays as it is (null becomes
empty).  A text of nothing but repeated spans becomes empty.  Equal rows are repeats
of each other, with or without an id: the first keeps its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import KEY, Found, Passages, Texts, later, located, repeated, replaced, rewritten
from loomgraph.llm.wordhash import SPACES, Splitter, Tokens, mixed

LEAST_SENTENCES = 2
LEAST_WORDS = 15
LONGEST = 20
WINDOW = 9
AT_ONCE = 1 << 17
_OTHER = np.uint64(0xA0761D6478BD642F)


def sentences(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every sentence, then the number of words; and the first sentence of every text, then their number."""
    n = len(t.hashes)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(len(t.bounds), dtype=np.int64)
    breaks = np.zeros(len(t.data) + 1, dtype=np.int32)
    np.cumsum(t.data == 10, out=breaks[1:])
    last = t.data[t.ends - 1]
    ends = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    ends[:-1] |= breaks[t.starts[1:]] > breaks[t.ends[:-1]]
    ends[t.bounds[1:][t.bounds[1:] > 0] - 1] = True
    sizes = np.diff(np.flatnonzero(ends), prepend=-1)
    number = np.repeat(np.arange(len(sizes)), sizes)
    long = np.flatnonzero(sizes[number[: max(n - WINDOW, 0)]] > LONGEST)
    long = long[number[long] == number[long + WINDOW]]  # a window of pairs from here on lies in one sentence
    if len(long):
        pairs = mixed(t.hashes[:-1] * np.uint64(31) + t.hashes[1:])
        windows = sliding_window_view(pairs, WINDOW)
        for lo in range(0, len(long), AT_ONCE):
            some = long[lo : lo + AT_ONCE]
            ends[some + WINDOW - np.argmin(windows[some][:, ::-1], axis=1)] = True
    firsts = np.append(0, np.flatnonzero(ends) + 1)
    return firsts, np.searchsorted(firsts, t.bounds)


def span_ends(firsts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences that begin a span, and the sentence that each span ends before."""
    at = np.arange(len(firsts) - 1)
    end = np.maximum(at + LEAST_SENTENCES, np.searchsorted(firsts, firsts[:-1] + LEAST_WORDS))
    whole = end <= np.repeat(bounds[1:], np.diff(bounds))
    return at[whole], end[whole]


class Spans(Passages):
    def __init__(self) -> None:
        self.splitter = None

    def slices(self, column: pa.Array) -> Iterator[Tokens]:
        self.splitter = self.splitter or Splitter(SPACES, lower=False)
        return self.splitter.tokens(column)

    def found(self, column: pa.Array, wanted) -> Iterator[Found]:
        for t in self.slices(column):
            firsts, bounds = sentences(t)
            at, end = span_ends(firsts, bounds)
            h = self.splitter.ranges(t.hashes, firsts[at], firsts[end]).view(np.int64)
            if wanted is not None:
                some = wanted(h)
                at, end, h = at[some], end[some], h[some]
            g = self.splitter.ranges(mixed(t.hashes ^ _OTHER), firsts[at], firsts[end]).view(np.int64) if wanted is not None else h
            text = np.searchsorted(bounds, at, side="right") - 1
            yield Found(text + t.first, h, g, at - bounds[text])

    def without(self, column: pa.Array, positions: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Texts without the sentences of the spans that begin at ``positions``; sentences in all and removed."""
        texts, counts, removed = Texts(), [], []
        for t in self.slices(column):
            mine = positions.slice(t.first, len(t))
            firsts, bounds = sentences(t)
            count = np.diff(bounds)
            at, end = span_ends(firsts, bounds)
            lists = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            begun = np.repeat(bounds[:-1], lists) + mine.flatten().to_numpy(zero_copy_only=False)
            change = np.zeros(len(firsts), dtype=np.int64)
            np.add.at(change, begun, 1)
            np.add.at(change, end[np.searchsorted(at, begun)], -1)
            gone = np.cumsum(change[:-1]) > 0
            before = np.append(0, np.cumsum(gone))
            lost = before[bounds[1:]] - before[bounds[:-1]]
            keep = np.ones(len(t.data), dtype=bool)
            owner = np.repeat(np.arange(len(t)), count)
            kept = np.flatnonzero((lost > 0)[owner] & ~gone)
            if lost.any():
                change = np.zeros(len(t.data) + 1, dtype=np.int64)  # 0 for bytes that stay, -1 for others
                cut = np.flatnonzero(lost)
                np.add.at(change, t.offsets[cut], -1)
                np.add.at(change, t.offsets[cut + 1], 1)
                closing = np.append(owner[kept][1:] != owner[kept][:-1], True)[: len(kept)]  # the last that stays of its text
                following = np.append(t.starts, len(t.data))[firsts[kept + 1]]
                np.add.at(change, t.starts[firsts[kept]], 1)
                np.add.at(change, np.where(closing, t.ends[firsts[kept + 1] - 1], following), -1)
                keep = np.cumsum(change[:-1]) >= 0
            texts.add(t.data, keep, t.offsets)
            counts.append(count)
            removed.append(lost)
        arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (counts, removed)]
        return texts.array(), *arrays


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, is_stored: bool = False) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: text, n_pieces, n_removed.

    ``is_stored`` tells that ``docs`` is a plain scan of Parquet files, which is then not copied.
    """
    texts = located(docs, doc_id, text, keep, is_stored)
    spans = Spans()
    positions = later(repeated(texts, spans)).groupBy(*KEY).agg(F.collect_set("at").alias("positions"))
    return rewritten(texts, positions, spans.without, T.IntegerType())


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated sentence spans removed from ``text``."""
    return replaced(docs, deduplicated(docs, doc_id, text), text)
