"""Spelling variants: words one edit apart, joined by asymmetric q-chunks, and the form each one follows.

Words are maximal runs of letters (A-Z lower-cased), counted over whole texts.  Two
words are near if one inserted, deleted or replaced code point turns one into the
other.

*   A word s of L code points contributes two disjoint chunks, its first ``ceil(L / 2)``
    code points and the rest.  A word t of L or L + 1 code points, ``d`` longer,
    contributes its positional grams: those of a chunk's length that stand where a
    chunk of such an s can be.  One edit spares a chunk; what stands before the edit
    is not shifted, what stands behind it is shifted by d, which is at most one.  So
    every near pair meets at (L, place, gram), and the join is verified by the edit
    distance of the whole words.  The longer word, or of equal lengths the greater,
    is always t; hence each unordered pair is sought once.
*   A gram that too many words share (chunks times grams over ``MOST_COMPARED``) is not
    compared as it is.  There the edit lies between the spared chunk and the word's
    end, in a stretch [a, b) of s; halving this stretch, the method's own step once
    more, leaves two smaller groups.  This goes on until groups are small or the
    stretch is one code point.  No group is dropped and none is compared whole.
*   A word's form is its near word of most occurrences (ties: the least in code-point
    order) if that has at least ``LEAST_RATIO`` times as many.  Counts grow along forms,
    so these are chains; the last word of each is found by pointer doubling.

Words are counted per slice of texts before any shuffle, so a frequent word is one
row a task.  Null and empty texts have no words; a null id takes no slip (below).
Equal rows count as often as they stand there.  Other columns are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import small_batches
from loomgraph.llm.wordhash import Splitter, Tokens, mixed
from loomgraph.session import cut_lineage, sized

LEAST_LENGTH = 5
LEAST_COUNT = 3
LEAST_RATIO = 2
MOST_COMPARED = 4096
#: Code points of words that are longer than this many bytes are looked at one word at a time.
SHORT_BYTES = 64


class LetterSplitter(Splitter):
    """Runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  The latter are all characters that begin with byte C3."""

    def __init__(self) -> None:
        super().__init__(bytes(sorted(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3"))))

    def within(self, data: np.ndarray) -> np.ndarray:
        inside = super().within(data)
        inside[1:] |= data[:-1] == 0xC3
        return inside


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ table >> np.uint32(1), table >> np.uint32(1))
    return table


def crc32_after(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges of ``data``, each continued from the CRC-32 ``before`` it."""
    out = np.empty(len(starts), dtype=np.uint32)
    sizes = ends - starts
    for i in np.flatnonzero(sizes > SHORT_BYTES).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(sizes <= SHORT_BYTES)
    short = short[np.argsort(-sizes[short], kind="stable")]
    table, begin, left = _crc_table(), starts[short], sizes[short]
    crc = ~before[short].astype(np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # words of more than k bytes come first
        crc[:n] = table[(crc[:n] ^ data[begin[:n] + k]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out[short] = ~crc
    return out


def _slipped(word: str, code: int) -> str:
    at = code % len(word)
    return word[:at] + word[at + 1 :]


class _Counter:
    """Distinct words of a batch and their numbers."""

    def __init__(self, least: int, slips: int | None):
        self.least, self.slips, self.splitter = least, slips, None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.splitter = self.splitter or LetterSplitter()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for t in self.splitter.tokens(batch.column(1)):
                yield from self._counted(t, names[t.first : t.first + len(t)])

    def _counted(self, t: Tokens, names: list[str | None]) -> Iterator[pa.RecordBatch]:
        data = self.splitter.fold[t.data]
        long = np.flatnonzero(t.ends - t.starts >= self.least)  # bytes; code points are counted later
        if not len(long):
            return
        hashes, starts, ends = t.hashes[long], t.starts[long], t.ends[long]
        words, counts = [], []
        if self.slips:
            owner = np.searchsorted(t.bounds, long, side="right") - 1
            _, first, n = np.unique(mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
            owner, hashes, starts, ends = owner[first], hashes[first], starts[first], ends[first]
            heads = np.array([zlib.crc32(f"{x}:".encode()) if x is not None else 0 for x in names], dtype=np.uint32)
            codes = crc32_after(heads[owner], data, starts, ends)
            named = np.array([x is not None for x in names])
            slip = (codes % self.slips == 0) & named[owner]
            for i in np.flatnonzero(slip).tolist():
                words.append(_slipped(data[starts[i] : ends[i]].tobytes().decode(), int(codes[i])))
                counts.append(int(n[i]))
            hashes, starts, ends, n = (x[~slip] for x in (hashes, starts, ends, n))
        else:
            n = np.ones(len(hashes), dtype=np.int64)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        content = data.tobytes()
        words += [content[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        counts += np.bincount(group, weights=n).astype(np.int64).tolist() if len(first) else []
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def counted(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = None
) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences.

    With ``slips``, a word of a document whose CRC-32 of ``<id>:<word>`` this number divides
    loses the code point at that CRC-32 modulo its length, as a typist would lose it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("name"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.mapInArrow(_Counter(least_length, slips), "word string, n long").where(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, its stretch [a, b) halved; keys are what the word has outside the stretch."""
    middle = F.expr("a + (b - a + 1) DIV 2")
    parts = F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))
    rows = rows.select("word", "n", "more", "size", F.explode(parts).alias("part")).select("word", "n", "more", "size", "part.a", "part.b")
    before, behind = F.expr("substring(word, 1, a)"), F.expr("substring(word, b + coalesce(more, 0) + 1)")
    return rows.withColumn("key", F.xxhash64("size", "a", "b", before, behind))


def near_pairs(words: DataFrame, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(low, low_n, high, high_n): every two of the distinct words (word, n) that are one edit apart, once."""
    length = F.char_length("word").cast("int")
    # ``more`` is null for chunks, else how much longer the word is than those whose chunks its grams seek
    sides = [(F.lit(None), length), (F.lit(0), length), (F.lit(1), length - 1)]
    sides = F.array(*[F.struct(more.cast("int").alias("more"), size.alias("size")) for more, size in sides])
    rows = words.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.*", F.lit(0).alias("a"), F.col("side.size").alias("b"))
    parts, rows = [], cut_lineage(_halves(rows.where("size > 0")))
    while True:
        chunks = F.count(F.when(F.col("more").isNull(), 1))
        groups = rows.groupBy("key").agg(chunks.alias("chunks"), F.count("more").alias("grams"), F.max(F.expr("b - a")).alias("stretch"))
        hot = cut_lineage(groups.where((F.col("chunks") * F.col("grams") > most_compared) & (F.col("stretch") > 1)).select("key"))
        n = hot.count()
        hot = sized(hot, n)
        parts.append(_compared(rows.join(hot, "key", "left_anti") if n else rows))
        if not n:
            return reduce(DataFrame.union, parts).dropDuplicates(["low", "high"])
        rows = cut_lineage(_halves(rows.join(hot, "key", "left_semi")))


def _compared(rows: DataFrame) -> DataFrame:
    chunks = rows.where("more IS NULL").select("key", F.col("word").alias("low"), F.col("n").alias("low_n"))
    grams = rows.where("more IS NOT NULL").select("key", "more", F.col("word").alias("high"), F.col("n").alias("high_n"))
    ordered: Column = (F.col("more") == 1) | (F.col("low") < F.col("high"))
    return chunks.join(grams, "key").where(ordered & (F.levenshtein("low", "high", 1) == 1)).select("low", "low_n", "high", "high_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer doubling."""
    links = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut_lineage(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(words: DataFrame, least_ratio: int = LEAST_RATIO, most_compared: int = MOST_COMPARED) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words`` (word, n; words distinct)."""
    words = cut_lineage(words.select("word", "n"))
    pairs = cut_lineage(near_pairs(words, most_compared))
    sides = [("low", "high"), ("high", "low")]
    both = reduce(DataFrame.union, [pairs.select(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("n"), F.col(b).alias("word")).alias("near")) for a, b in sides])
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    rows = words.join(near, "word", "left")
    follows = -F.col("near.n") >= least_ratio * F.col("n")
    rows = cut_lineage(
        rows.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(follows, F.col("near.word")).alias("form"),
            F.when(follows, -F.col("near.n")).alias("form_n"),
        )
    )
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
