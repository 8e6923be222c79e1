"""Benchmark decontamination by winnowing.

Of every ``13 - k + 1`` consecutive k-grams of words, the one with the smallest
hash is a fingerprint, in test items and in documents alike.  Thirteen equal
words hold the same k-grams on both sides, hence choose the same fingerprint: no
shared span of that length is missed.  An item of fewer words is one fingerprint,
sought among all grams of its length.

Both sets of fingerprints are made by Spark and joined on their hash.  With each go
the words around it, as far as a window that holds it can reach; so a hit is
extended to both sides inside the joined row, and equal runs of 13 words (or a whole
shorter item) count.  A fixed table of bits of the items' hashes keeps documents'
fingerprints that no item has out of the join; beyond its size all are joined.
Words are compared by 64 bits of hash.

Hits of a document are folded by its place in the stored input, so equal rows are
rows of their own.  The benchmark is read like any table; nothing of it passes
through the driver but the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.repeats import KEY, bit_table, in_table, placed, stored
from loomgraph.llm.rows import packed, portions
from loomgraph.llm.wordhash import NOT_ALNUM, Splitter, Tokens, grams
from loomgraph.session import sized

WINDOW = 13
GRAM = 7


def _around(t: Tokens, text: np.ndarray, at: np.ndarray, before: int, behind: int) -> tuple[np.ndarray, pa.ListArray]:
    """How many words of the same text stand before each position, ``before`` at most, and the words from there on."""
    left = np.minimum(at - t.bounds[text], before)
    start, stop = at - left, np.minimum(at + behind, t.bounds[text + 1])
    sizes = stop - start
    ends = np.cumsum(sizes)
    words = np.repeat(start, sizes) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return left, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(t.hashes[words].view(np.int64)))


def _chosen(t: Tokens, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the fingerprints of all texts: the last minimum of every window of grams."""
    h, span = grams(t.hashes, gram), window - gram + 1
    owner = np.repeat(np.arange(len(t)), np.diff(t.bounds))
    n = max(len(t.hashes) - window + 1, 0)
    whole = np.flatnonzero(owner[:n] == owner[window - 1 : window - 1 + n])  # windows that lie in one text
    if span == 1:
        at = whole
    else:
        found = []
        views = np.lib.stride_tricks.sliding_window_view(h, span) if len(h) >= span else np.zeros((0, span), dtype=np.uint64)
        for lo in range(0, len(whole), 1 << 17):
            some = whole[lo : lo + (1 << 17)]
            found.append(some + span - 1 - views[some][:, ::-1].argmin(axis=1))
        at = np.unique(np.concatenate(found)) if found else whole
    return owner[at], at, h[at].view(np.int64)


_SHOWN = "h long, at int, gram int, words_left int, words array<long>"


def _shown(t: Tokens, text: np.ndarray, at: np.ndarray, h: np.ndarray, gram: int, window: int) -> list[pa.Array]:
    left, words = _around(t, text, at, window - gram, window)
    return [pa.array(h), pa.array(at - t.bounds[text], pa.int32()), pa.array(np.full(len(h), gram), pa.int32()), pa.array(left, pa.int32()), words]


def item_fingerprints(benchmark: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(item, need, h, at, gram, words_left, words): fingerprints of the items, and how many words a run needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(NOT_ALNUM)
        for batch in portions(batches, 1):
            for t in splitter.tokens(batch.column(1)):
                size = np.diff(t.bounds)
                for shape in [(gram, window), *((n, n) for n in range(1, window))]:
                    owner, at, h = _chosen(t, *shape)
                    mine = size[owner] == shape[1] if shape[0] == shape[1] else size[owner] >= window
                    owner, at, h = owner[mine], at[mine], h[mine]
                    if len(h):
                        items = batch.column(0).take(pa.array(owner + t.first))
                        yield pa.RecordBatch.from_arrays(
                            [items, pa.array(np.full(len(h), shape[1]), pa.int32()), *_shown(t, owner, at, h, *shape)], ["item", "need", "h", "at", "gram", "words_left", "words"]
                        )

    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return items.mapInArrow(run, f"item string, need int, {_SHOWN}").dropDuplicates(["item", "h", "words_left", "words"])


def _candidates(rows: DataFrame, table: np.ndarray | None, short: list[int], window: int, gram: int) -> DataFrame:
    """The columns of ``rows`` but the last, text, then n_words and found: fingerprints that an item may have."""
    sent = rows.sparkSession.sparkContext.broadcast(table)
    found = rows.sparkSession.createDataFrame([], f"n_words int, found array<struct<{_SHOWN.replace(' long', ':long').replace(' int', ':int').replace(' array', ':array')}>>").schema
    schema = T.StructType(rows.schema.fields[:-1] + found.fields)
    shapes = [(gram, window), *((n, n) for n in short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(NOT_ALNUM)
        for batch in portions(batches, len(schema) - 2):
            for t in splitter.tokens(batch.column(len(schema) - 2)):
                parts, owners = [], []
                for shape in shapes:
                    owner, at, h = _chosen(t, *shape)
                    some = in_table(sent.value, h)
                    owners.append(owner[some])
                    parts.append(_shown(t, owner[some], at[some], h[some], *shape))
                owner = np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                columns = [pa.concat_arrays(list(c)).take(pa.array(order)) for c in zip(*parts)]
                structs = pa.StructArray.from_arrays(columns, ["h", "at", "gram", "words_left", "words"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(len(t) + 1)), pa.int32()), structs)
                same = [batch.column(c).slice(t.first, len(t)) for c in range(len(schema) - 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.diff(t.bounds), pa.int32()), lists], schema.names)

    return rows.mapInArrow(run, schema)


def _equal(mine: Column, its: Column) -> Column:
    """How many elements of two arrays are equal from the start."""
    unlike = F.array_position(F.zip_with(mine, its, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(unlike == 0, F.least(F.size(mine), F.size(its))).otherwise(unlike - 1).cast("int")


def _runs(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(KEY, start, end, item): equal runs of enough words around joined fingerprints."""
    items = items.select("h", "gram", "item", "need", F.col("words_left").alias("its_left"), F.col("words").alias("its"))
    both = rows.select(*KEY, F.explode("found").alias("f")).select(*KEY, "f.*").join(items, ["h", "gram"])

    def before(words: str, left: str) -> Column:
        return F.reverse(F.slice(words, 1, F.col(left)))

    def behind(words: str, left: str) -> Column:
        return F.slice(words, F.col(left) + 1, F.size(words))

    both = both.withColumn("up", _equal(before("words", "words_left"), before("its", "its_left")))
    both = both.withColumn("down", _equal(behind("words", "words_left"), behind("its", "its_left")))
    long = (F.col("down") >= F.col("gram")) & (F.col("up") + F.col("down") >= F.col("need"))
    return both.where(long).select(*KEY, (F.col("at") - F.col("up")).alias("start"), (F.col("at") + F.col("down")).alias("end"), "item")


def _hits(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(KEY, runs, items): of every document that is hit, merged runs of hit words and sorted item ids."""
    found = _runs(rows, items).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("runs"), F.collect_set("item").alias("items"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def joined(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        meets = (F.size(out) > 0) & (x["start"] <= last["end"])
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(meets, longer).otherwise(F.concat(out, F.array(x))).cast("array<struct<start:int,end:int>>")

    merged = F.aggregate(F.array_sort("runs"), empty, joined)
    return found.select(*KEY, merged.alias("runs"), F.array_sort("items").alias("items"))


def _looked(rows: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Stored rows with n_words and candidates, and the hits among them."""
    items = stored(item_fingerprints(benchmark, item_id, item_text, window, gram))
    short = [r.need for r in items.where(F.col("need") < window).select("need").distinct().collect()]  # lengths below the window
    looked = stored(_candidates(rows, bit_table(items.select("h").distinct()), sorted(short), window, gram))
    return looked, stored(_hits(looked, sized(items, items.count())))


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = WINDOW,
    gram: int = GRAM,
    is_stored: bool = False,
) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: hit runs, item ids, counts, verdict.

    ``result``: n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of
    the words or more is hit), starts and ends of the hit runs (word positions), items (sorted ids).
    A null or empty text has no words and is clean; an item without words has no
    window; a null item id reads ``null``; items of the same id count once.
    ``is_stored`` tells that ``docs`` is a plain scan of Parquet files, which is then not copied.
    """
    value = F.col(f"`{text}`").cast("string").alias("text")
    rows = placed(docs, [packed(docs, keep).alias("kept"), value], is_stored).select("kept", *KEY, "text")
    looked, hits = _looked(rows, benchmark, item_id, item_text, window, gram)
    done = looked.select("kept", *KEY, F.col("n_words").cast("long").alias("n_words")).join(sized(hits, hits.count()), KEY, "left")
    empty = F.array().cast("array<string>")
    hit = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, x: n + x["end"] - x["start"]), F.lit(0)).cast("long")
    done = done.select("kept", "n_words", hit.alias("n_hit"), "runs", F.coalesce("items", empty).alias("items"))
    ends = [F.coalesce(F.transform("runs", lambda x: x[c]), F.array().cast("array<int>")).alias(f"{c}s") for c in ("start", "end")]
    return done.select(
        F.col("kept").alias("row"),
        F.struct(
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            _contaminated().alias("contaminated"),
            *ends,
            "items",
        ).alias("result"),
    )


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", is_stored: bool = False
) -> DataFrame:
    """``docs`` without the contaminated rows; only places and fingerprints are written and joined."""
    if not is_stored:
        docs = stored(docs)
    rows = placed(docs, [F.col(f"`{text}`").cast("string").alias("text")], True).select(*KEY, "text")
    looked, hits = _looked(rows, benchmark, item_id, item_text, WINDOW, GRAM)
    hit = F.aggregate("runs", F.lit(0), lambda n, x: n + x["end"] - x["start"])
    bad = looked.select(*KEY, "n_words").join(hits.select(*KEY, hit.alias("n_hit")), KEY).where(_contaminated()).select(*KEY)
    bad = stored(bad)
    whole = placed(docs, [packed(docs).alias("kept")], True)
    return whole.join(sized(bad, bad.count()), KEY, "left_anti").select("kept.*")
