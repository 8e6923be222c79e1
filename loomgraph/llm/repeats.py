"""Passages that stand more than once among all texts: finding the first of each, removing the others.

An operator cuts the texts of a batch into passages, each with 128 bits of hash.
A first look counts hashes over all texts.  Those that occur again set bits of a
table sized by their number, and a second look at the texts passes on only passages
whose bit is set (all, where the table would be larger than ``MOST_BITS``).  What may
be repeated is written once to the shared folder; the first of each group and the
later ones are found there by grouped minima and a join between stored tables, of
which Spark divides large groups.  Counts and minima combine before the shuffle: a
passage that a third of all texts share is one row a task.

Rows are told apart by their place in the stored input (file and number), so rows
that repeat an id, have none, or are equal in all columns are texts of their own.
Of equal passages the first stays: that of the smallest id, null ids last, then of
the smallest place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.rows import packed, portions, small_batches
from loomgraph.session import cut_lineage, work_folder

LEAST_BITS = 20
#: Bits of the largest table: 16 MB.
MOST_BITS = 27
KEY = ["file", "row"]
PLACE = ["unnamed", "id", *KEY, "at"]


@dataclass
class Found:
    """Passages of some texts: which text of the batch, two hashes, position, and what else is carried on."""

    text: np.ndarray
    h: np.ndarray
    g: np.ndarray
    at: np.ndarray
    more: dict[str, pa.Array] = field(default_factory=dict)


class Passages:
    """How an operator cuts texts.  ``more`` names the further columns of a passage, with their types."""

    more = ""

    def found(self, column: pa.Array, wanted) -> Iterator[Found]:
        """Passages of a column of texts, slice by slice; ``wanted(h)`` tells which hashes need the further columns."""
        raise NotImplementedError


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = f"{work_folder(df.sparkSession)}/stored"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(docs: DataFrame, columns: list[Column], is_stored: bool) -> DataFrame:
    """Named columns of every row, and its place: ``KEY`` (file, row number).

    ``is_stored`` tells that ``docs`` is a plain scan of Parquet files; other frames are written to the shared folder first.
    """
    small_batches(docs.sparkSession)
    if not is_stored:
        docs = stored(docs.select(*columns))
        columns = [F.col(f"`{c}`") for c in docs.columns]
    place = docs.metadataColumn("_metadata")
    return docs.select(*columns, F.xxhash64(place["file_path"]).alias("place_file"), place["row_index"].alias("place_row")).withColumnsRenamed(
        {"place_file": KEY[0], "place_row": KEY[1]}
    )


def located(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None, is_stored: bool) -> DataFrame:
    """kept (the struct of ``keep``), unnamed, id, text (null as empty) and place of every row; see ``placed``."""
    number = F.col(f"`{doc_id}`")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return placed(docs, [packed(docs, keep).alias("kept"), number.isNull().alias("unnamed"), number.alias("id"), value.alias("text")], is_stored)


def _again(texts: DataFrame, passages: Passages) -> DataFrame:
    """(h): hashes that occur more than once."""

    def run(batches):
        for batch in batches:
            for x in passages.found(batch.column(0), None):
                h, n = np.unique(x.h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    counted = texts.select("text").mapInArrow(run, "h long, n long")
    return cut_lineage(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))


def bit_table(again: DataFrame) -> np.ndarray | None:
    """Bytes whose bits tell the low bits of the hashes; none if the table would be too large."""
    bits = max(LEAST_BITS, (8 * again.count()).bit_length())
    if bits > MOST_BITS:
        return None
    bucket = F.col("h").bitwiseAND((1 << bits) - 1) + 1
    parts = again.groupBy(F.bitmap_bucket_number(bucket).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits"))
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for part, content in parts.collect():  # at most 16 MB
        table[(part - 1) * len(content) : part * len(content)] = np.frombuffer(content, dtype=np.uint8)
    return table


def in_table(table: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; without a table all pass."""
    if table is None:
        return np.ones(len(h), dtype=bool)
    bucket = h & len(table) * 8 - 1
    return (table[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def repeated(texts: DataFrame, passages: Passages) -> DataFrame:
    """PLACE, h, g and the further columns of every passage that may stand more than once."""
    sent = texts.sparkSession.sparkContext.broadcast(bit_table(_again(texts, passages)))
    columns = ["unnamed", "id", *KEY]

    def run(batches):
        table = sent.value

        def wanted(h: np.ndarray) -> np.ndarray:
            return in_table(table, h)

        for batch in batches:
            for x in passages.found(batch.column(4), wanted):
                text = pa.array(x.text)
                place = [batch.column(c).take(text) for c in range(4)]
                values = [*place, pa.array(x.at, pa.int32()), pa.array(x.h), pa.array(x.g), *x.more.values()]
                yield pa.RecordBatch.from_arrays(values, [*PLACE, "h", "g", *x.more])

    fields = T.StructType([texts.schema[c] for c in columns])
    more = texts.sparkSession.createDataFrame([], f"at int, h long, g long{', ' * bool(passages.more)}{passages.more}").schema
    return stored(texts.select(*columns, "text").mapInArrow(run, T.StructType(fields.fields + more.fields)))


def later(rows: DataFrame, first: list[Column] = ()) -> DataFrame:
    """Rows of ``repeated`` that are not the first of their group, with ``first`` of the first's columns beside them."""
    place = F.struct(*PLACE)
    payload = F.struct(place.alias("place"), *first)
    firsts = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min_by(payload, place).alias("first")).where("n > 1")
    return rows.join(stored(firsts.select("h", "g", "first")), ["h", "g"]).where(place != F.col("first.place"))


def rewritten(texts: DataFrame, positions: DataFrame, rewrite, kind: T.DataType) -> DataFrame:
    """``row`` and ``result`` (text, n_pieces, n_removed) of ``located`` rows.

    ``positions`` has KEY and an array positions of ``kind`` for texts that lose something.
    ``rewrite`` gets texts and positions (null for most) as Arrow columns and returns the result's three arrays.
    """
    rows = texts.select("kept", "text", *KEY).join(positions, KEY, "left").select(F.col("kept").alias("row"), "text", F.col("positions").cast(T.ArrayType(kind)).alias("positions"))
    names = ["text", "n_pieces", "n_removed"]
    result = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in names[1:])])
    schema = T.StructType([rows.schema["row"], T.StructField("result", result)])

    def run(batches):
        for batch in portions(batches, 1):
            arrays = rewrite(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(list(arrays), names)], ["row", "result"])

    return rows.mapInArrow(run, schema)


class Texts:
    """New texts as one run of bytes."""

    def __init__(self) -> None:
        self.pieces, self.ends, self.written = [], [np.zeros(1, dtype=np.int64)], 0

    def add(self, data: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> None:
        """Texts at ``offsets`` of ``data``, without the bytes that are not to be kept."""
        before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=before[1:])
        self.pieces.append(data[keep])
        self.ends.append(before[offsets[1:]] + self.written)
        self.written += int(before[-1])

    def array(self) -> pa.Array:
        ends = np.concatenate(self.ends)
        content = np.concatenate(self.pieces).tobytes() if self.pieces else b""
        return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(content)]).cast(pa.string())


def replaced(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``docs`` with the rewritten text in place of the old one."""
    return rows.select(*[F.col("result.text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
