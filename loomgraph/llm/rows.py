"""Running a function of a text column over whole rows, whatever the other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row as one struct, so that no result column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]).alias("row")


def unpacked(df: DataFrame) -> DataFrame:
    """The columns of a row again."""
    return df.select("row.*")


#: Text that a worker works on at once; a longer text stands alone.
PORTION_BYTES = 4 << 20
#: Bytes of rows that Spark hands to a worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to workers a few megabytes at a time, where the session has not asked for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def portions(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column ``text`` has few bytes; what is made of a portion is as small."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())).to_numpy()
        lo = done = 0
        while lo < len(ends):
            hi = max(lo + 1, int(ends.searchsorted(done + PORTION_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo, done = hi, ends[hi - 1]


def map_texts(
    df: DataFrame,
    text: str,
    function: Callable[[pa.Array], Iterable[dict[str, list]]],
    result: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``row`` (the struct of ``keep``, all by default) and ``result`` (a struct of schema ``result``).

    ``function`` gets the texts of a batch and returns one list per result field,
    each as long as the batch.
    """
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(packed(df, keep), F.col(f"`{text}`").cast("string").alias("text"))
    fields = spark.createDataFrame([], result).schema
    schema = T.StructType([source.schema["row"], T.StructField("result", fields)])
    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            lists = function(batch.column(1))
            arrays = [lists[f.name] if isinstance(lists[f.name], pa.Array) else pa.array(lists[f.name], f.type) for f in kinds]
            struct = pa.StructArray.from_arrays(arrays, fields=list(kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0), struct], ["row", "result"])

    return source.mapInArrow(run, schema)
