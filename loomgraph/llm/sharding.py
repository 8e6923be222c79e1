"""Sharding by extendible hashing: shards are hash prefixes, split one more bit where they are too large.

The directory follows from sums alone: a row's shard is the shortest prefix of
its hash whose rows fit the byte limit.  Sums of fine prefixes (some bits more
than an even spread needs) are taken with one aggregation and folded up to all
shorter ones; the directory tells for each fine prefix the first that fits.
Fine prefixes that are still too large go on with their next bits, and only
their rows are summed again.

Rows of equal hash (equal id and text) cannot be parted by more bits; they fill
numbered pages of their bucket, in row order.  A single row over the limit stands
alone.  Null texts weigh nothing.  Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.rows import packed
from loomgraph.session import cut_lineage, sized, work_folder

HASH_BITS = 60
SPARE_BITS = 4
NEXT_BITS = 8
LIMIT = 32 << 20
COLUMNS = ("shard_id", "shard_bits", "row_bytes", "shard_bytes")


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of a row's id and its text's MD5, as a long."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("null"))
    name = F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.lit(":"), F.md5(value))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: str, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def _directory(sizes: DataFrame, done: int, depth: int, limit: int) -> DataFrame:
    """(p, bits, prefix, shard_bytes) for every fine prefix p of ``depth`` bits; bits is null where none fits."""
    fine = sizes.groupBy(_prefix("h", depth).alias("p")).agg(F.sum("row_bytes").alias("b"))
    paths = fine.select("p", "b", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("bits"))
    paths = paths.withColumn("prefix", F.expr(f"shiftright(p, {depth} - bits)"))
    nodes = paths.groupBy("bits", "prefix").agg(F.sum("b").alias("shard_bytes"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("bits") == HASH_BITS)
    fitting = paths.select("p", "bits", "prefix").join(nodes.where(fits), ["bits", "prefix"])
    first = fitting.groupBy("p").agg(F.min(F.struct("bits", "prefix", "shard_bytes")).alias("s"))
    return fine.select("p").join(first, "p", "left").select("p", "s.*")


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default), ``shard_id``, ``shard_bits``, ``row_bytes``, ``shard_bytes``.

    ``shard_id`` is the prefix in binary (``root`` for no bits), followed by a
    page number where rows of one hash exceed ``limit``.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("row_bytes")
    docs.select(row_hash(doc_id, text).alias("h"), size).write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    total = sizes.agg(F.sum("row_bytes")).first()[0] or 0
    rows = docs.select(packed(docs, keep), row_hash(doc_id, text).alias("h"), size)
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("bits", "int"), ("prefix", "long"), ("shard_bytes", "long"))])

    rest, done, depth = sizes, 0, min(HASH_BITS, math.ceil(math.log2(max(total / limit, 1))) + SPARE_BITS)
    while True:
        found = cut_lineage(_directory(rest, done, depth, limit))
        here = found.where("bits is not null").select("p", *[F.col(c).alias(f"n_{c}") for c in ("bits", "prefix", "shard_bytes")])
        rows = rows.withColumn("p", _prefix("h", depth)).join(sized(here, here.count()), "p", "left")
        rows = rows.select("row", "h", "row_bytes", *[F.coalesce(c, f"n_{c}").alias(c) for c in ("bits", "prefix", "shard_bytes")])
        too_large = found.where("bits is null").select("p")
        n = too_large.count()
        if not n:
            break
        rest = rest.withColumn("p", _prefix("h", depth)).join(sized(too_large, n), "p", "left_semi").drop("p")
        done, depth = depth, min(HASH_BITS, depth + NEXT_BITS)

    name = F.when(F.col("bits") == 0, F.lit("root")).otherwise(F.expr("lpad(bin(prefix), bits, '0')"))
    rows = rows.withColumn("shard_id", name)
    if depth < HASH_BITS:
        paged = None
    else:
        over = (F.col("bits") == HASH_BITS) & (F.col("shard_bytes") > limit)
        paged, rows = _paged(rows.where(over), limit), rows.where(~over)
    columns = ["row", "shard_id", F.col("bits").alias("shard_bits"), "row_bytes", "shard_bytes"]
    rows = rows.select(*columns)
    return rows if paged is None else rows.union(paged.select(*columns))


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of full-length buckets over the limit, dealt to pages; all rows of a bucket have one size.

    A row's number in its bucket is its number within its task plus the rows of
    earlier tasks, so no bucket is sorted in one place.
    """
    rows = cut_lineage(rows.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    tasks = rows.groupBy("h", "task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.withColumn("earlier", F.sum("n").over(Window.partitionBy("h").orderBy("task")) - F.col("n"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("h", "task").orderBy("at")) - 1)
    numbered = numbered.join(tasks.drop("n"), ["h", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("row_bytes")))
    page = F.floor(F.col("rank") / room)
    held = F.least(room, F.col("shard_bytes") / F.col("row_bytes") - page * room)
    return numbered.withColumn("shard_id", F.concat_ws("-", "shard_id", page.cast("string"))).withColumn(
        "shard_bytes", (held * F.col("row_bytes")).cast("long")
    )


def with_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS``, which replace columns of these names."""
    placed = sharded(docs, doc_id, text, limit)
    names = {c.lower() for c in COLUMNS}
    return placed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names], *COLUMNS)
