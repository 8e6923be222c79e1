"""Source files of checkouts as a table (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """``files(repo, path, content)`` of checkouts laid out as ``root/<repo>/<path>``.

    A size limit, if given, is tested on file metadata before any content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    full = F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/*", "/")
    prefix = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    inside = full.substr(F.lit(len(prefix) + 1), F.length(full))
    return found.select(
        F.split_part(inside, F.lit("/"), F.lit(1)).alias("repo"),
        F.regexp_replace(inside, "^[^/]*/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
