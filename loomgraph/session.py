"""Session helpers: settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tune(spark: SparkSession) -> SparkSession:
    """Settings every plan relies on; they do not override cluster sizing."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder that the session names; one process may fall back on its warehouse folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
        context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of the work folder: lineage is cut as by ``cut_lineage``, the rows are compressed and read by column."""
    path = f"{work_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows up to which a table of keys is sent to every executor: some tens of megabytes.
BROADCAST_ROWS = 300_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted size allows, else as it is (shuffle join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# Rows up to which matches of a lookup are taken to the driver and named in the next scan: a few megabytes.
FEW_ROWS = 20_000


def few(rows: DataFrame) -> DataFrame:
    """Matches of a lookup: a small table that every executor gets, or a checkpoint, counted, where they are many."""
    found = rows.limit(FEW_ROWS + 1).toArrow()  # one pass over all partitions
    if found.num_rows <= FEW_ROWS:
        return F.broadcast(rows.sparkSession.createDataFrame(found, schema=rows.schema))
    kept = cut_lineage(rows)
    return sized(kept, kept.count())


def first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an ordered table, all with None."""
    return rows if limit is None else rows.limit(limit)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for row-wise heavy work when the input has fewer splits than cores.

    Large inputs have splits enough and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def input_stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under ``path``: another value once the input changes."""
    fs, place = _files(spark, path)
    found, parts = fs.listFiles(place, True), []
    while found.hasNext():
        f = found.next()
        parts.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(parts))))


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below ``path``, none if it does not exist."""
    fs, place = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place) if f.isFile()] if fs.exists(place) else []


def publish_file(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put a small file into ``folder`` unless one of that name is there; whether it was put there.

    The text is written under a name of its own and renamed without overwriting,
    so the file is seen with all its content or not at all.
    """
    fs, place = _files(spark, folder)
    fs.mkdirs(place)
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft = hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(draft, hadoop.Path(f"{folder}/{name}"), no_overwrite)
    except Exception as error:  # Hadoop's own error when another writer was first
        fs.delete(draft, False)
        if "Exists" in str(error) or "exists" in str(error):
            return False
        raise
    return True


def remove_folder(spark: SparkSession, path: str) -> bool:
    fs, place = _files(spark, path)
    return fs.delete(place, True)


def work_folder(spark: SparkSession) -> str:
    """Folder for tables this application writes and reads again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def drop_work_folders(spark: SparkSession) -> int:
    """Delete the tables this application wrote for itself, once what was made of them is stored elsewhere; how many.

    Queries write theirs again on the next use in another application only.
    """
    ensure_checkpoint_dir(spark)
    fs, place = _files(spark, spark.sparkContext.getCheckpointDir())
    found = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("tables-")] if fs.exists(place) else []
    for path in found:
        fs.delete(path, True)
    return len(found)
