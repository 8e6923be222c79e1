"""Streaming forms of the usage operators.

Sinks write one folder per micro-batch, overwriting it on retry, so a batch that
runs twice after a lost executor or driver is stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomgraph.functions import rules
from loomgraph.operators import usage
from loomgraph.session import file_names, publish_file, remove_folder


def _per_batch(out: str, shape, partition: str | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        writer = shape(batch).write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{out}/batch_id={batch_id}")

    return write


def daily_counts_sink(samples: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Append count deltas per micro-batch (H2, A6); readers sum them."""
    return (
        samples.writeStream.foreachBatch(_per_batch(out, usage.daily_counts, "day"))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def stat_rows(spark: SparkSession, out: str) -> DataFrame:
    """Everything ``daily_counts_sink`` stored: the last fold of closed days and the deltas that it does not cover."""
    deltas = spark.read.schema(f"{_STAT}, batch_id long, day date").parquet(out)
    fold = _last_fold(spark, out)
    if fold is None:
        return deltas.select(*_STAT_COLUMNS)
    number, upto, before = fold
    still = (F.col("batch_id") > upto) | (F.col("day") >= F.lit(before).cast("date"))
    folded = spark.read.schema(f"{_STAT}, day date").parquet(f"{out}_folds/fold={number}")
    return folded.select(*_STAT_COLUMNS).unionByName(deltas.where(still).select(*_STAT_COLUMNS))


def fold_closed_days(spark: SparkSession, out: str, before: str, upto: int) -> int:
    """Sum the counts of the days before ``before`` (yyyy-MM-dd) over all batches up to ``upto`` into one generation (H2).

    Readers then read it and the open deltas: later batches, and later days.  The
    generation is seen once its mark is published; a job that dies before leaves
    nothing visible, and of two that run at once one is refused.
    """
    number = (_last_fold(spark, out) or (0,))[0] + 1
    covered = spark.read.schema(f"{_STAT}, batch_id long, day date").parquet(out).where(F.col("batch_id") <= upto)
    fold = _last_fold(spark, out)
    rows = covered.where(F.col("day") < F.lit(before).cast("date")).select(*_STAT_COLUMNS)
    if fold is not None:
        old, done, closed = fold
        if upto < done or before < closed:
            raise ValueError("a fold covers at least what the last one covers")
        fresh = (F.col("batch_id") > done) | (F.col("day") >= F.lit(closed).cast("date"))
        rows = covered.where(fresh & (F.col("day") < F.lit(before).cast("date"))).select(*_STAT_COLUMNS)
        rows = rows.unionByName(spark.read.schema(f"{_STAT}, day date").parquet(f"{out}_folds/fold={old}").select(*_STAT_COLUMNS))
    usage.fold_counts(rows).write.mode("overwrite").partitionBy("day").parquet(f"{out}_folds/fold={number}")
    if not publish_file(spark, f"{out}_folds/marks", f"{number:020d}", f"{upto},{before}"):
        raise RuntimeError(f"fold {number} was published by another job")
    return number


def drop_folded(spark: SparkSession, out: str) -> None:
    """Delete the delta folders of days that the last fold covers, and earlier folds."""
    fold = _last_fold(spark, out)
    if fold is None:
        return
    number, upto, before = fold
    deltas = spark.read.schema(f"{_STAT}, batch_id long, day date").parquet(out)
    covered = deltas.where((F.col("batch_id") <= upto) & (F.col("day") < F.lit(before).cast("date")))
    for row in covered.select("batch_id", F.col("day").cast("string").alias("day")).distinct().collect():
        remove_folder(spark, f"{out}/batch_id={row.batch_id}/day={row.day}")
    for old in range(1, number):
        remove_folder(spark, f"{out}_folds/fold={old}")


_STAT = "actor string, endpoint string, repo string, n long"
_STAT_COLUMNS = ("day", "actor", "endpoint", "repo", "n")


def _last_fold(spark: SparkSession, out: str) -> tuple[int, int, str] | None:
    """(number, last batch, first open day) of the last published fold."""
    names = [n for n in file_names(spark, f"{out}_folds/marks") if n.isdigit()]
    if not names:
        return None
    upto, before = spark.read.text(f"{out}_folds/marks/{max(names)}").first().value.split(",")
    return int(max(names)), int(upto), before


def access_sink(samples: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Append repository touches by hour (H3, A6), so retention drops whole folders."""

    def shape(batch: DataFrame) -> DataFrame:
        return usage.access_log(batch).withColumn("hour", F.date_format("at", "yyyy-MM-dd-HH"))

    return (
        samples.writeStream.foreachBatch(_per_batch(out, shape, "hour"))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def drop_old_hours(spark: SparkSession, out: str, before: str) -> None:
    """Delete the hour folders of ``access_sink`` before ``before`` (yyyy-MM-dd-HH): retention (H4)."""
    folders = spark.read.schema("batch_id long, hour string").parquet(out).where(F.col("hour") < before)
    for row in folders.select("batch_id", "hour").distinct().collect():
        remove_folder(spark, f"{out}/batch_id={row.batch_id}/hour={row.hour}")


def sliding_anomalies(
    samples: DataFrame, threshold: int = 10, window: str = "1 hour", slide: str = "5 minutes",
    delay: str | None = None,
) -> DataFrame:
    """Actors touching many repositories per sliding window (H9).

    Touches are folded once per pane, a slide of time, actor and repository;
    windows are put together from panes, so an actor's repeated touches are not
    copied into every window they fall in.  State older than the watermark is
    dropped, which is also the retention (H4).
    """
    touches = (
        samples.withWatermark("at", delay or f"{rules.ACCESS_RETENTION_HOURS} hours")
        .select("actor", F.explode("repos").alias("repo"), "at")
        .where(F.col("actor") != rules.SHARED_ACTOR)
    )
    panes = touches.groupBy(F.window("at", slide).alias("pane"), "actor", "repo").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    return (
        panes.groupBy(F.window(F.window_time("pane"), window, slide), "actor")
        .agg(
            F.collect_set("repo").alias("repos"),
            F.sum("n").alias("requests"),
            F.min("first").alias("first_seen"),
            F.max("last").alias("last_seen"),
        )
        .where(F.size("repos") >= threshold)
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "actor", F.size("repos").alias("repo_count"), "requests",
            F.sort_array("repos").alias("repos"), "first_seen", "last_seen",
        )
    )


def rate_decisions_sink(
    requests: DataFrame, out: str, per_minute: int, checkpoint: str, keep_seconds: int = 120
) -> DataStreamWriter:
    """Fixed-window decisions per request (H11), one folder a micro-batch.

    A batch is decided by the batch fold; what is carried from batch to batch is
    the last window of each bucket, written beside the decisions under the batch's
    number, so a batch that runs twice starts from the same windows.  No bucket's
    requests are held in one place, however many they are.  A request that is late
    for its bucket's window counts in it.  Windows that ended ``keep_seconds`` before
    the latest request are forgotten.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carried = spark.read.parquet(f"{out}_windows/batch_id={batch_id - 1}") if batch_id else None
        rows = usage.limited_requests(batch)
        done, windows = usage.decide(rows, per_minute, carried)
        latest = done.agg(F.max("t").alias("t")).first().t
        if latest is not None:
            windows = windows.where(F.col("window_start") >= latest - keep_seconds * 1_000_000)
        windows.write.mode("overwrite").parquet(f"{out}_windows/batch_id={batch_id}")
        done.select("request_id", "bucket", F.timestamp_micros("t").alias("at"), "allowed", F.col("retry_after").cast("long").alias("retry_after")).write.mode(
            "overwrite"
        ).parquet(f"{out}/batch_id={batch_id}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
