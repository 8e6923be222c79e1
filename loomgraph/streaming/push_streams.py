"""Push events as a stream: match against the manifest, coalesce, hand over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loomgraph.operators import indexing


def matched_pushes(pushes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stream–static join of pushes with the manifest."""
    return indexing.match_pushes(pushes, manifest)


def distinct_pushes(pushes: DataFrame, manifest: DataFrame, window: str = "10 minutes") -> DataFrame:
    """One row per repository and window, across micro-batches."""
    matched = matched_pushes(pushes.withWatermark("at", window), manifest)
    return matched.dropDuplicatesWithinWatermark(["repo"])


def coalesced_runs(
    pushes: DataFrame, manifest: DataFrame, run: Callable[[DataFrame, int], None],
    checkpoint: str, debounce: str = "30 seconds",
) -> DataStreamWriter:
    """Call ``run(pending, batch_id)`` once per burst; the trigger is the debounce."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        run(indexing.pending_repositories(matched_pushes(batch, manifest)), batch_id)

    return (
        pushes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=debounce)
    )
