"""Hotspots: entities many others depend on (G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import entity_labels, in_scope
from loomgraph.operators.upkeep import shared_key


def fan_in(edges: DataFrame) -> DataFrame:
    """Incoming dependency edges and their distinct repositories per target.

    Counted in two partial steps, per (target, repository) first: a target that
    holds a large part of all edges is already folded to one row per repository
    before the second shuffle.
    """
    per_repo = (
        edges.where(F.col("type").isin(*rules.DEPENDENCY_TYPES) & (F.col("src") != F.col("dst")))
        .groupBy("dst", "repo")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_repo.groupBy("dst").agg(
        F.sum("n").alias("fan_in"), F.count("repo").alias("dependent_repos")
    )


def hotspots(
    entities: DataFrame, edges: DataFrame, repos=(), limit: int = 0, most: int | None = rules.HOTSPOT_LIMIT_MAX
) -> DataFrame:
    """Entities ranked by fan-in, ``limit`` of them but no more than ``most`` (None: as many as asked for)."""
    limit = rules.HOTSPOT_LIMIT_DEFAULT if limit <= 0 else limit if most is None else min(limit, most)
    targets = entities.where(in_scope(F.col("repo"), repos)).select(
        "node_key", "name", "repo", "path", "line", "label"
    )
    # Shared nodes have no repository, so a scope leaves them out: their edges, most of all, need not be counted.
    if repos and targets.where(shared_key(F.col("node_key"))).isEmpty():
        edges = edges.where(~F.coalesce(shared_key(F.col("dst")), F.lit(False)))
    counts = fan_in(edges)
    return (
        counts.join(targets, counts.dst == targets.node_key)
        .orderBy(F.desc("fan_in"), F.col("name").asc_nulls_last(), "node_key")
        .limit(limit)
        .select(
            "name", "repo", "path", "line", entity_labels(F.col("label")).alias("labels"),
            "fan_in", "dependent_repos",
        )
    )
