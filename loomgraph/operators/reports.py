"""Graph-wide reports: confidence, route documentation, per repository, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import or_empty, share
from loomgraph.operators.lookup import freshness


def repository_sizes(repositories, ownership) -> DataFrame:
    """Owned entities per repository; empty repositories stay."""
    owned = ownership.groupBy(F.col("repo").alias("name")).agg(F.count(F.lit(1)).alias("nodes"))
    return (
        repositories.select("name")
        .join(owned, "name", "left")
        .select("name", F.coalesce("nodes", F.lit(0)).alias("nodes"))
        .orderBy("name")
    )


def repository_names(repositories, entities) -> DataFrame:
    """Names known as a repository or stamped on an entity."""
    return (
        repositories.select("name")
        .unionByName(entities.select(F.col("repo").alias("name")))
        .where(or_empty(F.col("name")) != "")
        .distinct()
        .orderBy("name")
    )


def confidence_report(edges) -> DataFrame:
    """Edges by type and confidence tier with a grand total."""
    tiers = tuple(rules.CONFIDENCE_SCORES)
    tier = F.when(F.col("confidence").isin(*tiers), F.col("confidence")).otherwise("UNLABELED")
    per_tier = edges.select("type", tier.alias("tier")).groupBy("type", "tier").agg(
        F.count(F.lit(1)).alias("n")
    )

    def of(name):
        return F.coalesce(F.sum(F.when(F.col("tier") == name, F.col("n"))), F.lit(0))

    rows = per_tier.rollup("type").agg(
        F.grouping("type").alias("is_total"),
        F.sum("n").alias("total"),
        *[of(t).alias(t.lower()) for t in (*tiers, "UNLABELED")],
    )
    return rows.select(
        F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("type")).alias("type"),
        "total", "extracted", "inferred", "ambiguous", "unlabeled",
        share(F.col("extracted"), F.col("total")).alias("extracted_share"),
    ).orderBy(F.desc("total"), "type")


def route_report(entities) -> DataFrame:
    """Documentation and classification of all routes."""
    count_if = lambda c: F.count(F.when(c, True))
    rows = entities.where(F.col("label") == "HttpRoute").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("documented")).alias("documented"),
        count_if(F.col("source") == "openapi").alias("from_spec"),
        count_if(F.col("classification") == "business").alias("business"),
        count_if(F.col("classification") == "infra").alias("infra"),
    )
    return rows.withColumn("documented_share", share(F.col("documented"), F.col("total"))).withColumn(
        "business_share", share(F.col("business"), F.col("total"))
    )


def repository_report(repositories, edges, ownership) -> DataFrame:
    """Entities, stamped edges and extracted share per repository."""
    stamped = edges.where(F.col("repo").isNotNull()).groupBy(F.col("repo").alias("name")).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count(F.when(F.col("confidence") == "EXTRACTED", True)).alias("extracted"),
    )
    return (
        repository_sizes(repositories, ownership)
        .join(stamped, "name", "left")
        .select(
            F.col("name").alias("repo"),
            F.col("nodes").alias("entities"),
            F.coalesce("edges", F.lit(0)).alias("edges"),
            share(F.coalesce("extracted", F.lit(0)), F.coalesce("edges", F.lit(0))).alias("extracted_share"),
        )
        .orderBy(F.desc("entities"), "repo")
    )


def graph_totals(repositories, ownership, now) -> DataFrame:
    """Node total over repositories and stale repository count."""
    sizes = repository_sizes(repositories, ownership)
    stale = freshness(repositories, now, clamp=True).select(F.col("repo").alias("name"), "stale")
    return sizes.join(stale, "name", "left").agg(
        F.count(F.lit(1)).alias("repositories"),
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("total_nodes"),
        F.count(F.when(F.col("stale"), True)).alias("stale_repos"),
    )
