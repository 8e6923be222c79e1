"""Parts common to both SQL dialects: emission of objects and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators.extract.common import location


def object_id(kind, schema: Column, name: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("sql::"), kind, F.lit("::"), schema, F.lit("."), name)


def schema_id(schema: Column) -> Column:
    return F.concat(F.lit("sql::schema::"), schema)


def with_ids(objects: DataFrame) -> DataFrame:
    """Adds the object's node id; statements of kind schema carry the name as schema."""
    is_schema = F.col("kind") == "sql_schema"
    return objects.withColumn(
        "schema", F.when(is_schema, F.col("name")).otherwise(F.col("schema"))
    ).withColumn(
        "source",
        F.when(is_schema, schema_id(F.col("schema"))).otherwise(
            object_id(F.col("kind"), F.col("schema"), F.col("name"))
        ),
    )


def object_nodes(objects: DataFrame) -> DataFrame:
    """Schema and object nodes of statements (``kind, schema, name, path, line, materialized``)."""
    schemas_ = objects.select(
        "repo", "ord", schema_id(F.col("schema")).alias("id"), F.col("schema").alias("label"),
        F.lit("sql_schema").alias("type"),
    )
    made = objects.where("kind <> 'sql_schema'").select(
        "repo", "ord", F.col("source").alias("id"), F.concat("schema", F.lit("."), "name").alias("label"),
        F.col("kind").alias("type"), F.col("path").alias("source_file"),
        location(F.col("line")).alias("source_location"),
        schemas.metadata_struct(
            schema=F.col("schema"), object_name=F.col("name"),
            materialized=F.when(F.col("materialized"), True),
        ).alias("metadata"),
    )
    return schemas_.unionByName(made, allowMissingColumns=True)


def schema_edges(objects: DataFrame) -> DataFrame:
    return objects.where("kind <> 'sql_schema'").select(
        "repo", "ord", "source", schema_id(F.col("schema")).alias("target"),
        F.lit("in_schema").alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.col("path").alias("source_file"), location(F.col("line")).alias("source_location"),
    )


def target_nodes(refs: DataFrame) -> DataFrame:
    """Forward declarations of referenced objects (``t_kind, t_schema, t_name``)."""
    return refs.select(
        "repo", "ord", F.col("target").alias("id"),
        F.concat("t_schema", F.lit("."), "t_name").alias("label"), F.col("t_kind").alias("type"),
        schemas.metadata_struct(schema=F.col("t_schema"), object_name=F.col("t_name")).alias("metadata"),
    )


def reference_edges(refs: DataFrame) -> DataFrame:
    return refs.select(
        "repo", "ord", "source", "target", "relation", "confidence", "context",
        F.col("path").alias("source_file"), "source_location",
    )
