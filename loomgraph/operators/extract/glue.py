"""Glue jobs from Terraform, CloudFormation and job scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions.columns import base_name, or_empty
from loomgraph.operators.extract.common import (
    Fragments,
    emit_edges,
    emit_nodes,
    hub_id,
    hub_nodes,
    location,
    match_lines,
    matches,
    order_key,
    select_files,
    warn,
)
from loomgraph.operators.extract.yamltext import json_texts
from loomgraph.session import cut_lineage

EXTRACTOR = "glue"

# --- Fixed values: Terraform blocks and attributes ---
TERRAFORM = (".tf", ".hcl", ".tfvars")
TF_JOB = r'resource\s+"aws_glue_job"\s+"([^"]+)"\s*\{([\s\S]*?)\n\}'
TF_TRIGGER = r'resource\s+"aws_glue_trigger"\s+"([^"]+)"\s*\{([\s\S]*?)\n\}'
TF_NAME = r'name\s*=\s*"([^"]+)"'
TF_SCRIPT = r'script_location\s*=\s*"([^"]+)"'
TF_SCHEDULE = r'schedule\s*=\s*"([^"]+)"'
TF_JOB_NAME = r'job_name\s*=\s*"([^"]+)"'

# --- Fixed values: marks of CloudFormation templates and Glue scripts ---
CLOUDFORMATION_MARKS = ("AWSTemplateFormatVersion", "AWS::Glue::Job", "AWS::CloudFormation::")
SCRIPT_MARKS = ("awsglue", "GlueContext", "create_dynamic_frame")
SCRIPT_INIT = r"Job\(glueContext\)"
SCRIPT_NAME_ARG = r"""args\s*=\s*getResolvedOptions\s*\([^)]*\[\s*["']JOB_NAME["']\s*\]"""
SCRIPT_READ = (
    r"""create_dynamic_frame\.from_catalog\s*\([^)]*database\s*=\s*["']([^"']+)["']\s*,"""
    r"""\s*table_name\s*=\s*["']([^"']+)["']"""
)
SCRIPT_WRITE = (
    r"""write_dynamic_frame\.from_catalog\s*\([^)]*database\s*=\s*["']([^"']+)["']\s*,"""
    r"""\s*table_name\s*=\s*["']([^"']+)["']"""
)

_LIST = "array<string>"
_JOB = ["repo", "path", "walk", "pos", "name", "script", "schedule", "line"]


def script_base(script: Column) -> Column:
    """File name of a script reference."""
    return F.regexp_replace(F.trim(script), r"^[\s\S]*[/\\]", "")


def _has_any(text: Column, marks) -> Column:
    hit = F.lit(False)
    for mark in marks:
        hit = hit | text.contains(mark)
    return hit


def _files(files: DataFrame, extensions) -> DataFrame:
    return select_files(files, None, extensions)


def terraform_jobs(files: DataFrame) -> DataFrame:
    """Job resources with the schedule of the first trigger that names them."""
    rows = _files(files, TERRAFORM).where(F.col("content").contains("aws_glue_"))
    text = F.col("content")
    blocks = F.zip_with(
        matches(text, TF_JOB, 1, 2), match_lines(text, TF_JOB),
        lambda m, line: F.struct(m["g1"].alias("resource"), m["g2"].alias("block"), line.alias("line")),
    )
    jobs = rows.select("repo", "path", "walk", F.posexplode(blocks).alias("pos", "b"))
    given = F.regexp_extract("b.block", TF_NAME, 1)
    jobs = jobs.select(
        "repo", "path", "walk", "pos", F.when(given != "", given).otherwise(F.col("b.resource")).alias("name"),
        F.regexp_extract("b.block", TF_SCRIPT, 1).alias("script"), F.col("b.line").alias("line"),
    )
    triggers = rows.select("repo", "path", F.posexplode(matches(text, TF_TRIGGER, 2)).alias("t", "b")).select(
        "repo", "path", "t", F.regexp_extract("b.g2", TF_SCHEDULE, 1).alias("schedule"),
        F.explode(F.regexp_extract_all(F.col("b.g2"), F.lit(TF_JOB_NAME), F.lit(1))).alias("name"),
    )
    bound = triggers.where("schedule <> ''").groupBy("repo", "path", "name").agg(
        F.min_by("schedule", "t").alias("schedule")
    )
    return jobs.join(bound, ["repo", "path", "name"], "left").withColumn("schedule", or_empty(F.col("schedule"))).select(*_JOB)


_RESOURCE = (
    "Type string, Properties struct<Name:string,Command:struct<ScriptLocation:string>,"
    "Schedule:string,Actions:array<struct<JobName:string>>>"
)


def cloudformation_jobs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Job resources of templates with their trigger's schedule, and unreadable templates."""
    rows = _files(files, (".yaml", ".yml", ".json")).where(_has_any(F.col("content"), CLOUDFORMATION_MARKS))
    keep = ["repo", "path", "walk"]
    document = F.from_json("json", "Resources map<string,string>, AWSTemplateFormatVersion string")
    texts = json_texts(rows, keep).select(*keep, document.alias("d"), "json")
    # Parsed once: a field taken from an uncut from_json parses the text again.
    parsed = cut_lineage(texts.select(
        *keep, F.transform_values("d.Resources", lambda _, raw: F.from_json(raw, _RESOURCE)).alias("resources"),
        (F.col("json").isNull() | F.col("d").isNull()).alias("unread"),
    ))
    resources = parsed.select(*keep, F.explode("resources").alias("logical_id", "r"))
    props = "r.Properties."
    given = or_empty(F.col(props + "Name"))
    jobs = resources.where("r.Type = 'AWS::Glue::Job'").select(
        *keep, F.col("logical_id"), F.when(given != "", given).otherwise(F.col("logical_id")).alias("name"),
        or_empty(F.col(props + "Command.ScriptLocation")).alias("script"),
    )
    triggers = resources.where("r.Type = 'AWS::Glue::Trigger'").select(
        "repo", "path", "logical_id", or_empty(F.col(props + "Schedule")).alias("schedule"),
        F.explode(props + "Actions.JobName").alias("name"),
    )
    # Resources have no order; the highest logical id decides between several triggers.
    bound = triggers.where("name <> ''").groupBy("repo", "path", "name").agg(
        F.max_by("schedule", "logical_id").alias("schedule")
    )
    found = jobs.join(bound, ["repo", "path", "name"], "left").select(
        "repo", "path", "walk", F.lit(0).alias("pos"), "name", "script",
        or_empty(F.col("schedule")).alias("schedule"), F.lit(0).alias("line"),
    )
    return found, warn(parsed.where("unread"), EXTRACTOR, F.concat("path", F.lit(": template cannot be read")))


def script_jobs(files: DataFrame) -> DataFrame:
    """Glue scripts as jobs with the catalog tables they read and write (C17)."""
    text = F.col("content")
    rows = _files(files, (".py",)).where(
        _has_any(text, SCRIPT_MARKS) & (text.rlike(SCRIPT_INIT) | text.rlike(SCRIPT_NAME_ARG))
    )

    def tables(regex):
        return F.transform(matches(text, regex, 1, 2), lambda m: F.concat(m["g1"], F.lit("."), m["g2"]))

    return rows.select(
        "repo", "path", "walk", F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "").alias("name"),
        F.col("path").alias("script"), tables(SCRIPT_READ).alias("sources"), tables(SCRIPT_WRITE).alias("dests"),
    )


def jobs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared jobs with the tables of their script, scripts nobody declares, warnings (C17)."""
    templates, warnings = cloudformation_jobs(files)
    declared = terraform_jobs(files).unionByName(templates).withColumn("base", script_base(F.col("script")))
    # Both sides are used several times; the files are read once for each.
    declared = cut_lineage(declared)
    scripts = cut_lineage(script_jobs(files).withColumn("base", script_base(F.col("script"))))
    # Of several jobs declaring one script name the last takes its tables.
    takers = declared.where("script <> ''").groupBy("repo", "base").agg(
        F.max(F.struct("walk", "pos", "name")).alias("taker")
    )
    folding = scripts.join(takers, ["repo", "base"], "left_semi")

    def folded(column: str) -> DataFrame:
        """Distinct tables of all scripts of a name, in walk order."""
        return (
            folding.select("repo", "base", "walk", F.posexplode(column).alias("at", "table"))
            .groupBy("repo", "base", "table")
            .agg(F.min(F.struct("walk", "at")).alias("first"))
            .groupBy("repo", "base")
            .agg(F.array_sort(F.collect_list(F.struct("first", "table"))).alias("found"))
            .select("repo", "base", F.col("found.table").alias(column))
        )

    tables = (
        takers.join(folded("sources"), ["repo", "base"], "left")
        .join(folded("dests"), ["repo", "base"], "left")
        .select(
            "repo", F.col("taker.walk").alias("walk"), F.col("taker.pos").alias("pos"),
            F.col("taker.name").alias("name"), "sources", "dests",
        )
    )
    none = F.array().cast(_LIST)
    known = declared.join(tables, ["repo", "walk", "pos", "name"], "left").select(
        *_JOB, F.coalesce("sources", none).alias("sources"), F.coalesce("dests", none).alias("dests")
    )
    alone = scripts.join(takers, ["repo", "base"], "left_anti").select(
        "repo", "path", "walk", F.lit(0).alias("pos"), "name", "script", F.lit("").alias("schedule"),
        F.lit(0).alias("line"), "sources", "dests",
    )
    return known.unionByName(alone).where("name <> ''"), warnings


def extract(files: DataFrame) -> Fragments:
    """Job, table and schedule nodes with their edges."""
    found, warnings = jobs(files)
    rows = cut_lineage(found).withColumn("ord", order_key(F.col("walk"), F.col("pos"))).withColumn(
        "id", F.concat_ws("::", F.lit("glue::job"), "repo", "name")
    )
    job_nodes = rows.select(
        "repo", "ord", "id", F.col("name").alias("label"), F.lit("glue_job").alias("type"),
        F.col("path").alias("source_file"),
        F.when(F.col("line") > 0, location(F.col("line"))).alias("source_location"),
        schemas.metadata_struct(
            script=F.col("script"), schedule=F.col("schedule"), sources=F.col("sources"), dests=F.col("dests")
        ).alias("metadata"),
    )
    contains = rows.select(
        "repo", "ord", hub_id(F.col("repo")).alias("source"), F.col("id").alias("target"),
        F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("source_file"),
    )

    def table_side(column, relation):
        return rows.select(
            "repo", "ord", "id", "path", F.explode(column).alias("table"), F.lit(relation).alias("relation")
        )

    touched = table_side("sources", "reads_source").unionByName(table_side("dests", "writes_destination"))
    table_id = F.concat(F.lit("sql::sql_table::"), "table")
    table_nodes = touched.select(
        "repo", "ord", table_id.alias("id"), F.col("table").alias("label"), F.lit("sql_table").alias("type")
    )
    table_edges = touched.select(
        "repo", "ord", F.col("id").alias("source"), table_id.alias("target"), "relation",
        F.lit("INFERRED").alias("confidence"), F.col("path").alias("source_file"),
    )
    timed = rows.where("schedule <> ''").withColumn("sched", F.concat_ws("::", F.lit("glue::schedule"), "repo", "name"))
    schedule_nodes = timed.select(
        "repo", "ord", F.col("sched").alias("id"), F.col("schedule").alias("label"),
        F.lit("glue_schedule").alias("type"), schemas.metadata_struct(expression=F.col("schedule")).alias("metadata"),
    )
    schedule_edges = timed.select(
        "repo", "ord", F.col("sched").alias("source"), F.col("id").alias("target"),
        F.lit("scheduled").alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.col("path").alias("source_file"), F.col("schedule").alias("context"),
    )
    nodes = [job_nodes, table_nodes, schedule_nodes, hub_nodes(rows)]
    edges = [contains, table_edges, schedule_edges]
    return Fragments(
        _all(emit_nodes, nodes), _all(emit_edges, edges), warnings
    )


def _all(emit, parts: list[DataFrame]) -> DataFrame:
    out = emit(parts[0], EXTRACTOR)
    for part in parts[1:]:
        out = out.unionByName(emit(part, EXTRACTOR))
    return out
