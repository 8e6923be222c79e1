"""Package and cross-repository dependencies.

Reads ``manifest_deps(repo, ecosystem, name, version, scope, manifest)`` or takes
those rows from go.mod, package.json and requirements files.  Which manifest
formats exist, and how each is read, is this library's own choice; the node and
edge shapes are what the queries expect: hub ``repo::<name>``, package
``pkg::<ecosystem>::<name>``, the edge context is the scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators.extract.common import (
    Fragments,
    emit_edges,
    emit_nodes,
    hub_id,
    hub_nodes,
    select_files,
)
from loomgraph.session import cut_lineage

EXTRACTOR = "deps"
_GO_REQUIRE = r"^\s*(?:require\s+)?([A-Za-z0-9][^\s()]*[./][^\s()]*)\s+(v[^\s]+)(\s*//\s*indirect)?"
_PY_REQUIRE = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([^\s;,#]+))?"
_NPM = "dependencies map<string,string>, devDependencies map<string,string>"


def manifest_deps(files: DataFrame) -> DataFrame:
    """Dependencies declared in manifest files."""
    rows = select_files(files, None)
    lines = rows.where(F.col("name").isin("go.mod") | F.col("name").rlike(r"^requirements.*\.txt$")).select(
        "repo", "path", "name", F.explode(F.split("content", "\n")).alias("text")
    )
    text = F.col("text")
    go = lines.where((F.col("name") == "go.mod") & text.rlike(_GO_REQUIRE) & ~text.rlike(r"^\s*(module|replace|exclude)\b")).select(
        "repo", F.lit("go").alias("ecosystem"), F.regexp_extract(text, _GO_REQUIRE, 1).alias("name"),
        F.regexp_extract(text, _GO_REQUIRE, 2).alias("version"),
        F.when(F.regexp_extract(text, _GO_REQUIRE, 3) != "", "indirect").otherwise("runtime").alias("scope"),
        F.col("path").alias("manifest"),
    )
    python = lines.where((F.col("name") != "go.mod") & text.rlike(_PY_REQUIRE)).select(
        "repo", F.lit("pypi").alias("ecosystem"), F.regexp_extract(text, _PY_REQUIRE, 1).alias("name"),
        F.regexp_extract(text, _PY_REQUIRE, 2).alias("version"), F.lit("runtime").alias("scope"),
        F.col("path").alias("manifest"),
    )
    npm = rows.where("name = 'package.json'").withColumn("d", F.from_json("content", _NPM))
    parts = [
        npm.select("repo", "path", F.explode(f"d.{column}").alias("name", "version"), F.lit(scope).alias("scope"))
        for column, scope in (("dependencies", "runtime"), ("devDependencies", "dev"))
    ]
    javascript = parts[0].unionByName(parts[1]).select(
        "repo", F.lit("npm").alias("ecosystem"), "name", "version", "scope", F.col("path").alias("manifest")
    )
    return go.unionByName(python).unionByName(javascript)


def internal_targets(deps: DataFrame, org_prefixes: list[str]) -> DataFrame:
    """Dependencies whose name starts with one of the organisation's prefixes.

    The prefixes are a short parameter list, tested inside the row; the longest
    one that fits is cut off to give the repository name.
    """
    ordered = sorted(org_prefixes, key=len, reverse=True)
    rest = F.lit(None).cast("string")
    for prefix in reversed(ordered):
        rest = F.when(
            F.col("name").startswith(prefix), F.col("name").substr(F.lit(len(prefix) + 1), F.length("name"))
        ).otherwise(rest)
    return deps.withColumn("target_repo", F.split_part(rest, F.lit("/"), F.lit(1))).where(
        F.col("target_repo").isNotNull() & (F.col("target_repo") != "") & (F.col("target_repo") != F.col("repo"))
    )


def extract(deps: DataFrame, org_prefixes: list[str] = ()) -> Fragments:
    rows = cut_lineage(deps).withColumn("ord", F.concat_ws("\u0000", "manifest", "name", "scope"))
    package_id = F.concat_ws("::", F.lit("pkg"), "ecosystem", "name")
    packages = rows.select(
        "repo", "ord", package_id.alias("id"), F.col("name").alias("label"), F.lit("package").alias("type"),
        "ecosystem",
        schemas.metadata_struct(version=F.col("version"), scope=F.col("scope"), manifest=F.col("manifest")).alias("metadata"),
    )
    package_edges = rows.select(
        "repo", "ord", hub_id(F.col("repo")).alias("source"), package_id.alias("target"),
        F.lit("depends_on").alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.col("manifest").alias("source_file"), F.col("scope").alias("context"),
    )
    internal = internal_targets(rows, list(org_prefixes))
    targets = internal.select(
        "repo", "ord", F.concat(F.lit("repo::"), "target_repo").alias("id"), F.col("target_repo").alias("label"),
        F.lit("package").alias("type"),
        schemas.metadata_struct(is_repository=F.lit(True), discovered_as=F.col("name")).alias("metadata"),
    )
    repo_edges = internal.select(
        "repo", "ord", hub_id(F.col("repo")).alias("source"), F.concat(F.lit("repo::"), "target_repo").alias("target"),
        F.lit("depends_on_repo").alias("relation"), F.lit("INFERRED").alias("confidence"),
        F.col("manifest").alias("source_file"), F.col("scope").alias("context"),
    )
    nodes = emit_nodes(packages, EXTRACTOR).unionByName(emit_nodes(targets, EXTRACTOR)).unionByName(
        emit_nodes(hub_nodes(rows), EXTRACTOR)
    )
    return Fragments(nodes, emit_edges(package_edges, EXTRACTOR).unionByName(emit_edges(repo_edges, EXTRACTOR)))
