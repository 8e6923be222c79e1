"""OpenAPI routes, reconciliation with code routes, emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import rules
from loomgraph.functions.columns import or_empty
from loomgraph.operators.extract.common import (
    Fragments,
    emit_edges,
    emit_nodes,
    hub_id,
    hub_nodes,
    location,
    order_key,
    select_files,
    warn,
)
from loomgraph.operators.extract.http import EXTRACTOR, code_routes, join_prefix
from loomgraph.operators.extract.yamltext import json_texts
from loomgraph.session import cut_lineage

# --- Fixed values: specification files and operation keys ---
SPEC_EXTENSIONS = (".json", ".yaml", ".yml")
SPEC_NAMES = ("api-docs.json", "apidocs.json")
SPEC_WORDS = ("swagger", "openapi")
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")

_SPEC = (
    "swagger string, openapi string, basePath string, servers array<struct<url:string>>, "
    "paths map<string,map<string,string>>"
)


def spec_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Specification files by name, those over ``max_bytes`` flagged (None: no limit)."""
    rows = select_files(
        files, None, SPEC_EXTENSIONS, rules.SKIP_DIRS + rules.HTTP_SKIP_DIRS
    ).where(
        F.col("name").isin(*SPEC_NAMES)
        | F.col("name").contains(SPEC_WORDS[0])
        | F.col("name").contains(SPEC_WORDS[1])
    )
    return rows.withColumn("size", F.octet_length("content")).withColumn(
        "oversize", F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    )


def _server_path(url: Column) -> Column:
    """Path part of a server address without a trailing slash."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"^//[^/?#]*", "")
    return F.regexp_replace(F.regexp_replace(path, r"[?#][\s\S]*$", ""), "/+$", "")


def spec_routes(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documented routes and the specifications that could not be read or exceed ``max_bytes``."""
    found = spec_files(files, max_bytes)
    usable = found.where("NOT oversize")
    keep = ["repo", "path", "walk"]
    # Parsed once: a field taken from an uncut from_json parses the text again.
    parsed = cut_lineage(json_texts(usable, keep).select(*keep, F.from_json("json", _SPEC).alias("d")))
    versioned = (or_empty(F.col("d.swagger")) != "") | (or_empty(F.col("d.openapi")) != "")
    paths = F.transform(F.coalesce("d.servers", F.array().cast("array<struct<url:string>>")), lambda s: _server_path(or_empty(s["url"])))
    first_server = F.coalesce(F.get(F.filter(paths, lambda p: p != ""), F.lit(0)), F.lit(""))
    prefix = F.when(or_empty(F.col("d.basePath")) != "", F.col("d.basePath")).otherwise(first_server)
    operations = (
        parsed.where(versioned)
        .select(*keep, prefix.alias("prefix"), F.explode("d.paths").alias("raw", "item"))
        .select(*keep, "prefix", "raw", F.explode("item").alias("method", "operation"))
        .where(F.lower("method").isin(*HTTP_METHODS))
        .withColumn("o", F.from_json("operation", "tags array<string>, operationId string"))
    )
    routes = operations.select(
        *keep, F.upper("method").alias("method"), join_prefix(F.col("prefix"), F.col("raw")).alias("route"),
        or_empty(F.col("o.operationId")).alias("handler"),
        F.coalesce("o.tags", F.array().cast("array<string>")).alias("tags"),
    )
    unread = warn(
        parsed.where(~versioned), EXTRACTOR, F.concat("path", F.lit(": openapi parse: no version key")),
    ).unionByName(
        warn(
            found.where("oversize"), EXTRACTOR,
            F.format_string("%s: openapi spec skipped: %d bytes exceeds the cap", "path", "size"),
        )
    )
    return routes, unread


def normalize_path(path: Column) -> Column:
    bare = F.btrim(F.trim(path), F.lit("\"' "))
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def route_key(method: Column, path: Column) -> Column:
    """Identity of a route with its parameters made alike."""
    segments = F.transform(
        F.split(normalize_path(path), "/"),
        lambda s: F.when(s.rlike(r"^[:*]|^\{[\s\S]*\}$|^<[\s\S]*>$"), "{param}").otherwise(s),
    )
    return F.concat(F.upper(method), F.lit(" "), F.array_join(segments, "/"))


def classify_route(path: Column) -> Column:
    low = F.lower(path)
    infra = F.lit(False)
    for prefix in rules.INFRA_ROUTE_PREFIXES:
        infra = infra | (low == prefix) | low.startswith(prefix.rstrip("/") + "/")
    return F.when(infra, "infra").otherwise("business")


def reconcile(code: DataFrame, spec: DataFrame) -> DataFrame:
    """Specification routes once each, then code routes they do not cover (C14)."""
    key = route_key(F.col("method"), F.col("route"))
    documented = spec.withColumn("key", key)
    payload = ["path", "walk", "method", "route", "handler", "tags"]
    once = documented.groupBy("repo", "key").agg(
        F.min_by(F.struct(*payload), F.struct("walk", "route", "method")).alias("r")
    )
    covered = once.select("repo", "key")
    rest = code.withColumn("key", key).join(covered, ["repo", "key"], "left_anti")
    return once.select("repo", "r.*", F.lit(0).alias("line"), F.lit("openapi").alias("source")).unionByName(
        rest.select(
            "repo", "path", "walk", "method", "route", "handler",
            F.array().cast("array<string>").alias("tags"), "line", F.lit("code").alias("source"),
        )
    )


def routes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reconciled routes of every repository, ready to emit, and warnings."""
    from_code, unresolved = code_routes(files)
    from_spec, unread = spec_routes(files)
    rows = reconcile(from_code, from_spec).where((F.col("method") != "") & (F.col("route") != ""))
    path = normalize_path(F.col("route"))
    shaped = rows.select(
        "repo", "walk", "line", "handler", "tags", "source",
        F.col("path").alias("file"), F.upper("method").alias("method"), path.alias("path"),
        classify_route(path).alias("classification"), (F.col("source") == "openapi").alias("documented"),
    )
    return shaped, unresolved.unionByName(unread)


def extract(files: DataFrame) -> Fragments:
    rows, warnings = routes(files)
    # Written once: nodes, hubs and edges all come from these rows.
    rows = cut_lineage(rows).withColumn("ord", order_key(F.col("walk"), F.col("line"))).withColumn(
        "id", F.concat_ws("::", F.lit("route"), "repo", "method", "path", "file")
    )
    nodes = rows.select(
        "repo", "ord", "id", F.concat("method", F.lit(" "), "path").alias("label"),
        F.lit("http_route").alias("type"), F.col("file").alias("source_file"),
        location(F.col("line")).alias("source_location"),
        schemas.metadata_struct(
            method=F.col("method"), handler=F.col("handler"), source=F.col("source"),
            classification=F.col("classification"), documented=F.col("documented"),
            tags=F.when(F.size("tags") > 0, F.col("tags")),
        ).alias("metadata"),
    )
    edges = rows.select(
        "repo", "ord", hub_id(F.col("repo")).alias("source"), F.col("id").alias("target"),
        F.lit("exposes_route").alias("relation"),
        F.when(F.col("documented"), "EXTRACTED").otherwise("INFERRED").alias("confidence"),
        F.col("file").alias("source_file"), location(F.col("line")).alias("source_location"),
    )
    hubs = emit_nodes(hub_nodes(rows), EXTRACTOR)
    return Fragments(emit_nodes(nodes, EXTRACTOR).unionByName(hubs), emit_edges(edges, EXTRACTOR), warnings)
