"""Lookups: symbols, calls, dependencies, routes, topics, SQL objects, Glue jobs.

Selective filters are applied to the entity table first.  Matched rows are counted
and sent to the edges where few; the far ends of the edges found are again a
counted list of keys that picks entities where they lie, so a point lookup scans
the tables but shuffles neither.  Every ordering ends in a unique key, so limits
are deterministic, and sorts nulls last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import (
    distinct_list,
    entity_labels,
    in_scope,
    named,
    normalize_symbol,
    normalize_symbol_col,
    or_empty,
    share,
    symbol_spellings_col,
)
from loomgraph.session import cut_lineage, few, first, sized


def symbol_forms(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Each symbol with its normalised form and every stored spelling."""
    return symbols.select(
        column,
        normalize_symbol_col(F.col(column)).alias("normalized"),
        F.explode(symbol_spellings_col(F.col(column))).alias("spelling"),
    )


def _nulls_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def find_symbol(entities: DataFrame, symbol: str, repos=(), limit: int | None = rules.SYMBOL_LIMIT) -> DataFrame:
    """Entities whose name is one of the symbol's spellings."""
    hits = entities.where(
        named(F.col("name_lower"), F.col("norm_name_lower"), symbol)
        & in_scope(F.col("repo"), repos)
    )
    if not symbol:
        hits = hits.where(F.lit(False))
    rows = hits.select(
        "node_key", "name", "repo", "path", "line",
        entity_labels(F.col("label")).alias("labels"), "community",
    )
    return first(rows.orderBy(*_nulls_last("repo", "path", "line", "node_key")), limit)


def find_symbols(entities: DataFrame, symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Batch form of ``find_symbol``: an equi-join on spellings, one row per (symbol, entity)."""
    forms = symbol_forms(symbols, column).select(column, "spelling")
    names = entities.select(
        "node_key", "name", "repo", "path", "line", "label",
        F.explode(F.array_distinct(F.array("name_lower", "norm_name_lower"))).alias("spelling"),
    )
    return names.join(forms, "spelling").drop("spelling").dropDuplicates([column, "node_key"])


def _side(entities: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return entities.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def _ends(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """The entities of a list of keys (one column), picked without moving the others."""
    wanted = few(keys.toDF("node_key").distinct())
    return entities.join(wanted, "node_key", "left_semi")


def _call_edges(entities, edges, symbol, repos, anchor: str, limit: int | None) -> DataFrame:
    other = "callee" if anchor == "caller" else "caller"
    ends = {"caller": "src", "callee": "dst"}
    calls = edges.where(F.col("type") == "CALLS").select("src", "dst", "confidence")
    columns = ("node_key", "name", "repo", "path", "line", "label")
    matched = _side(
        entities.where(
            named(F.col("name_lower"), F.col("norm_name_lower"), symbol)
            & in_scope(F.col("repo"), repos)
            & F.lit(bool(symbol))
        ),
        anchor, *columns,
    )
    matched = few(matched)
    rows = few(calls.join(matched, calls[ends[anchor]] == matched[f"{anchor}_node_key"]))
    far = _side(_ends(entities, rows.select(ends[other])), other, *columns)
    rows = far.join(rows, rows[ends[other]] == far[f"{other}_node_key"])
    ordered = rows.orderBy(
        *_nulls_last(
            f"{other}_repo", f"{other}_path", f"{other}_line", "caller_node_key", "callee_node_key"
        )
    )
    return (
        first(ordered, limit)
        .select(
            F.col("caller_name").alias("caller"),
            "caller_repo", "caller_path", "caller_line",
            entity_labels(F.col(f"{other}_label")).alias("labels"),
            F.col("callee_name").alias("callee"),
            "callee_repo", "callee_path",
            or_empty(F.col("confidence")).alias("confidence"),
        )
    )


def find_callers(entities, edges, symbol: str, repos=(), limit: int | None = rules.SYMBOL_LIMIT) -> DataFrame:
    """Call edges into the symbol; the scope restricts the callee."""
    return _call_edges(entities, edges, symbol, repos, "callee", limit)


def find_callees(entities, edges, symbol: str, repos=(), limit: int | None = rules.SYMBOL_LIMIT) -> DataFrame:
    """Call edges out of the symbol; the scope restricts the caller (E5)."""
    return _call_edges(entities, edges, symbol, repos, "caller", limit)


_DEPENDS = ("DEPENDS_ON", "DEPENDS_ON_REPO")


def _hubs(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("node_id").startswith("repo::")).select(
        F.col("node_key").alias("hub_key"),
        F.col("node_id").alias("hub_id"),
        F.col("name").alias("hub_name"),
        F.col("label").alias("hub_label"),
    )


def _targets(entities: DataFrame) -> DataFrame:
    return entities.select(
        F.col("node_key").alias("target_key"),
        F.col("name").alias("target_name"),
        F.col("name_lower").alias("target_name_lower"),
        F.col("label").alias("target_label"),
        or_empty(F.col("ecosystem")).alias("ecosystem"),
        or_empty(F.col("version")).alias("version"),
    )


def _dependency_links(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*_DEPENDS)).select(
        "src", "dst",
        or_empty(F.col("context")).alias("scope"),
        (F.col("type") == "DEPENDS_ON_REPO").alias("cross"),
        or_empty(F.col("confidence")).alias("confidence"),
    )


def dependency_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Every hub → package / hub → hub dependency, with both ends' attributes."""
    links, hubs, targets = _dependency_links(edges), _hubs(entities), _targets(entities)
    return links.join(hubs, links.src == hubs.hub_key).join(
        targets, links.dst == targets.target_key
    )


def find_dependencies(entities, edges, repo: str, scope: str = "", limit: int | None = rules.DEPENDENCY_LIMIT) -> DataFrame:
    """What a repository depends on."""
    hub = few(_hubs(entities).where(F.col("hub_id") == "repo::" + repo))
    links = _dependency_links(edges)
    links = few(links.join(hub, links.src == hub.hub_key))
    targets = _targets(_ends(entities, links.select("dst")))
    rows = targets.join(links, links.dst == targets.target_key)
    if scope:
        rows = rows.where(F.col("scope") == scope)
    if not repo:
        rows = rows.where(F.lit(False))
    return (
        first(rows.orderBy("ecosystem", "target_name", "target_key", "cross", "scope"), limit)
        .select(
            F.lit(repo).alias("repo"),
            F.col("target_name").alias("name"),
            entity_labels(F.col("target_label")).alias("labels"),
            "ecosystem", "version", "scope", "cross", "confidence",
        )
    )


def find_dependents(entities, edges, dependency: str, limit: int | None = rules.DEPENDENCY_LIMIT) -> DataFrame:
    """Repositories that depend on a package or repository name."""
    name = dependency.strip().lower()
    target = few(_targets(entities).where((F.col("target_name_lower") == name) & F.lit(bool(dependency))))
    links = _dependency_links(edges)
    links = few(links.join(target, links.dst == target.target_key))
    hubs = _hubs(_ends(entities, links.select("src")))
    rows = hubs.join(links, links.src == hubs.hub_key)
    return (
        first(rows.orderBy("hub_name", "target_key", "cross", "scope"), limit)
        .select(
            F.lit("").alias("repo"),
            F.col("hub_name").alias("name"),
            entity_labels(F.col("hub_label")).alias("labels"),
            "ecosystem", "version", "scope", "cross", "confidence",
        )
    )


def all_routes(entities: DataFrame) -> DataFrame:
    """Route entities with method and path parsed from their name."""
    name = or_empty(F.col("name"))
    spaced = name.contains(" ")
    return entities.where(F.col("label") == "HttpRoute").select(
        "node_key",
        F.col("repo").alias("raw_repo"),
        or_empty(F.col("repo")).alias("repo"),
        F.when(spaced, F.split_part(name, F.lit(" "), F.lit(1))).otherwise("").alias("method"),
        F.when(spaced, F.regexp_replace(name, "^[^ ]* ", "")).otherwise(name).alias("path"),
        or_empty(F.col("handler")).alias("handler"),
        entity_labels(F.col("label")).alias("labels"),
        or_empty(F.col("path")).alias("file"),
        or_empty(F.col("line")).alias("line"),
        F.coalesce("source", F.lit("code")).alias("source"),
        F.coalesce("documented", F.lit(False)).alias("documented"),
        or_empty(F.col("classification")).alias("classification"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def find_routes(entities, method: str = "", path_contains: str = "", repos=(), limit: int | None = rules.ROUTE_LIMIT) -> DataFrame:
    """Routes filtered by method, path substring and repositories."""
    rows = all_routes(entities).where(in_scope(F.col("raw_repo"), repos))
    if method:
        rows = rows.where(F.upper("method") == method.upper())
    if path_contains:
        rows = rows.where(F.lower("path").contains(path_contains.lower()))
    return first(rows.orderBy("repo", "path", "node_key"), limit).drop("raw_repo")


def find_kafka_topic(entities, edges, topic: str) -> DataFrame:
    """Producers and consumers of a topic, its case variants merged."""
    wanted = topic.strip().lower()
    if not wanted:
        raise ValueError("topic required")
    topics = few(
        entities.where((F.col("label") == "KafkaTopic") & (F.col("name_lower") == wanted)).select("node_key", F.col("name").alias("topic"))
    )
    links = edges.where(F.col("type").isin("PRODUCES", "CONSUMES")).select("src", "dst", "type")
    links = few(links.join(topics.select("node_key"), links.dst == topics.node_key, "left_semi"))
    hubs = _ends(entities.where(F.col("node_id").startswith("repo::")), links.select("src")).select(
        F.col("node_key").alias("hub_key"), F.col("name").alias("hub_name")
    )
    flows = hubs.join(links, links.src == hubs.hub_key).select("dst", "type", "hub_name")
    rows = topics.join(flows, topics.node_key == flows.dst, "left")

    def side(kind):
        return distinct_list(F.when((F.col("type") == kind) & (F.col("hub_name") != ""), F.col("hub_name")))

    return rows.agg(
        F.min("topic").alias("topic"),
        side("PRODUCES").alias("producers"),
        side("CONSUMES").alias("consumers"),
    ).where(F.col("topic").isNotNull())


def find_sql_object(entities, edges, schema: str, name: str, limit: int | None = rules.SQL_OBJECT_LIMIT) -> DataFrame:
    """SQL objects by full or last-part name with what they touch."""
    schema, name = schema.strip().lower(), name.strip().lower()
    full = f"{schema}.{name}" if schema else name
    lower = or_empty(F.col("name_lower"))
    match = F.col("name_lower") == full
    if not schema:
        match = match | (F.substring_index(lower, ".", -1) == name)
    objects = few(
        entities.where(F.col("label").isin(*rules.SQL_LABELS) & match & F.lit(bool(name))).select(
            "node_key", F.col("name").alias("full_name"), "label",
            or_empty(F.col("path")).alias("file"), or_empty(F.col("line")).alias("line"),
        )
    )
    links = edges.where(
        F.col("type").isin("READS_TABLE", "WRITES_TABLE", "DEPENDS_ON_OBJECT", "TRIGGERS_ON")
    ).select("src", "dst", "type")
    links = few(links.join(objects.select("node_key"), links.src == objects.node_key, "left_semi"))
    targets = _ends(entities, links.select("dst")).select(
        F.col("node_key").alias("t_key"), F.col("name").alias("t_name"), F.col("label").alias("t_label")
    )
    ends = targets.join(links, links.dst == targets.t_key).select("src", "type", "t_name", "t_label")
    touched = objects.join(ends, objects.node_key == ends.src, "left")

    def named_targets(kind, tables_only):
        ok = (F.col("type") == kind) & (F.col("t_name") != "")
        if tables_only:
            ok = ok & (F.col("t_label") == "SqlTable")
        return F.when(ok, F.col("t_name"))

    rows = (
        touched.groupBy("full_name", "label", "file", "line")
        .agg(
            distinct_list(named_targets("READS_TABLE", True)).alias("reads"),
            distinct_list(named_targets("WRITES_TABLE", True)).alias("writes"),
            distinct_list(named_targets("DEPENDS_ON_OBJECT", False)).alias("depends_on"),
            or_empty(F.min(named_targets("TRIGGERS_ON", True))).alias("triggers_on"),
        )
        .orderBy("full_name", "label", "file", "line")
    )
    return (
        first(rows, limit)
        .select(
            F.when(F.col("full_name").contains("."), F.regexp_replace("full_name", r"^[^.]*\.", ""))
            .otherwise(F.col("full_name")).alias("name"),
            F.when(F.col("full_name").contains("."), F.split_part("full_name", F.lit("."), F.lit(1)))
            .otherwise("").alias("schema"),
            F.col("label").alias("kind"),
            entity_labels(F.col("label")).alias("labels"),
            "file", "line", "reads", "writes", "depends_on", "triggers_on",
        )
    )


def _holds(names: Column, wanted: str) -> Column:
    return F.exists(names, lambda x: F.lower(x) == wanted)


def find_glue_jobs(entities, edges, ownership, source: str = "", target: str = "", limit: int | None = rules.GLUE_JOB_LIMIT) -> DataFrame:
    """Glue jobs with their tables, filtered by source or target membership."""
    jobs = entities.where(F.col("label") == "GlueJob").select(
        "node_key", "name", "label",
        or_empty(F.col("path")).alias("file"),
        or_empty(F.col("script")).alias("script"),
        or_empty(F.col("schedule")).alias("schedule"),
    )
    links = edges.where(F.col("type").isin("READS_SOURCE", "WRITES_DESTINATION")).select("src", "dst", "type")
    # With a table given, only the jobs that touch an entity of its name are looked at.
    for kind, wanted in (("READS_SOURCE", source), ("WRITES_DESTINATION", target)):
        if wanted.strip():
            named_so = few(entities.where(F.lower("name") == wanted.strip().lower()).select(F.col("node_key").alias("dst")))
            touching = few(links.where(F.col("type") == kind).join(named_so, "dst", "left_semi").select(F.col("src").alias("node_key")).distinct())
            jobs = jobs.join(touching, "node_key", "left_semi")
    if source.strip() or target.strip():
        jobs = few(jobs)
        links = few(links.join(jobs.select("node_key"), links.src == jobs.node_key, "left_semi"))
        entities = _ends(entities, links.select("dst"))
    targets = entities.select(F.col("node_key").alias("t_key"), F.col("name").alias("t_name"))
    tables = (
        links.join(targets, links.dst == targets.t_key)
        .groupBy("src")
        .agg(
            distinct_list(F.when((F.col("type") == "READS_SOURCE") & (F.col("t_name") != ""), F.col("t_name"))).alias("sources"),
            distinct_list(F.when((F.col("type") == "WRITES_DESTINATION") & (F.col("t_name") != ""), F.col("t_name"))).alias("targets"),
        )
    )
    owners = ownership.select(F.col("node_key").alias("o_key"), F.col("repo").alias("owner"))
    empty = F.array().cast("array<string>")
    rows = (
        jobs.join(owners, jobs.node_key == owners.o_key, "left")
        .join(tables, F.col("node_key") == F.col("src"), "left")
        .withColumn("sources", F.coalesce("sources", empty))
        .withColumn("targets", F.coalesce("targets", empty))
    )
    for column, wanted in (("sources", source), ("targets", target)):
        wanted = wanted.strip().lower()
        if wanted:
            rows = rows.where(_holds(F.col(column), wanted))
    return (
        first(rows.withColumn("repo", or_empty(F.col("owner"))).orderBy("repo", "name", "node_key"), limit)
        .select(
            "name", "repo", entity_labels(F.col("label")).alias("labels"),
            "file", "script", "schedule", "sources", "targets",
        )
    )


def freshness_rows(repositories: DataFrame) -> DataFrame:
    """Repositories with a sync stamp, oldest first."""
    return (
        repositories.where(F.col("last_synced_at").isNotNull())
        .select(F.col("name").alias("repo"), "last_synced_at", "last_indexed_at")
        .orderBy("last_synced_at", "repo")
    )


def freshness(repositories: DataFrame, now: Column, clamp: bool = False) -> DataFrame:
    """Age and staleness per repository at ``now``."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_synced_at")
    if clamp:
        age = F.greatest(age, F.lit(0))
    return freshness_rows(repositories).withColumn("age_seconds", age).withColumn(
        "stale", F.col("age_seconds") > rules.FRESHNESS_SECONDS
    )


def freshness_verdict(repositories: DataFrame, now: Column) -> DataFrame:
    """Oldest age and overall verdict."""
    return freshness(repositories, now).agg(
        F.lit(rules.FRESHNESS_SECONDS).alias("stale_after_seconds"),
        F.greatest(F.coalesce(F.max("age_seconds"), F.lit(0)), F.lit(0)).alias("oldest_age_seconds"),
        F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale"),
        F.count(F.lit(1)).alias("repositories"),
    )


def api_surface(entities: DataFrame) -> DataFrame:
    """Documentation coverage of the route surface, per repository and in total."""
    count_if = lambda c: F.count(F.when(c, True))
    totals = (
        all_routes(entities)
        .rollup("repo")
        .agg(
            F.grouping("repo").alias("is_total"),
            F.count(F.lit(1)).alias("routes"),
            count_if(F.col("documented")).alias("documented"),
            count_if(~F.col("documented")).alias("undocumented"),
            count_if(F.col("classification") == "business").alias("business"),
        )
    )
    return totals.select(
        F.when(F.col("is_total") == 1, "(all)").otherwise(F.col("repo")).alias("repo"),
        "routes", "documented", "undocumented", "business",
        F.round(share(F.col("documented") * 100.0, F.col("routes"))).cast("long").alias("documented_pct"),
    )


def undocumented_routes(entities, **filters) -> DataFrame:
    """Routes that no specification documents; the list's limit counts only these."""
    return find_routes(entities.where(~F.coalesce("documented", F.lit(False))), **filters)


__all__ = [n for n in dir() if n.startswith(("find_", "freshness", "api_", "symbol_", "undoc"))] + [
    "normalize_symbol"
]
