"""Repository overview sections.

Every section is one grouped plan over all repositories, with ``repo`` as first
column; a single repository is the same plan behind a filter, which Spark pushes
into the scans.  Per-repository tops use ``row_number() <= k``, which Spark limits
within each input partition before the shuffle, so a repository holding a large
part of all rows sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import (
    contains_any,
    directory,
    distinct_list,
    entity_labels,
    or_empty,
)
from loomgraph.operators.lookup import all_routes, dependency_rows


def top_per(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def owned_entities(entities: DataFrame, ownership: DataFrame) -> DataFrame:
    """Owned entities, shared ones included, one row per owner."""
    own = ownership.select(F.col("repo").alias("owner"), "node_key")
    return own.join(entities.drop("repo"), "node_key").withColumnRenamed("owner", "repo")


def counts(repositories, edges, ownership) -> DataFrame:
    """Owned nodes, and edges stamped by the repository that leave an owned node."""
    nodes = ownership.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    out = edges.where(F.col("repo").isNotNull()).groupBy("repo", F.col("src").alias("node_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rels = (
        out.join(ownership.select("repo", "node_key"), ["repo", "node_key"])
        .groupBy("repo")
        .agg(F.sum("n").alias("rels"))
    )
    return (
        repositories.select(F.col("name").alias("repo"))
        .join(nodes, "repo", "left")
        .join(rels, "repo", "left")
        .select(
            "repo",
            F.coalesce("nodes", F.lit(0)).alias("nodes"),
            F.coalesce("rels", F.lit(0)).alias("rels"),
        )
    )


def label_counts(entities, ownership) -> DataFrame:
    """Owned entities per label."""
    labels = entities.select("node_key", "label")
    return (
        ownership.select("repo", "node_key")
        .join(labels, "node_key")
        .groupBy("repo", F.col("label").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("repo", F.desc("count"), "name")
    )


def languages(entities) -> DataFrame:
    """Entities per language, by the entity's own repository."""
    return (
        entities.where(F.col("repo").isNotNull() & (or_empty(F.col("language")) != ""))
        .groupBy("repo", F.col("language").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("repo", F.desc("count"), "name")
    )


def community_counts(entities) -> DataFrame:
    """Communities of each repository, all of them."""
    rows = entities.where(F.col("repo").isNotNull() & F.col("community").isNotNull())
    return rows.groupBy("repo").agg(F.count_distinct("community").alias("communities"))


def communities(entities) -> DataFrame:
    """Largest communities with sample members, main directory and label.

    Sizes and main directories count every member; only the listing is short.
    """
    keys = ["repo", "community"]
    members = entities.where(F.col("repo").isNotNull() & F.col("community").isNotNull()).select(
        *keys, "node_key", "name", or_empty(F.col("path")).alias("path")
    )
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    largest = top_per(
        sizes, ["repo"], [F.desc("size"), "community"], rules.OVERVIEW_COMMUNITIES, "position"
    )
    sample = top_per(members, keys, ["node_key"], rules.OVERVIEW_COMMUNITY_NAMES)
    dirs = (
        members.where(F.col("path") != "")
        .groupBy(*keys, directory(F.col("path")).alias("dir"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.min_by("dir", F.struct(-F.col("n"), F.col("dir"))).alias("dominant_dir"))
    )
    # At most eight names per group are collected.
    names = (
        sample.where(or_empty(F.col("name")) != "")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("ranked"))
        .select(*keys, F.col("ranked.name").alias("sample_members"))
    )
    rows = largest.join(dirs, keys, "left").join(names, keys, "left")
    members_list = F.coalesce("sample_members", F.array().cast("array<string>"))
    main = or_empty(F.col("dominant_dir"))
    return rows.select(
        "repo", "position",
        F.col("community").alias("id"),
        F.when((main != "") & (main != "."), main)
        .otherwise(F.coalesce(F.get(members_list, F.lit(0)), F.lit("misc")))
        .alias("label"),
        "size",
        main.alias("dominant_dir"),
        members_list.alias("sample_members"),
    )


def entry_point_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low == "main()", "executable_main")
        .when(low.contains("server") | low.contains("listenandserve") | low.startswith("serve"), "server")
        .otherwise("bootstrap")
    )


def _kind_rank(kind: Column) -> Column:
    return F.when(kind == "executable_main", 0).when(kind == "server", 1).otherwise(2)


def _starts(entities) -> DataFrame:
    """Functions that look like program, server or bootstrap starts."""
    low = F.col("name_lower")
    starts = low.startswith("serve") | low.startswith("start") | low.startswith("bootstrap") | low.startswith("run(")
    shaped = (low == "main()") | contains_any(low, ("newserver", "listenandserve", "runserver")) | starts
    return entities.where(F.col("repo").isNotNull() & (F.col("label") == "Function") & shaped).select(
        "repo", "node_key", "name", or_empty(F.col("path")).alias("path"),
        or_empty(F.col("line")).alias("line"), entity_labels(F.col("label")).alias("labels"),
    )


def entry_points(entities) -> DataFrame:
    """The first functions that look like program, server or bootstrap starts."""
    first = top_per(_starts(entities), ["repo"], ["path", "name", "node_key"], rules.OVERVIEW_ENTRY_POINTS, "by_path")
    first = first.withColumn("kind", entry_point_kind(F.col("name")))
    ordered = Window.partitionBy("repo").orderBy(_kind_rank(F.col("kind")), "by_path")
    return first.select(
        "repo", F.row_number().over(ordered).alias("position"), "name", "kind", "path", "line", "labels"
    )


def modules(entities) -> DataFrame:
    """Directories by node and function count."""
    rows = (
        entities.where(F.col("repo").isNotNull() & (or_empty(F.col("path")) != ""))
        .groupBy("repo", directory(F.col("path")).alias("package"))
        .agg(
            F.count(F.lit(1)).alias("nodes"),
            F.count(F.when(F.col("label") == "Function", True)).alias("functions"),
        )
    )
    return top_per(
        rows, ["repo"], [F.desc("nodes"), "package"], rules.OVERVIEW_MODULES, "position"
    ).select("repo", "position", "package", "nodes", "functions")


def degrees(edges, ownership) -> DataFrame:
    """Edges touching each node, ownership included; a self edge counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_key"))
    return (
        ends.unionByName(ownership.select("node_key"))
        .groupBy("node_key")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def hubs(entities, edges, ownership) -> DataFrame:
    """Highest-degree nodes of each repository."""
    nodes = entities.where(F.col("repo").isNotNull()).select(
        "repo", "node_key", "name", or_empty(F.col("path")).alias("path"),
        entity_labels(F.col("label")).alias("labels"),
        F.coalesce("community", F.lit(-1)).alias("community"),
    )
    ranked = nodes.join(degrees(edges, ownership), "node_key", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )
    return top_per(
        ranked, ["repo"], [F.desc("degree"), "name", "node_key"], rules.OVERVIEW_HUBS, "position"
    ).select("repo", "position", "name", "path", "labels", "community", "degree")


def kafka_topics(entities, edges, ownership) -> DataFrame:
    """Topics a repository touches with everyone producing or consuming them."""
    topics = entities.where(F.col("label") == "KafkaTopic").select(
        "node_key", F.col("name").alias("topic")
    )
    owned = ownership.select("repo", "node_key").join(topics, "node_key")
    names = entities.select(F.col("node_key").alias("src"), F.col("name").alias("party"))
    links = edges.where(F.col("type").isin("PRODUCES", "CONSUMES")).select("src", "dst", "type")

    def side(kind):
        return distinct_list(F.when((F.col("type") == kind) & (F.col("party") != ""), F.col("party")))

    sides = links.join(names, "src").groupBy(F.col("dst").alias("node_key")).agg(
        side("PRODUCES").alias("producers"), side("CONSUMES").alias("consumers")
    )
    empty = F.array().cast("array<string>")
    return owned.join(sides, "node_key", "left").select(
        "repo", "topic",
        F.coalesce("producers", empty).alias("producers"),
        F.coalesce("consumers", empty).alias("consumers"),
    )


def kafka_summary(entities, edges, ownership) -> DataFrame:
    """Topic, producer and consumer lists of each repository.

    Lists are made of distinct (repository, kind, party) rows, which combine before the shuffle.
    """
    topics = entities.where(F.col("label") == "KafkaTopic").select("node_key", F.col("name").alias("topic"))
    owned = ownership.select("repo", "node_key").join(topics, "node_key")
    names = entities.select(F.col("node_key").alias("src"), F.col("name").alias("party"))
    links = edges.where(F.col("type").isin("PRODUCES", "CONSUMES")).select("src", F.col("dst").alias("node_key"), "type")
    flows = links.join(names, "src").where("party <> ''").select("node_key", "type", "party").distinct()
    parties = owned.select("repo", "node_key").join(flows, "node_key").select("repo", "type", "party").distinct()

    def side(kind):
        return F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("party"))))

    empty = F.array().cast("array<string>")
    lists = parties.groupBy("repo").agg(side("PRODUCES").alias("producers"), side("CONSUMES").alias("consumers"))
    rows = owned.groupBy("repo").agg(F.sort_array(F.collect_list("topic")).alias("topics")).join(lists, "repo", "left")
    return rows.select("repo", "topics", F.coalesce("producers", empty).alias("producers"), F.coalesce("consumers", empty).alias("consumers"))


_SQL_GROUPS = {
    "SqlSchema": "schemas",
    "SqlTable": "tables",
    "SqlView": "views",
    "SqlProcedure": "procedures",
    "SqlFunction": "functions",
    "SqlTrigger": "triggers",
}


def sql_summary(entities, ownership) -> DataFrame:
    """Names of the SQL objects a repository touches, by kind."""
    objects = entities.where(F.col("label").isin(*_SQL_GROUPS)).select("node_key", "label", "name")
    owned = ownership.select("repo", "node_key").join(objects, "node_key")
    return owned.groupBy("repo").agg(
        *[
            distinct_list(F.when(F.col("label") == kind, F.col("name"))).alias(column)
            for kind, column in _SQL_GROUPS.items()
        ]
    )


def route_prefix(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "^/", "")
    return F.concat(F.lit("/"), F.regexp_extract(trimmed, "^([^/]*(?:/[^/]*)?)", 1))


def _routes(entities) -> DataFrame:
    return all_routes(entities).where(F.col("raw_repo").isNotNull())


def route_methods(entities) -> DataFrame:
    """Method distribution of all routes."""
    return (
        _routes(entities)
        .where(F.col("method") != "")
        .groupBy("repo", F.col("method").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def route_groups(entities) -> DataFrame:
    """All routes grouped by their first two path segments."""
    groups = (
        _routes(entities)
        .groupBy("repo", route_prefix(F.col("path")).alias("prefix"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            distinct_list(F.when(F.col("method") != "", F.col("method"))).alias("methods"),
        )
    )
    return groups.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("count"), "prefix")),
    )


def _dependencies(entities, edges) -> DataFrame:
    return dependency_rows(entities, edges).withColumn("repo", F.expr("substring(hub_id, 7)"))


def internal_dependencies(entities, edges) -> DataFrame:
    """Cross-repository dependency names."""
    rows = _dependencies(entities, edges).where("cross")
    return rows.groupBy("repo").agg(distinct_list(F.col("target_name")).alias("internal_repos"))


def external_dependencies(entities, edges) -> DataFrame:
    """The first external packages of each repository."""
    rows = _dependencies(entities, edges).where("NOT cross")
    return top_per(
        rows, ["repo"], ["ecosystem", "target_name", "target_key", "scope"], rules.OVERVIEW_EXTERNAL_DEPS, "position"
    ).select("repo", "position", F.col("target_name").alias("name"), "ecosystem", "version", "scope", "confidence")


def dependency_ecosystems(entities, edges) -> DataFrame:
    """External dependencies per ecosystem."""
    return (
        _dependencies(entities, edges)
        .where("NOT cross AND ecosystem <> ''")
        .groupBy("repo", F.col("ecosystem").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def module_role(package: Column) -> Column:
    low = F.lower(package)
    return (
        F.when(contains_any(low, rules.INFRA_MODULE_KEYS), "infrastructure")
        .when(contains_any(low, rules.UTILITY_MODULE_KEYS), "utilities")
        .otherwise("core_packages")
    )


def reading_order(entities, edges, ownership) -> DataFrame:
    """Onboarding steps of at most eight items each.

    The items come from sections that are already capped per repository.
    """
    k = rules.OVERVIEW_READING_ITEMS
    starts = entry_points(entities).select(
        "repo", F.lit("entry_points").alias("category"), F.lit(0).alias("part"), "position",
        F.concat("name", F.lit(" @ "), "path").alias("item"),
    )
    mods = (
        modules(entities)
        .where(~contains_any(F.lower("package"), rules.NOISE_MODULE_KEYS))
        .select(
            "repo", module_role(F.col("package")).alias("category"), F.lit(0).alias("part"), "position",
            F.col("package").alias("item"),
        )
    )
    routes = route_groups(entities).select(
        "repo", F.lit("services").alias("category"), F.lit(0).alias("part"), "position",
        F.concat(F.lit("routes "), "prefix", F.lit(" ("), F.col("count").cast("string"), F.lit(")")).alias("item"),
    )
    owned = ownership.select("repo", "node_key").join(
        entities.where(F.col("label").isin("KafkaTopic", "SqlTable")).select("node_key", "label", "name"),
        "node_key",
    )
    shared = owned.select("repo", "label", "name").distinct()
    shared = top_per(shared, ["repo", "label"], ["name"], k, "position").select(
        "repo", F.lit("services").alias("category"),
        F.when(F.col("label") == "KafkaTopic", 1).otherwise(2).alias("part"), "position",
        F.concat(F.when(F.col("label") == "KafkaTopic", "topic ").otherwise("table "), "name").alias("item"),
    )
    items = starts.unionByName(mods).unionByName(routes).unionByName(shared)
    capped = top_per(items, ["repo", "category"], ["part", "position"], k)
    steps = {name: i + 1 for i, name in enumerate(rules.READING_STEPS)}
    step = F.lit(None).cast("int")
    why = F.lit(None).cast("string")
    for name, number in steps.items():
        step = F.when(F.col("category") == name, number).otherwise(step)
        why = F.when(F.col("category") == name, rules.READING_STEPS[name]).otherwise(why)
    return (
        capped.groupBy("repo", "category")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("ranked"))
        .select("repo", step.alias("step"), "category", why.alias("why"), F.col("ranked.item").alias("items"))
    )


def summary_line(repositories, entities, edges, ownership) -> DataFrame:
    """One text line per repository that has nodes."""
    base = counts(repositories, edges, ownership).where("nodes > 0")
    n_communities = community_counts(entities)
    kinds = top_per(
        label_counts(entities, ownership), ["repo"], [F.desc("count"), "name"], 2
    ).groupBy("repo").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", F.concat(F.col("count").cast("string"), F.lit(" "), "name").alias("text")))
        ).alias("kinds")
    )
    routes = _routes(entities).groupBy("repo").agg(F.count(F.lit(1)).alias("routes"))
    owned = ownership.select("repo", "node_key").join(
        entities.where(F.col("label").isin("KafkaTopic", "SqlTable", "SqlProcedure", "SqlView", "SqlFunction"))
        .select("node_key", "label", "name"),
        "node_key",
    )
    objects = owned.groupBy("repo").agg(
        F.count_distinct(F.when(F.col("label") == "KafkaTopic", F.col("name"))).alias("topics"),
        F.count_distinct(F.when(F.col("label") != "KafkaTopic", F.struct("label", "name"))).alias("sql_objects"),
    )
    starts = _starts(entities).groupBy("repo").agg(F.count(F.lit(1)).alias("starts"))
    rows = base
    for part in (n_communities, kinds, routes, objects, starts):
        rows = rows.join(part, "repo", "left")

    def phrase(column, unit):
        n = F.coalesce(column, F.lit(0))
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}")))

    head = F.format_string(
        "%s: %d nodes, %d relationships, %d communities",
        "repo", "nodes", "rels", F.coalesce("communities", F.lit(0)),
    )
    kinds_text = F.array_join(F.col("kinds.text"), ", ")
    line = F.concat_ws(
        ", ", head, F.when(kinds_text != "", kinds_text),
        phrase("routes", "HTTP routes"), phrase("topics", "Kafka topics"),
        phrase("sql_objects", "SQL objects"), phrase("starts", "entry points"),
    )
    return rows.select("repo", F.concat(line, F.lit(".")).alias("summary"))


def repository_overview(repositories, entities, edges, ownership, repo: str) -> dict[str, DataFrame]:
    """All sections of one repository, each a lazy plan."""
    if not repo:
        raise ValueError("repo required")
    size = counts(repositories, edges, ownership).where((F.col("repo") == repo) & (F.col("nodes") > 0))
    if size.isEmpty():
        raise LookupError(f"repository {repo!r} has no indexed nodes")
    sections = {
        "counts": size,
        "node_kinds": label_counts(entities, ownership),
        "languages": languages(entities),
        "communities": communities(entities),
        "entry_points": entry_points(entities),
        "modules": modules(entities),
        "components": hubs(entities, edges, ownership),
        "kafka": kafka_topics(entities, edges, ownership),
        "sql": sql_summary(entities, ownership),
        "route_methods": route_methods(entities),
        "route_groups": route_groups(entities),
        "internal_repos": internal_dependencies(entities, edges),
        "external": external_dependencies(entities, edges),
        "ecosystems": dependency_ecosystems(entities, edges),
        "reading_order": reading_order(entities, edges, ownership),
        "summary": summary_line(repositories, entities, edges, ownership),
    }
    return {name: df.where(F.col("repo") == repo) for name, df in sections.items()}


def overview_documents(repositories, entities, edges, ownership) -> DataFrame:
    """One nested row per repository, all repositories in one plan."""

    def nested(df: DataFrame, name: str, sort_by: list[str], *fields: str) -> DataFrame:
        # Each section holds a bounded number of rows per repository.
        row = F.struct(*sort_by, *[f for f in fields if f not in sort_by])
        return df.groupBy("repo").agg(F.array_sort(F.collect_list(row)).alias(name))

    sections = [
        nested(label_counts(entities, ownership), "node_kinds", ["name"], "count"),
        nested(languages(entities), "languages", ["name"], "count"),
        nested(communities(entities), "communities", ["position"], "id", "label", "size", "dominant_dir", "sample_members"),
        nested(entry_points(entities), "entry_points", ["position"], "name", "kind", "path", "line"),
        nested(modules(entities), "modules", ["position"], "package", "nodes", "functions"),
        nested(hubs(entities, edges, ownership), "components", ["position"], "name", "path", "community", "degree"),
        kafka_summary(entities, edges, ownership).select("repo", F.struct("topics", "producers", "consumers").alias("kafka")),
        sql_summary(entities, ownership).select("repo", F.struct(*_SQL_GROUPS.values()).alias("sql")),
        nested(route_groups(entities), "route_groups", ["position"], "prefix", "count", "methods"),
        internal_dependencies(entities, edges),
        nested(dependency_ecosystems(entities, edges), "ecosystems", ["name"], "count"),
        nested(reading_order(entities, edges, ownership), "reading_order", ["step"], "category", "why", "items"),
        summary_line(repositories, entities, edges, ownership),
    ]
    rows = counts(repositories, edges, ownership).where("nodes > 0")
    for section in sections:
        rows = rows.join(section, "repo", "left")
    return rows
