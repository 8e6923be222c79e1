"""Registered overview sections and reports (group G, A7, A8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import overview, reports
from loomgraph.plans.projections import NOW
from loomgraph.plans.registry import ORACLES, query

_DIR = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"


def _any(column: str, keys) -> str:
    return "(" + " OR ".join(f"contains({column}, '{k}')" for k in keys) + ")"


@query(
    "a7_repository_sizes",
    """
    SELECT name, CAST(coalesce(n, 0) AS BIGINT) AS nodes
    FROM repositories LEFT JOIN (SELECT repo, count(*) AS n FROM ownership GROUP BY repo) ON repo = name
    """,
)
def a7_repository_sizes(t):
    return reports.repository_sizes(t.repositories(), t.ownership())


@query(
    "a8_repository_names",
    "SELECT name FROM repositories UNION SELECT repo FROM entities WHERE coalesce(repo, '') <> ''",
)
def a8_repository_names(t):
    return reports.repository_names(t.repositories(), t.entities())


_COUNTS = """
    SELECT name AS repo, CAST(coalesce(n, 0) AS BIGINT) AS nodes, CAST(coalesce(r, 0) AS BIGINT) AS rels
    FROM repositories LEFT JOIN (SELECT repo, count(*) AS n FROM ownership GROUP BY repo) o ON o.repo = name
    LEFT JOIN (SELECT e.repo, count(*) AS r FROM edges e JOIN ownership w ON w.repo = e.repo AND w.node_key = e.src
               GROUP BY e.repo) x ON x.repo = name
"""


@query("g2_counts", _COUNTS)
def g2_counts(t):
    return overview.counts(t.repositories(), t.edges(), t.ownership())


_LABELS = """
    SELECT o.repo, label AS name, count(*) AS "count" FROM ownership o JOIN entities e ON o.node_key = e.node_key
    GROUP BY o.repo, label
"""


@query("g3_label_counts", _LABELS)
def g3_label_counts(t):
    return overview.label_counts(t.entities(), t.ownership())


@query(
    "g4_languages",
    "SELECT repo, language AS name, count(*) AS count FROM entities WHERE repo IS NOT NULL AND coalesce(language, '') <> '' GROUP BY 1, 2",
)
def g4_languages(t):
    return overview.languages(t.entities())


_COMM = f"""
    m AS (SELECT repo, community, node_key, name, coalesce(path, '') AS path,
                 row_number() OVER (PARTITION BY repo, community ORDER BY node_key) AS rn
          FROM entities WHERE repo IS NOT NULL AND community IS NOT NULL),
    sz AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, community) AS position
           FROM (SELECT repo, community, count(*) AS size FROM m GROUP BY 1, 2)),
    dd AS (SELECT repo, community, dir, row_number() OVER (PARTITION BY repo, community ORDER BY count(*) DESC, dir) AS r
           FROM (SELECT repo, community, {_DIR} AS dir FROM m WHERE path <> '') GROUP BY 1, 2, 3),
    nm AS (SELECT repo, community, string_agg(name, '|' ORDER BY rn) AS names, min_by(name, rn) AS first_name
           FROM m WHERE rn <= 8 AND name <> '' GROUP BY 1, 2),
    comm AS (SELECT sz.repo, position, sz.community AS id,
           CASE WHEN coalesce(dir, '') NOT IN ('', '.') THEN dir ELSE coalesce(first_name, 'misc') END AS label,
           size, coalesce(dir, '') AS dominant_dir, coalesce(names, '') AS sample_members
    FROM sz LEFT JOIN (SELECT * FROM dd WHERE r = 1) d ON d.repo = sz.repo AND d.community = sz.community
    LEFT JOIN nm ON nm.repo = sz.repo AND nm.community = sz.community WHERE position <= 12)
"""


@query("g5_communities", f"RECURSIVE {_COMM} SELECT * FROM comm")
def g5_communities(t):
    return overview.communities(t.entities())


_ENTRY = """
    ep0 AS (SELECT repo, node_key, name, path, line, label,
               row_number() OVER (PARTITION BY repo ORDER BY path, name, node_key) AS by_path,
               CASE WHEN name_lower = 'main()' THEN 'executable_main'
                    WHEN contains(name_lower, 'server') OR contains(name_lower, 'listenandserve')
                      OR name_lower LIKE 'serve%' THEN 'server' ELSE 'bootstrap' END AS kind
        FROM entities WHERE repo IS NOT NULL AND label = 'Function' AND (name_lower = 'main()'
          OR contains(name_lower, 'newserver') OR contains(name_lower, 'listenandserve')
          OR contains(name_lower, 'runserver') OR name_lower LIKE 'serve%' OR name_lower LIKE 'start%'
          OR name_lower LIKE 'bootstrap%' OR name_lower LIKE 'run(%')),
    ep AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY
                 CASE kind WHEN 'executable_main' THEN 0 WHEN 'server' THEN 1 ELSE 2 END, by_path) AS position,
               name, kind, path, line, 'Entity|' || label AS labels
        FROM ep0 WHERE by_path <= 100)
"""


@query("g6_entry_points", f"RECURSIVE {_ENTRY} SELECT * FROM ep")
def g6_entry_points(t):
    return overview.entry_points(t.entities())


_MODS = f"""
    mods AS (SELECT * FROM (
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, package) AS position, package,
               count(*) AS nodes, count(*) FILTER (WHERE label = 'Function') AS functions
        FROM (SELECT repo, label, {_DIR} AS package FROM entities
              WHERE repo IS NOT NULL AND coalesce(path, '') <> '') GROUP BY repo, package) WHERE position <= 30)
"""


@query("g7_modules", f"RECURSIVE {_MODS} SELECT * FROM mods")
def g7_modules(t):
    return overview.modules(t.entities())


@query(
    "g8_hubs",
    """
    SELECT * FROM (
      SELECT e.repo, row_number() OVER (PARTITION BY e.repo ORDER BY coalesce(degree, 0) DESC, name, e.node_key) AS position,
             name, coalesce(path, '') AS path, 'Entity|' || label AS labels, coalesce(community, -1) AS community,
             CAST(coalesce(degree, 0) AS BIGINT) AS degree
      FROM entities e LEFT JOIN (
        SELECT k, count(*) AS degree FROM (
          SELECT src AS k FROM edges UNION ALL SELECT dst FROM edges WHERE dst <> src
          UNION ALL SELECT node_key FROM ownership) GROUP BY k) ON k = e.node_key
      WHERE e.repo IS NOT NULL) WHERE position <= 15
    """,
)
def g8_hubs(t):
    return overview.hubs(t.entities(), t.edges(), t.ownership())


_KAFKA = """
    SELECT o.repo, k.name AS topic,
      coalesce((SELECT string_agg(DISTINCT p.name, '|' ORDER BY p.name) FROM edges r JOIN entities p ON r.src = p.node_key
                WHERE r.dst = k.node_key AND r.type = 'PRODUCES'), '') AS producers,
      coalesce((SELECT string_agg(DISTINCT p.name, '|' ORDER BY p.name) FROM edges r JOIN entities p ON r.src = p.node_key
                WHERE r.dst = k.node_key AND r.type = 'CONSUMES'), '') AS consumers
    FROM ownership o JOIN entities k ON o.node_key = k.node_key WHERE k.label = 'KafkaTopic'
"""


@query("g9_kafka_topics", _KAFKA)
def g9_kafka_topics(t):
    return overview.kafka_topics(t.entities(), t.edges("PRODUCES", "CONSUMES"), t.ownership())


@query(
    "g9_kafka_summary",
    f"""
    SELECT repo, string_agg(topic, '|' ORDER BY topic) AS topics,
      array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(producers, '|'))), lambda x: x <> ''))), '|') AS producers,
      array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(consumers, '|'))), lambda x: x <> ''))), '|') AS consumers
    FROM ({_KAFKA}) GROUP BY repo
    """,
)
def g9_kafka_summary(t):
    return overview.kafka_summary(t.entities(), t.edges("PRODUCES", "CONSUMES"), t.ownership())


_SQLSUM = "SELECT o.repo, " + ", ".join(
    f"coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (WHERE label = '{k}'), '') AS {c}"
    for k, c in (
        ("SqlSchema", "schemas"), ("SqlTable", "tables"), ("SqlView", "views"),
        ("SqlProcedure", "procedures"), ("SqlFunction", "functions"), ("SqlTrigger", "triggers"),
    )
) + " FROM ownership o JOIN entities e ON o.node_key = e.node_key WHERE label LIKE 'Sql%' GROUP BY o.repo"


@query("g10_sql_summary", _SQLSUM)
def g10_sql_summary(t):
    return overview.sql_summary(t.entities(), t.ownership())


_LISTED = """
    rts AS (SELECT repo, split_part(name, ' ', 1) AS method, substr(name, strpos(name, ' ') + 1) AS rpath
            FROM entities WHERE label = 'HttpRoute'),
    rgroups AS (SELECT repo, prefix, count(*) AS "count", string_agg(DISTINCT method, '|' ORDER BY method) AS methods,
               row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, prefix) AS position
            FROM (SELECT *, '/' || regexp_extract(regexp_replace(rpath, '^/', ''), '^([^/]*(?:/[^/]*)?)', 1) AS prefix FROM rts)
            GROUP BY repo, prefix)
"""


@query("g11_route_methods", f'RECURSIVE {_LISTED} SELECT repo, method AS name, count(*) AS "count" FROM rts GROUP BY 1, 2')
def g11_route_methods(t):
    return overview.route_methods(t.entities())


@query("g11_route_groups", f"RECURSIVE {_LISTED} SELECT * FROM rgroups")
def g11_route_groups(t):
    return overview.route_groups(t.entities())


_DEPS = """
    dps AS (SELECT substr(h.node_id, 7) AS repo, p.name, p.node_key AS pk, coalesce(p.ecosystem, '') AS ecosystem,
             coalesce(p.version, '') AS version, coalesce(d.context, '') AS scope, d.type = 'DEPENDS_ON_REPO' AS crs,
             coalesce(d.confidence, '') AS confidence,
             row_number() OVER (PARTITION BY h.node_id ORDER BY coalesce(p.ecosystem, ''), p.name, p.node_key,
                                d.type = 'DEPENDS_ON_REPO', coalesce(d.context, '')) AS rn
      FROM edges d JOIN entities h ON d.src = h.node_key JOIN entities p ON d.dst = p.node_key
      WHERE h.node_id LIKE 'repo::%' AND d.type IN ('DEPENDS_ON', 'DEPENDS_ON_REPO'))
"""


@query(
    "g12_internal_dependencies",
    f"RECURSIVE {_DEPS} SELECT repo, string_agg(DISTINCT name, '|' ORDER BY name) AS internal_repos FROM dps WHERE crs GROUP BY repo",
)
def g12_internal_dependencies(t):
    return overview.internal_dependencies(t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"))


@query(
    "g12_external_dependencies",
    f"""RECURSIVE {_DEPS} SELECT * FROM (
      SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rn) AS position, name, ecosystem, version, scope, confidence
      FROM dps WHERE NOT crs) WHERE position <= 100""",
)
def g12_external_dependencies(t):
    return overview.external_dependencies(t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"))


@query(
    "g12_dependency_ecosystems",
    f"""RECURSIVE {_DEPS} SELECT repo, ecosystem AS name, count(*) AS "count" FROM dps
    WHERE NOT crs AND ecosystem <> '' GROUP BY 1, 2""",
)
def g12_dependency_ecosystems(t):
    return overview.dependency_ecosystems(t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"))


_WHY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.READING_STEPS.items())
_STEP = " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(rules.READING_STEPS))


@query(
    "g13_reading_order",
    f"""RECURSIVE {_ENTRY}, {_MODS}, {_LISTED},
    shared AS (SELECT DISTINCT o.repo, label, name FROM ownership o JOIN entities e ON o.node_key = e.node_key
               WHERE label IN ('KafkaTopic', 'SqlTable')),
    items AS (
      SELECT repo, 'entry_points' AS category, 0 AS part, position, name || ' @ ' || path AS item FROM ep
      UNION ALL
      SELECT repo, CASE WHEN {_any('lower(package)', rules.INFRA_MODULE_KEYS)} THEN 'infrastructure'
                        WHEN {_any('lower(package)', rules.UTILITY_MODULE_KEYS)} THEN 'utilities'
                        ELSE 'core_packages' END, 0, position, package
      FROM mods WHERE NOT {_any('lower(package)', rules.NOISE_MODULE_KEYS)}
      UNION ALL
      SELECT repo, 'services', 0, position, 'routes ' || prefix || ' (' || "count" || ')' FROM rgroups
      UNION ALL
      SELECT repo, 'services', CASE label WHEN 'KafkaTopic' THEN 1 ELSE 2 END,
             row_number() OVER (PARTITION BY repo, label ORDER BY name),
             CASE label WHEN 'KafkaTopic' THEN 'topic ' ELSE 'table ' END || name FROM shared),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY part, position) AS rk FROM items)
    SELECT repo, CAST(CASE category {_STEP} END AS BIGINT) AS step, category, CASE category {_WHY} END AS why,
           string_agg(item, '|' ORDER BY rk) AS items
    FROM ranked WHERE rk <= 8 GROUP BY repo, category
    """,
)
def g13_reading_order(t):
    return overview.reading_order(t.entities(), t.edges(), t.ownership())


@query(
    "g14_summary_line",
    f"""RECURSIVE {_ENTRY}, {_LISTED}, {_COMM},
    cts AS ({_COUNTS}),
    lbl AS (SELECT repo, string_agg("count" || ' ' || name, ', ' ORDER BY rk) AS kinds FROM (
              SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "count" DESC, name) AS rk FROM ({_LABELS}))
            WHERE rk <= 2 GROUP BY repo),
    own AS (SELECT DISTINCT o.repo, label, name FROM ownership o JOIN entities e ON o.node_key = e.node_key
            WHERE label IN ('KafkaTopic', 'SqlTable', 'SqlProcedure', 'SqlView', 'SqlFunction'))
    SELECT repo, repo || ': ' || nodes || ' nodes, ' || rels || ' relationships, '
        || (SELECT count(*) FROM sz WHERE sz.repo = cts.repo) || ' communities'
        || (SELECT ', ' || kinds FROM lbl WHERE lbl.repo = cts.repo)
        || (SELECT CASE WHEN count(*) > 0 THEN ', ' || count(*) || ' HTTP routes' ELSE '' END FROM rts WHERE rts.repo = cts.repo)
        || (SELECT CASE WHEN count(*) > 0 THEN ', ' || count(*) || ' Kafka topics' ELSE '' END FROM own WHERE own.repo = cts.repo AND label = 'KafkaTopic')
        || (SELECT CASE WHEN count(*) > 0 THEN ', ' || count(*) || ' SQL objects' ELSE '' END FROM own WHERE own.repo = cts.repo AND label <> 'KafkaTopic')
        || (SELECT CASE WHEN count(*) > 0 THEN ', ' || count(*) || ' entry points' ELSE '' END FROM ep0 WHERE ep0.repo = cts.repo)
        || '.' AS summary
    FROM cts WHERE nodes > 0
    """,
)
def g14_summary_line(t):
    return overview.summary_line(t.repositories(), t.entities(), t.edges(), t.ownership())


# Sections of an overview document: the query that has their rows, what a row reads, and its order.
_SECTIONS = {
    "node_kinds": ("g3_label_counts", ("name", "count"), "name"),
    "languages": ("g4_languages", ("name", "count"), "name"),
    "communities": ("g5_communities", ("position", "id", "size"), "position"),
    "entry_points": ("g6_entry_points", ("position", "name", "kind", "path"), "position"),
    "modules": ("g7_modules", ("position", "package", "nodes"), "position"),
    "components": ("g8_hubs", ("position", "name", "degree"), "position"),
    "route_groups": ("g11_route_groups", ("position", "prefix", "count"), "position"),
    "ecosystems": ("g12_dependency_ecosystems", ("name", "count"), "name"),
    "reading_order": ("g13_reading_order", ("step", "category"), "step"),
}


def _documents_sql() -> str:
    parts = [f"SELECT c.repo, c.nodes, k.topics, k.producers, k.consumers, q.tables, q.procedures, s.summary, {', '.join(_SECTIONS)} FROM ({ORACLES['g2_counts']}) c"]
    for name, (source, fields, order) in _SECTIONS.items():
        text = " || ':' || ".join(f"coalesce(CAST(\"{f}\" AS VARCHAR), '')" for f in fields)
        parts.append(f"LEFT JOIN (SELECT repo, string_agg({text}, '|' ORDER BY \"{order}\") AS {name} FROM ({ORACLES[source]}) GROUP BY repo) USING (repo)")
    for alias, source in (("k", "g9_kafka_summary"), ("q", "g10_sql_summary"), ("s", "g14_summary_line")):
        parts.append(f"LEFT JOIN ({ORACLES[source]}) {alias} ON {alias}.repo = c.repo")
    return " ".join(parts) + " WHERE c.nodes > 0"


@query("g15_overview_documents", _documents_sql())
def g15_overview_documents(t):
    """Every section of the document of each repository, read out as text."""
    docs = overview.overview_documents(t.repositories(), t.entities(), t.edges(), t.ownership())

    def read(name, fields):
        text = ", ".join(f"coalesce(CAST(x.`{f}` AS STRING), '')" for f in fields)
        return F.expr(f"transform({name}, x -> concat_ws(':', {text}))").alias(name)

    return docs.select(
        "repo", "nodes", "kafka.topics", "kafka.producers", "kafka.consumers", "sql.tables", "sql.procedures", "summary",
        *[read(name, fields) for name, (_, fields, _) in _SECTIONS.items()],
    )


_ONE_REPOSITORY = {
    **{name: source for name, (source, _, _) in _SECTIONS.items()},
    "counts": "g2_counts", "kafka": "g9_kafka_topics", "sql": "g10_sql_summary", "route_methods": "g11_route_methods",
    "internal_repos": "g12_internal_dependencies", "external": "g12_external_dependencies", "summary": "g14_summary_line",
}


@query(
    "g15_repository_overview",
    " UNION ALL ".join(
        f"SELECT '{name}' AS section, CAST(count(*) AS BIGINT) AS rows FROM ({ORACLES[source]}) WHERE repo = 'NATION_3'" for name, source in _ONE_REPOSITORY.items()
    ),
)
def g15_repository_overview(t):
    """Size of each section of one repository's overview."""
    found = overview.repository_overview(t.repositories(), t.entities(), t.edges(), t.ownership(), "NATION_3")
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("section"), "rows") for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


_TIERS = ("EXTRACTED", "INFERRED", "AMBIGUOUS")


@query(
    "g16_confidence_report",
    """
    SELECT CASE WHEN grouping(type) = 1 THEN '(all)' ELSE type END AS type, count(*) AS total,
           count(*) FILTER (WHERE confidence = 'EXTRACTED') AS extracted,
           count(*) FILTER (WHERE confidence = 'INFERRED') AS inferred,
           count(*) FILTER (WHERE confidence = 'AMBIGUOUS') AS ambiguous,
           count(*) FILTER (WHERE coalesce(confidence, '') NOT IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')) AS unlabeled,
           round(count(*) FILTER (WHERE confidence = 'EXTRACTED') / count(*), 6) AS extracted_share
    FROM edges GROUP BY ROLLUP (type)
    """,
)
def g16_confidence_report(t):
    return reports.confidence_report(t.edges())


@query(
    "g17_route_report",
    """
    SELECT count(*) AS total, count(*) FILTER (WHERE documented) AS documented,
           count(*) FILTER (WHERE source = 'openapi') AS from_spec,
           count(*) FILTER (WHERE classification = 'business') AS business,
           count(*) FILTER (WHERE classification = 'infra') AS infra,
           round(count(*) FILTER (WHERE documented) / count(*), 6) AS documented_share,
           round(count(*) FILTER (WHERE classification = 'business') / count(*), 6) AS business_share
    FROM entities WHERE label = 'HttpRoute'
    """,
)
def g17_route_report(t):
    return reports.route_report(t.entities())


@query(
    "g18_repository_report",
    """
    SELECT name AS repo, CAST(coalesce(n, 0) AS BIGINT) AS entities, CAST(coalesce(c, 0) AS BIGINT) AS edges,
           round(CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE x / c END, 6) AS extracted_share
    FROM repositories LEFT JOIN (SELECT repo, count(*) AS n FROM ownership GROUP BY repo) o ON o.repo = name
    LEFT JOIN (SELECT repo, count(*) AS c, count(*) FILTER (WHERE confidence = 'EXTRACTED') AS x
               FROM edges GROUP BY repo) g ON g.repo = name
    """,
)
def g18_repository_report(t):
    return reports.repository_report(t.repositories(), t.edges(), t.ownership())


@query(
    "g19_graph_totals",
    f"""
    SELECT (SELECT count(*) FROM repositories) AS repositories, (SELECT count(*) FROM ownership) AS total_nodes,
           (SELECT count(*) FROM repositories WHERE epoch(TIMESTAMP '{NOW}') - epoch(last_synced_at) > 3600) AS stale_repos
    """,
)
def g19_graph_totals(t):
    return reports.graph_totals(t.repositories(), t.ownership(), F.lit(NOW).cast("timestamp"))
