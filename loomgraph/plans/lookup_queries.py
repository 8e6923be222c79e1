"""Registered lookups, search and traversals (groups E, F) and hotspots (G1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import hotspots as hot
from loomgraph.operators import lookup, search, traverse
from loomgraph.plans.projections import NOW
from loomgraph.plans.registry import query

_DEP = ", ".join(f"'{t}'" for t in rules.DEPENDENCY_TYPES)
_NOW = f"TIMESTAMP '{NOW}'"


def _spell(symbol: str) -> str:
    from loomgraph.functions.columns import symbol_spellings

    return "(" + ", ".join(f"'{s}'" for s in symbol_spellings(symbol)) + ")"


@query(
    "g1_hotspots",
    f"""
    SELECT name, e.repo, path, line, 'Entity|' || label AS labels, fan_in, dependent_repos
    FROM (SELECT dst, count(*) AS fan_in, count(DISTINCT repo) AS dependent_repos
          FROM edges WHERE src <> dst AND type IN ({_DEP}) GROUP BY dst)
    JOIN entities e ON dst = node_key
    ORDER BY fan_in DESC, name NULLS LAST, node_key LIMIT 25
    """,
)
def g1_hotspots(t):
    return hot.hotspots(t.entities(), t.edges(*rules.DEPENDENCY_TYPES))


@query(
    "g1_hotspots_scoped",
    f"""
    SELECT name, e.repo, path, line, 'Entity|' || label AS labels, fan_in, dependent_repos
    FROM (SELECT dst, count(*) AS fan_in, count(DISTINCT repo) AS dependent_repos
          FROM edges WHERE src <> dst AND type IN ({_DEP}) GROUP BY dst)
    JOIN entities e ON dst = node_key WHERE e.repo IN ('NATION_1', 'NATION_2', 'NATION_3')
    ORDER BY fan_in DESC, name NULLS LAST, node_key LIMIT 100
    """,
)
def g1_hotspots_scoped(t):
    return hot.hotspots(
        t.entities(), t.edges(*rules.DEPENDENCY_TYPES), ["NATION_1", "NATION_2", "NATION_3"], 1000
    )


_NORM = (
    "lower(trim(CASE WHEN strpos(trim(s), '(') > 1 THEN trim(s)[:strpos(trim(s), '(') - 1] ELSE trim(s) END))"
)


@query(
    "e1_e2_symbol_forms",
    f"""
    SELECT s AS symbol, n AS normalized, unnest(CASE
        WHEN base = '' THEN [base] WHEN base LIKE '%)' THEN [base, '.' || base]
        ELSE [base, base || '()', '.' || base, '.' || base || '()'] END) AS spelling
    FROM (SELECT s, {_NORM} AS n, regexp_replace({_NORM}, '^\\.', '') AS base
          FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN ' ' || c_name || '(a, b) ' WHEN 1 THEN '.' || c_name
                         WHEN 2 THEN '()' ELSE c_name END AS s FROM customer))
    """,
)
def e1_e2_symbol_forms(t):
    k = F.col("c_custkey") % 4
    typed = (
        F.when(k == 0, F.concat(F.lit(" "), "c_name", F.lit("(a, b) ")))
        .when(k == 1, F.concat(F.lit("."), "c_name"))
        .when(k == 2, "()")
        .otherwise(F.col("c_name"))
    )
    return lookup.symbol_forms(t.table("customer").select(typed.alias("symbol")))


@query(
    "e2_find_symbols_batch",
    """
    SELECT DISTINCT c_name AS symbol, node_key, name, e.repo, path, line, label
    FROM customer JOIN entities e
      ON e.name_lower IN (lower(c_name), lower(c_name) || '()', '.' || lower(c_name), '.' || lower(c_name) || '()')
    """,
)
def e2_find_symbols_batch(t):
    return lookup.find_symbols(t.entities(), t.table("customer").select(F.col("c_name").alias("symbol")))


@query(
    "e3_find_symbol",
    f"""
    SELECT node_key, name, repo, path, line, 'Entity|' || label AS labels, community FROM entities
    WHERE name_lower IN {_spell("Main")}
    ORDER BY repo NULLS LAST, path NULLS LAST, line NULLS LAST, node_key LIMIT 500
    """,
)
def e3_find_symbol(t):
    return lookup.find_symbol(t.entities(), "Main")


_CALL = """
    SELECT caller.name AS caller, caller.repo AS caller_repo, caller.path AS caller_path,
           caller.line AS caller_line, 'Entity|' || {far}.label AS labels, callee.name AS callee,
           callee.repo AS callee_repo, callee.path AS callee_path, coalesce(r.confidence, '') AS confidence
    FROM (SELECT * FROM edges WHERE type = 'CALLS') r
    JOIN entities caller ON r.src = caller.node_key JOIN entities callee ON r.dst = callee.node_key
    WHERE {near}.name_lower IN {names} AND {scope}
    ORDER BY {far}.repo NULLS LAST, {far}.path NULLS LAST, {far}.line NULLS LAST,
             caller.node_key, callee.node_key LIMIT 500
"""


@query(
    "e4_find_callers",
    _CALL.format(far="caller", near="callee", names=_spell("Supplier#000000003"), scope="true"),
)
def e4_find_callers(t):
    return lookup.find_callers(t.entities(), t.edges("CALLS"), "Supplier#000000003()")


@query(
    "e5_find_callees",
    _CALL.format(
        far="callee", near="caller", names=_spell("main()"), scope="caller.repo IN ('NATION_2', 'NATION_7')"
    ),
)
def e5_find_callees(t):
    return lookup.find_callees(t.entities(), t.edges("CALLS"), "main", ["NATION_2", "NATION_7"])


@query(
    "e6_substring_search",
    """
    SELECT node_key, node_id, name, 'Entity|' || label AS labels, repo, path, line,
           CAST(CASE WHEN name_lower = q THEN 0 WHEN name_lower LIKE q || '%' THEN 1
                WHEN norm_name_lower = q THEN 2 WHEN norm_name_lower LIKE q || '%' THEN 3 ELSE 4 END AS BIGINT) AS rank,
           CAST(length(name) AS BIGINT) AS name_length
    FROM (SELECT *, 'server1' AS q FROM entities)
    WHERE contains(name_lower, q) OR contains(norm_name_lower, q)
    ORDER BY rank, name_length, name, node_key LIMIT 100
    """,
)
def e6_substring_search(t):
    return t.search_index().substring_search("Server1")


_BM25 = """
    toks AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', name, norm_name, coalesce(path, ''))),
                                          '[\\p{L}\\p{N}_.]+') AS tk FROM entities),
    cnt AS (SELECT *, len(tk) AS dl, len(list_filter(tk, lambda x: x = 'widget')) AS f1,
                   len(list_filter(tk, lambda x: x = 'nation_3')) AS f2 FROM toks),
    st AS (SELECT count(*) AS n, avg(dl) AS al, count(*) FILTER (WHERE f1 > 0) AS d1,
                  count(*) FILTER (WHERE f2 > 0) AS d2 FROM cnt),
    tier1 AS (
        SELECT cnt.*, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / al))
             + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / al)), 6) AS score
        FROM cnt, st WHERE f1 > 0 OR f2 > 0
        ORDER BY score DESC, node_key LIMIT 100)
"""


@query(
    "e7_relevance_search",
    f"""RECURSIVE {_BM25}
    SELECT node_key, node_id, name, 'Entity|' || label AS labels, repo, path, line, score FROM tier1""",
)
def e7_relevance_search(t):
    return t.search_index().relevance_search("widget nation_3")


_TIERS = """
    toks AS (SELECT *, regexp_extract_all(lower(concat_ws(' ', name, norm_name, coalesce(path, ''))),
                                          '[\\p{L}\\p{N}_.]+') AS tk FROM entities),
    cnt AS (SELECT *, len(tk) AS dl, len(list_filter(tk, lambda x: x = 'runserver1')) AS f1 FROM toks),
    st AS (SELECT count(*) AS n, avg(dl) AS al, count(*) FILTER (WHERE f1 > 0) AS d1 FROM cnt),
    tier1 AS (
        SELECT cnt.*, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / al)), 6) AS score
        FROM cnt, st WHERE f1 > 0 ORDER BY score DESC, node_key LIMIT 100),
    tier2 AS (
        SELECT *, CASE WHEN name_lower = 'runserver1' THEN 0 WHEN name_lower LIKE 'runserver1%' THEN 1 ELSE 4 END AS rank
        FROM entities WHERE contains(name_lower, 'runserver1') ORDER BY rank, length(name), name, node_key LIMIT 100)
"""


@query(
    "e8_search",
    f"""RECURSIVE {_TIERS}
    SELECT node_key, node_id, name, 'Entity|' || label AS labels, repo, path, line, CAST(tier AS BIGINT) AS tier FROM (
      SELECT node_key, node_id, name, label, repo, path, line, 0 AS tier, -score AS k1, 0 AS k2 FROM tier1
      UNION ALL
      SELECT node_key, node_id, name, label, repo, path, line, 1, rank, length(name) FROM tier2
      WHERE node_key NOT IN (SELECT node_key FROM tier1))
    ORDER BY tier, k1, k2, name, node_key LIMIT 100
    """,
)
def e8_search(t):
    return t.search_index().search("RunServer1")


@query(
    "e9_find_dependencies",
    """
    SELECT 'NATION_4' AS repo, p.name, 'Entity|' || p.label AS labels, coalesce(p.ecosystem, '') AS ecosystem,
           coalesce(p.version, '') AS version, coalesce(d.context, '') AS scope,
           d.type = 'DEPENDS_ON_REPO' AS "cross", coalesce(d.confidence, '') AS confidence
    FROM edges d JOIN entities h ON d.src = h.node_key JOIN entities p ON d.dst = p.node_key
    WHERE h.node_id = 'repo::NATION_4' AND d.type IN ('DEPENDS_ON', 'DEPENDS_ON_REPO')
    ORDER BY ecosystem, p.name, p.node_key, "cross", scope LIMIT 1000
    """,
)
def e9_find_dependencies(t):
    return lookup.find_dependencies(t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"), "NATION_4")


@query(
    "e9_find_dependencies_scope",
    """
    SELECT 'NATION_4' AS repo, p.name, 'Entity|' || p.label AS labels, coalesce(p.ecosystem, '') AS ecosystem,
           coalesce(p.version, '') AS version, coalesce(d.context, '') AS scope,
           d.type = 'DEPENDS_ON_REPO' AS "cross", coalesce(d.confidence, '') AS confidence
    FROM edges d JOIN entities h ON d.src = h.node_key JOIN entities p ON d.dst = p.node_key
    WHERE h.node_id = 'repo::NATION_4' AND d.type IN ('DEPENDS_ON', 'DEPENDS_ON_REPO') AND d.context = 'internal'
    ORDER BY ecosystem, p.name, p.node_key, "cross", scope LIMIT 1000
    """,
)
def e9_find_dependencies_scope(t):
    return lookup.find_dependencies(
        t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"), "NATION_4", "internal"
    )


@query(
    "e10_find_dependents",
    """
    SELECT '' AS repo, h.name, 'Entity|' || h.label AS labels, coalesce(p.ecosystem, '') AS ecosystem,
           coalesce(p.version, '') AS version, coalesce(d.context, '') AS scope,
           d.type = 'DEPENDS_ON_REPO' AS "cross", coalesce(d.confidence, '') AS confidence
    FROM edges d JOIN entities h ON d.src = h.node_key JOIN entities p ON d.dst = p.node_key
    WHERE h.node_id LIKE 'repo::%' AND d.type IN ('DEPENDS_ON', 'DEPENDS_ON_REPO') AND p.name_lower = 'nation_3'
    ORDER BY h.name, p.node_key, "cross", scope LIMIT 1000
    """,
)
def e10_find_dependents(t):
    return lookup.find_dependents(t.entities(), t.edges("DEPENDS_ON", "DEPENDS_ON_REPO"), " Nation_3 ")


_ROUTES = """
    SELECT node_key, coalesce(repo, '') AS repo, split_part(name, ' ', 1) AS method,
           substr(name, strpos(name, ' ') + 1) AS path, '' AS handler, 'Entity|' || label AS labels,
           coalesce(path, '') AS file, coalesce(line, '') AS line, coalesce(source, 'code') AS source,
           coalesce(documented, false) AS documented, coalesce(classification, '') AS classification, '' AS tags
    FROM entities WHERE label = 'HttpRoute'
"""


@query(
    "e11_find_routes",
    f"""
    SELECT * FROM ({_ROUTES}) WHERE method = 'POST' AND contains(lower(path), '/v1/f/')
      AND repo IN ('NATION_5', 'NATION_6')
    ORDER BY repo, path, node_key LIMIT 500
    """,
)
def e11_find_routes(t):
    return lookup.find_routes(t.entities(), "post", "/V1/f/", ["NATION_5", "NATION_6"])


@query("e11_undocumented_routes", f"SELECT * FROM ({_ROUTES}) WHERE NOT documented ORDER BY repo, path, node_key LIMIT 500")
def e11_undocumented_routes(t):
    return lookup.undocumented_routes(t.entities())


@query(
    "e12_find_kafka_topic",
    """
    SELECT (SELECT min(name) FROM entities WHERE label = 'KafkaTopic' AND name_lower = 'economy') AS topic,
      (SELECT string_agg(n, '|' ORDER BY n) FROM (SELECT DISTINCT h.name AS n FROM edges r
         JOIN entities h ON r.src = h.node_key JOIN entities k ON r.dst = k.node_key
         WHERE r.type = 'PRODUCES' AND k.name_lower = 'economy')) AS producers,
      (SELECT string_agg(n, '|' ORDER BY n) FROM (SELECT DISTINCT h.name AS n FROM edges r
         JOIN entities h ON r.src = h.node_key JOIN entities k ON r.dst = k.node_key
         WHERE r.type = 'CONSUMES' AND k.name_lower = 'economy')) AS consumers
    """,
)
def e12_find_kafka_topic(t):
    return lookup.find_kafka_topic(t.entities(), t.edges("PRODUCES", "CONSUMES"), "Economy")


def _sql_object(where: str) -> str:
    def names(kind):
        return f"coalesce((SELECT string_agg(DISTINCT x.name, '|' ORDER BY x.name) FROM edges r JOIN entities x ON r.dst = x.node_key WHERE r.src = o.node_key AND r.type = '{kind}'), '')"

    return f"""
    SELECT substr(o.name, strpos(o.name, '.') + 1) AS name, split_part(o.name, '.', 1) AS "schema",
           label AS kind, 'Entity|' || label AS labels, coalesce(path, '') AS file, coalesce(line, '') AS line,
           {names('READS_TABLE')} AS reads, {names('WRITES_TABLE')} AS writes,
           {names('DEPENDS_ON_OBJECT')} AS depends_on, {names('TRIGGERS_ON')} AS triggers_on
    FROM entities o WHERE label LIKE 'Sql%' AND {where}
    ORDER BY o.name LIMIT 200"""


_SQL_EDGES = ("READS_TABLE", "WRITES_TABLE", "DEPENDS_ON_OBJECT", "TRIGGERS_ON")


@query("e13_find_sql_object", _sql_object("o.name_lower = 'dbo.usp_7'"))
def e13_find_sql_object(t):
    return lookup.find_sql_object(t.entities(), t.edges(*_SQL_EDGES), "dbo", "USP_7")


@query("e13_find_sql_object_unqualified", _sql_object("split_part(o.name_lower, '.', -1) = 'trg_nation_3'"))
def e13_find_sql_object_unqualified(t):
    return lookup.find_sql_object(t.entities(), t.edges(*_SQL_EDGES), "", "trg_nation_3")


_GLUE = """
    SELECT j.name, o.repo, 'Entity|' || j.label AS labels, j.path AS file, j.script, j.schedule,
      coalesce((SELECT string_agg(x.name, '|' ORDER BY x.name) FROM edges r JOIN entities x ON r.dst = x.node_key
        WHERE r.src = j.node_key AND r.type = 'READS_SOURCE'), '') AS sources,
      coalesce((SELECT string_agg(x.name, '|' ORDER BY x.name) FROM edges r JOIN entities x ON r.dst = x.node_key
        WHERE r.src = j.node_key AND r.type = 'WRITES_DESTINATION'), '') AS targets, j.node_key AS nk
    FROM entities j JOIN ownership o ON j.node_key = o.node_key WHERE j.label = 'GlueJob'
"""


@query(
    "e14_find_glue_jobs",
    f"""
    SELECT * EXCLUDE (nk) FROM ({_GLUE}) WHERE list_contains(string_split(sources, '|'), 'dbo.nation_3')
    ORDER BY repo, name, nk LIMIT 500
    """,
)
def e14_find_glue_jobs(t):
    own = t.entities().where("label = 'GlueJob'").select("node_key", "repo")
    return lookup.find_glue_jobs(
        t.entities(), t.edges("READS_SOURCE", "WRITES_DESTINATION"), own, "DBO.Nation_3"
    )


@query(
    "e15_e16_freshness",
    f"""
    SELECT name AS repo, strftime(last_synced_at, '%Y-%m-%d %H:%M:%S') AS last_synced_at,
           strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S') AS last_indexed_at,
           CAST(epoch({_NOW}) - epoch(last_synced_at) AS BIGINT) AS age_seconds,
           epoch({_NOW}) - epoch(last_synced_at) > 3600 AS stale
    FROM repositories WHERE last_synced_at IS NOT NULL
    """,
)
def e15_e16_freshness(t):
    return lookup.freshness(t.repositories(), F.lit(NOW).cast("timestamp"))


@query(
    "e16_freshness_verdict",
    f"""
    SELECT CAST(3600 AS BIGINT) AS stale_after_seconds,
           CAST(max(epoch({_NOW}) - epoch(last_synced_at)) AS BIGINT) AS oldest_age_seconds,
           bool_or(epoch({_NOW}) - epoch(last_synced_at) > 3600) AS stale, count(*) AS repositories
    FROM repositories WHERE last_synced_at IS NOT NULL
    """,
)
def e16_freshness_verdict(t):
    return lookup.freshness_verdict(t.repositories(), F.lit(NOW).cast("timestamp"))


@query(
    "e17_api_surface",
    f"""
    SELECT CASE WHEN grouping(repo) = 1 THEN '(all)' ELSE repo END AS repo, count(*) AS routes,
           count(*) FILTER (WHERE documented) AS documented, count(*) FILTER (WHERE NOT documented) AS undocumented,
           count(*) FILTER (WHERE classification = 'business') AS business,
           CAST(round(count(*) FILTER (WHERE documented) * 100.0 / count(*)) AS BIGINT) AS documented_pct
    FROM ({_ROUTES}) GROUP BY ROLLUP (repo)
    """,
)
def e17_api_surface(t):
    return lookup.api_surface(t.entities())


@query(
    "f1_blast_radius",
    f"""
    RECURSIVE walk(node, d) AS (
      SELECT node_key, 0 FROM entities WHERE name_lower IN {_spell("Supplier#000000005")}
      UNION
      SELECT dst, d + 1 FROM walk JOIN edges ON src = node WHERE d < 4)
    SELECT name, repo, path, line, 'Entity|' || label AS labels, CAST(distance AS BIGINT) AS distance
    FROM (SELECT node, min(d) AS distance FROM walk WHERE d > 0 GROUP BY node)
    JOIN entities ON node = node_key
    ORDER BY distance, name NULLS LAST, node_key LIMIT 500
    """,
)
def f1_blast_radius(t):
    return traverse.blast_radius(t.entities(), t.edges(), "Supplier#000000005", 4)


@query(
    "f1_blast_radius_wide",
    f"""
    RECURSIVE walk(node, d) AS (
      SELECT node_key, 0 FROM entities WHERE name_lower IN {_spell("main")} AND repo IN ('NATION_1', 'NATION_8')
      UNION
      SELECT dst, d + 1 FROM walk JOIN edges ON src = node WHERE d < 3)
    SELECT name, repo, path, line, 'Entity|' || label AS labels, CAST(distance AS BIGINT) AS distance
    FROM (SELECT node, min(d) AS distance FROM walk WHERE d > 0 GROUP BY node)
    JOIN entities ON node = node_key
    ORDER BY distance, name NULLS LAST, node_key LIMIT 500
    """,
)
def f1_blast_radius_wide(t):
    return traverse.blast_radius(t.entities(), t.edges(), "main()", 0, ["NATION_1", "NATION_8"])


@query(
    "f2_shortest_path_length",
    f"""
    RECURSIVE und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk(node, d) AS (
      SELECT node_key, 0 FROM entities WHERE name_lower IN {_spell("dbo.usp_3")}
      UNION
      SELECT b, d + 1 FROM walk JOIN und ON a = node WHERE d < 5)
    SELECT CAST(min(d) AS BIGINT) AS hops, min(d) + 1 AS nodes FROM walk JOIN entities ON node = node_key
    WHERE name_lower IN {_spell("Economy")} AND d > 0
    """,
)
def f2_shortest_path_length(t):
    path = traverse.shortest_path(t.entities(), t.edges(), "dbo.usp_3", "Economy")
    return path.agg(F.max("idx").alias("hops"), F.count(F.lit(1)).alias("nodes"))


@query(
    "f2_shortest_path",
    f"""
    RECURSIVE und AS (SELECT src AS a, dst AS b, type, coalesce(confidence, '') AS conf FROM edges
                      UNION SELECT dst, src, type, coalesce(confidence, '') FROM edges),
    walk(node, d) AS (
      SELECT node_key, 0 FROM entities WHERE name_lower IN {_spell("dbo.usp_3")}
      UNION
      SELECT b, d + 1 FROM walk JOIN und ON a = node WHERE d < 5),
    dist AS (SELECT node, min(d) AS d FROM walk GROUP BY node),
    goal AS (SELECT node, d FROM dist JOIN entities ON node = node_key WHERE name_lower IN {_spell("Economy")} ORDER BY d, node LIMIT 1),
    parent AS (
      SELECT n.node, n.d, a.node AS parent, type, conf, row_number() OVER (PARTITION BY n.node ORDER BY a.node, type, conf) AS best
      FROM und JOIN dist n ON b = n.node JOIN dist a ON und.a = a.node AND a.d = n.d - 1 WHERE n.d <= (SELECT d FROM goal)),
    trail(node, d) AS (
      SELECT node, d FROM goal
      UNION ALL
      SELECT p.parent, p.d - 1 FROM trail JOIN parent p ON p.node = trail.node AND best = 1)
    SELECT name, repo, path, 'Entity|' || label AS labels, coalesce(type, '') AS relationship, coalesce(conf, '') AS rel_confidence, CAST(trail.d AS BIGINT) AS idx
    FROM trail JOIN entities ON trail.node = node_key LEFT JOIN parent p ON p.node = trail.node AND best = 1
    """,
)
def f2_shortest_path(t):
    return traverse.shortest_path(t.entities(), t.edges(), "dbo.usp_3", "Economy")


@query(
    "f3_self_path",
    """
    SELECT name, repo, path, 'Entity|' || label AS labels, '' AS relationship, '' AS rel_confidence,
           CAST(0 AS BIGINT) AS idx
    FROM entities WHERE name_lower = 'main()' ORDER BY node_key LIMIT 1
    """,
)
def f3_self_path(t):
    return traverse.shortest_path(t.entities(), t.edges(), "main", "MAIN()")


@query("f4_relation_types", "SELECT DISTINCT type FROM edges ORDER BY type")
def f4_relation_types(t):
    return traverse.present_relation_types(t.edges())
