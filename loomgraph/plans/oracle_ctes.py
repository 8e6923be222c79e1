"""The projections of ``projections.py`` stated in DuckDB SQL.

``with_graph(sql)`` prefixes a query with the CTEs it mentions (and those they
mention in turn).
"""

from __future__ import annotations

import re

_SUPPLIERS = "(SELECT count(*) FROM supplier)"

CTES: dict[str, str] = {
    "cust": "SELECT c.*, n_name AS repo FROM customer c JOIN nation ON c_nationkey = n_nationkey",
    "supp": "SELECT s.*, n_name AS repo FROM supplier s JOIN nation ON s_nationkey = n_nationkey",
    "ords": "SELECT o.*, repo FROM orders o JOIN cust ON o_custkey = c_custkey",
    "lines": "SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "jobs": """
        SELECT DISTINCT s_nationkey, repo, s_suppkey % 5 AS slot,
               'platform::glue::job::' || repo || '::job_' || (s_suppkey % 5) AS node_key
        FROM supp""",
    "ent_base": """
        SELECT 'S' || s_suppkey AS node_key, 'class::' || s_suppkey AS node_id, s_name AS name,
               'suppliers/' || s_nationkey || '/s' || s_suppkey || '.go' AS path,
               'L' || (s_suppkey % 97 + 1) AS line, 'go' AS language,
               CAST(s_suppkey % 12 AS BIGINT) AS community, NULL AS ecosystem, NULL AS version, repo,
               NULL::BOOLEAN AS shared, 'Class' AS label, NULL::BOOLEAN AS documented,
               NULL AS classification, NULL AS source, NULL AS script, NULL AS schedule,
               NULL AS "schema", NULL AS object_name, NULL::BOOLEAN AS is_repository
        FROM supp
        UNION ALL
        SELECT 'C' || c_custkey, 'func::' || c_custkey,
               CASE c_custkey % 40 WHEN 0 THEN 'main()' WHEN 1 THEN 'RunServer' || c_custkey || '()'
                 WHEN 2 THEN 'start_' || c_custkey || '()' WHEN 3 THEN 'bootstrap' || c_custkey || '()'
                 ELSE c_name || '()' END,
               'customers/' || lower(c_mktsegment) || '/c' || c_custkey || '.py',
               'L' || (c_custkey % 97 + 1), 'python', c_custkey % 12, NULL, NULL, repo,
               NULL, 'Function', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM cust
        UNION ALL
        SELECT 'platform::pkg::' || lower(p_brand) || '::' || p_partkey,
               'pkg::' || lower(p_brand) || '::' || p_partkey, p_name || ' ' || p_partkey,
               NULL, NULL, NULL, 0, lower(p_type), '1.' || p_size, NULL,
               true, 'Package', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM part
        UNION ALL
        SELECT 'platform::route::' || o_orderkey, 'route::' || o_orderkey,
               CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'POST' ELSE 'GET' END
                 || ' /api/v1/' || lower(o_orderstatus) || '/' || o_orderkey,
               'routes/' || (o_orderkey % 20) || '.go', 'L' || (o_orderkey % 997 + 1), NULL, 0, NULL,
               NULL, repo, NULL, 'HttpRoute', o_orderstatus = 'F',
               CASE WHEN o_orderkey % 10 = 0 THEN 'infra' ELSE 'business' END,
               CASE WHEN o_orderstatus = 'F' THEN 'openapi' END, NULL, NULL, NULL, NULL, NULL
        FROM ords
        UNION ALL
        SELECT 'platform::topic::' || t, 'topic::' || t, t, NULL, NULL, NULL, 0, NULL, NULL, NULL,
               true, 'KafkaTopic', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM (SELECT DISTINCT unnest([lower(p_type), upper(p_type)]) AS t FROM part)
        UNION ALL
        SELECT 'platform::sql::sql_table::dbo.' || lower(n_name), 'sql::sql_table::dbo.' || lower(n_name),
               'dbo.' || lower(n_name), 'sql/schema.sql', 'L1', NULL, 0, NULL, NULL, NULL,
               true, 'SqlTable', NULL, NULL, NULL, NULL, NULL, 'dbo', lower(n_name), NULL
        FROM nation
        UNION ALL
        SELECT 'platform::sql::sql_trigger::dbo.trg_' || lower(n_name),
               'sql::sql_trigger::dbo.trg_' || lower(n_name), 'dbo.trg_' || lower(n_name),
               'sql/triggers.sql', 'L1', NULL, 0, NULL, NULL, NULL,
               true, 'SqlTrigger', NULL, NULL, NULL, NULL, NULL, 'dbo', 'trg_' || lower(n_name), NULL
        FROM nation
        UNION ALL
        SELECT 'platform::sql::sql_procedure::dbo.usp_' || s_suppkey,
               'sql::sql_procedure::dbo.usp_' || s_suppkey, 'dbo.usp_' || s_suppkey,
               'sql/p' || s_suppkey || '.sql', 'L1', NULL, 0, NULL, NULL, NULL,
               true, 'SqlProcedure', NULL, NULL, NULL, NULL, NULL, 'dbo', 'usp_' || s_suppkey, NULL
        FROM supplier
        UNION ALL
        SELECT node_key, substr(node_key, 11), 'job_' || slot, 'infra/job_' || slot || '.tf', 'L3',
               NULL, 0, NULL, NULL, repo, NULL, 'GlueJob', NULL, NULL, NULL,
               's3://etl/job_' || slot || '.py', 'cron(0 ' || slot || ' * * ? *)', NULL, NULL, NULL
        FROM jobs
        UNION ALL
        SELECT 'platform::repo::' || n_name, 'repo::' || n_name, n_name, NULL, NULL, NULL, 0, NULL,
               NULL, NULL, true, 'Package', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true
        FROM nation""",
    "entities": """
        SELECT *, name AS norm_name, lower(name) AS name_lower, lower(name) AS norm_name_lower
        FROM ent_base""",
    "edges": f"""
        SELECT 'CALLS' AS type, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, any_value(repo) AS repo,
               CASE min(l_returnflag) WHEN 'R' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED'
                 ELSE 'AMBIGUOUS' END AS confidence, NULL AS context
        FROM lines JOIN cust ON o_custkey = c_custkey GROUP BY o_custkey, l_suppkey
        UNION ALL
        SELECT DISTINCT 'REFERENCES', 'S' || s_suppkey, 'S' || t, repo, 'INFERRED', NULL
        FROM (SELECT s_suppkey, repo,
                     unnest([(s_suppkey * 7 + 1) % {_SUPPLIERS}, (s_suppkey * 3 + 2) % {_SUPPLIERS}]) AS t
              FROM supp)
        UNION ALL
        SELECT 'DEPENDS_ON', 'platform::repo::' || repo,
               'platform::pkg::' || lower(p_brand) || '::' || p_partkey, repo, 'EXTRACTED', scope
        FROM (SELECT repo, l_partkey, min(l_linestatus) AS scope
              FROM lines JOIN cust ON o_custkey = c_custkey GROUP BY 1, 2)
        JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT 'DEPENDS_ON', 'platform::route::' || l_orderkey,
               'platform::pkg::' || lower(p_brand) || '::' || p_partkey, repo,
               CASE WHEN l_partkey % 10 <> 0 THEN 'INFERRED' END, NULL
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
        JOIN ords ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT DISTINCT 'DEPENDS_ON_REPO', 'platform::repo::' || n_name, 'platform::repo::NATION_' || t,
               n_name, 'INFERRED', 'internal'
        FROM (SELECT n_name, n_nationkey, unnest([(n_nationkey + 1) % 25, (n_nationkey * 3 + 2) % 25]) AS t
              FROM nation) WHERE t <> n_nationkey
        UNION ALL
        SELECT DISTINCT 'PRODUCES', 'platform::repo::' || repo, 'platform::topic::' || lower(p_type),
               repo, 'INFERRED', NULL
        FROM lines JOIN supp ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT DISTINCT 'CONSUMES', 'platform::repo::' || repo, 'platform::topic::' || upper(p_type),
               repo, 'INFERRED', NULL
        FROM lines JOIN cust ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
        UNION ALL
        SELECT DISTINCT 'READS_TABLE', 'platform::sql::sql_procedure::dbo.usp_' || l_suppkey,
               'platform::sql::sql_table::dbo.' || lower(cust.repo), supp.repo, 'INFERRED', NULL
        FROM lines JOIN cust ON o_custkey = c_custkey JOIN supp ON l_suppkey = s_suppkey
        UNION ALL
        SELECT 'WRITES_TABLE', 'platform::sql::sql_procedure::dbo.usp_' || s_suppkey,
               'platform::sql::sql_table::dbo.' || lower(repo), repo, 'INFERRED', NULL FROM supp
        UNION ALL
        SELECT 'DEPENDS_ON_OBJECT', 'platform::sql::sql_procedure::dbo.usp_' || s_suppkey,
               'platform::sql::sql_procedure::dbo.usp_' || ((s_suppkey + 1) % {_SUPPLIERS}),
               repo, 'INFERRED', NULL FROM supp
        UNION ALL
        SELECT 'TRIGGERS_ON', 'platform::sql::sql_trigger::dbo.trg_' || lower(n_name),
               'platform::sql::sql_table::dbo.' || lower(n_name), n_name, 'EXTRACTED', NULL FROM nation
        UNION ALL
        SELECT DISTINCT 'READS_SOURCE', node_key, 'platform::sql::sql_table::dbo.nation_' || t,
               repo, 'INFERRED', NULL
        FROM (SELECT node_key, repo, unnest([s_nationkey, (s_nationkey + slot) % 25]) AS t FROM jobs)
        UNION ALL
        SELECT 'WRITES_DESTINATION', node_key,
               'platform::sql::sql_table::dbo.nation_' || ((s_nationkey + slot * 2 + 1) % 25),
               repo, 'INFERRED', NULL FROM jobs
        UNION ALL
        SELECT 'EXPOSES_ROUTE', 'platform::repo::' || repo, 'platform::route::' || o_orderkey, repo,
               CASE WHEN o_orderstatus = 'F' THEN 'EXTRACTED' ELSE 'INFERRED' END, NULL FROM ords
        UNION ALL
        SELECT 'CONTAINS', 'platform::repo::' || repo, node_key, repo, 'EXTRACTED', NULL FROM jobs""",
    "ownership": """
        SELECT repo, node_key FROM entities WHERE repo IS NOT NULL
        UNION ALL
        SELECT DISTINCT repo, node_key
        FROM (SELECT repo, src AS node_key FROM edges UNION ALL SELECT repo, dst FROM edges)
        WHERE regexp_matches(node_key, '^platform::(topic|pkg|sql|repo)::')""",
    "repositories": """
        SELECT n_name AS name,
               CASE WHEN n_nationkey <> 24 THEN
                 TIMESTAMP '2024-01-31 00:00:00' - to_seconds(n_nationkey * 600) END AS last_synced_at,
               CASE WHEN n_nationkey % 3 <> 0 THEN
                 TIMESTAMP '2024-01-31 00:00:00' - to_seconds(n_nationkey * 1200) END AS last_indexed_at
        FROM nation""",
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "samples": """
        SELECT CASE WHEN user_id % 10 = 0 THEN 'internal' ELSE 'user' || user_id END AS actor,
               event_type AS endpoint,
               CASE WHEN k % 7 = 0 THEN []::VARCHAR[]
                    WHEN k % 11 = 0 THEN ['NATION_' || (k % 25), 'NATION_' || ((k + 1) % 25)]
                    ELSE ['NATION_' || (k % 25)] END AS repos,
               ts AS "at"
        FROM ev""",
    "access": 'SELECT actor, unnest(repos) AS repo, "at" FROM samples',
    "stats": """
        SELECT CAST("at" AS DATE) AS day, actor, endpoint, repo, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT actor, endpoint, unnest(CASE WHEN len(repos) = 0 THEN [''] ELSE repos END) AS repo, "at"
              FROM samples) GROUP BY ALL""",
    "manifest": """
        SELECT n_name AS name, 'https://git.example.com/org/' || n_name || '.git' AS url,
               CASE WHEN n_nationkey % 6 = 5 THEN 'release' ELSE 'main' END AS branch
        FROM nation WHERE n_nationkey % 5 <> 4""",
    "discovered": """
        SELECT CASE WHEN c_custkey % 11 = 0 THEN c_name ELSE 'NATION_' || c_custkey END AS name,
               CASE WHEN c_custkey % 13 <> 0 THEN 'https://git.example.com/org/c' || c_custkey END AS url,
               CASE WHEN c_custkey % 17 = 0 THEN '-bad' WHEN c_custkey % 19 = 0 THEN '' ELSE 'main' END AS branch,
               c_custkey % 7 = 0 AS archived,
               TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 200 AS INTEGER)) AS pushed_at
        FROM customer""",
    "runs": """
        SELECT 'repo_' || o_custkey AS repo, o_orderkey AS run_seq, o_orderdate AS started_at,
               o_orderkey % 1000 AS duration_ms,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'skipped' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN 'import' END AS stage,
               'c' || (o_orderkey % 3) AS "commit",
               CASE WHEN o_orderkey % 2 = 0 THEN 11 ELSE 10 END AS schema_version,
               o_orderkey % 500 AS nodes, o_orderkey % 700 AS links,
               CASE WHEN o_orderstatus = 'F' THEN 'boom ' || o_orderkey END AS error,
               o_orderkey % 23 = 0 AS canceled
        FROM orders""",
}

_WORD = re.compile(r"[a-z_][a-z_0-9]*")


def with_graph(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` prefixed with the CTEs it needs, in dependency order."""
    ctes = {**CTES, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in ctes and word not in seen:
                seen.add(word)
                visit(ctes[word])
                order.append(word)

    visit(sql)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("RECURSIVE ") else ""
    if recursive:
        body = body[len("RECURSIVE ") :]
    head = ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in order)
    if not head:
        return f"WITH {recursive}{body}" if recursive else body
    if recursive:
        return f"WITH RECURSIVE {head},\n{body}"
    return f"WITH {head}\n{body}"
