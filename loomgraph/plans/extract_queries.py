"""Registered extraction queries (group C, A3).

The oracle states what each file template must yield, so it shares nothing with
the extractors but the file layout.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import build
from loomgraph.operators.extract import deps, glue, kafka, lexing, postgres, routes, tsql
from loomgraph.operators.extract.common import Fragments, select_files
from loomgraph.operators.extract.dialect import POSTGRES_MARKERS, TSQL_MARKERS, dialect, owner, score
from loomgraph.plans.index_run import index_files
from loomgraph.plans.registry import query
from loomgraph.session import work_folder
from loomgraph.sources.store import GraphStore

_DOCS = {
    "docs": """
        SELECT doc_id AS n, source, 'NATION_' || ((doc_id // 12) % 25) AS repo, doc_id % 12 AS kind,
               len(text) - len(replace(text, chr(10), '')) AS nl, text
        FROM documents""",
    "paths": """
        SELECT *, CASE kind WHEN 0 THEN 'src/' || source || '/' || n || '.go' WHEN 1 THEN 'src/' || source || '/' || n || '.py'
            WHEN 2 THEN 'src/' || source || '/' || n || '.js' WHEN 3 THEN 'src/' || source || '/C' || n || '.java'
            WHEN 4 THEN 'db/' || n || '_ms.sql' WHEN 5 THEN 'db/' || n || '_pg.sql'
            WHEN 6 THEN 'config/' || n || '/kafka.yml' WHEN 7 THEN 'api/' || n || '/swagger.json'
            WHEN 8 THEN 'infra/' || n || '.tf' WHEN 9 THEN 'jobs/etl_' || n || '.py'
            WHEN 10 THEN 'src/' || source || '/' || n || '.rb' ELSE 'svc' || n || '/requirements.txt' END AS path
        FROM docs""",
    # Files as the extractors see them, for the pattern-scored dialects.
    "sqlfiles": """
        SELECT repo, path, kind, '/*' || replace(replace(text, '*/', '* /'), '/*', '/ *') || '*/' || chr(10)
          || CASE kind WHEN 4 THEN
            'SET NOCOUNT ON' || chr(10) || 'GO' || chr(10) || 'CREATE TABLE [dbo].[t' || n || '] (id int, FOREIGN KEY (id) REFERENCES dbo.base'
            || (n % 10) || '(id))' || chr(10) || 'GO' || chr(10) || 'CREATE PROCEDURE dbo.p' || n || ' AS' || chr(10)
            || '  SELECT * FROM t' || n || ' JOIN sales.s' || (n % 7) || ' ON 1=1' || chr(10) || '  DELETE FROM gone' || (n % 5)
            || chr(10) || '  EXEC dbo.q' || (n % 6) || chr(10) || 'GO' || chr(10)
          ELSE
            'CREATE TABLE app.t' || n || ' (id serial, c int REFERENCES base' || (n % 10) || '(id));' || chr(10)
            || 'CREATE MATERIALIZED VIEW app.mv' || n || ' AS WITH a AS (SELECT 1 FROM src' || (n % 8) || ') SELECT * FROM a;' || chr(10)
            || 'CREATE FUNCTION app.f' || n || '() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN' || chr(10) || '  -- INSERT INTO hidden' || chr(10)
            || '  INSERT INTO audit' || (n % 4) || ' SELECT * FROM app.t' || n || '; END; $$;' || chr(10)
            || 'CREATE TRIGGER tg' || n || ' BEFORE UPDATE ON app.t' || n || ' FOR EACH ROW EXECUTE FUNCTION app.f' || n || '();' || chr(10)
            || 'ALTER TABLE ONLY app.t' || n || ' ADD CONSTRAINT fk FOREIGN KEY (c) REFERENCES base' || (n % 10) || '(id);' || chr(10)
          END AS content
        FROM paths WHERE kind IN (4, 5)""",
    "topics": """
        SELECT repo, path, 'produces' AS role, 'orders.' || (n % 50) AS topic, 7 AS line, 0 AS pos FROM paths WHERE kind = 0
        UNION ALL SELECT repo, path, 'produces', 'py.' || (n % 40), 3, 0 FROM paths WHERE kind = 1
        UNION ALL SELECT repo, path, 'consumes', 'orders.' || (n % 50), 4, 1 FROM paths WHERE kind = 1
        UNION ALL SELECT repo, path, 'produces', 'js.' || (n % 30), 3, 0 FROM paths WHERE kind = 2
        UNION ALL SELECT repo, path, 'consumes', 'java.' || (n % 20), 7, 0 FROM paths WHERE kind = 3
        UNION ALL SELECT repo, path, 'produces', 'out.' || (n % 15), nl + 4, nl + 4 FROM paths WHERE kind = 6
        UNION ALL SELECT repo, path, 'consumes', 'in.' || (n % 15), nl + 6, nl + 6 FROM paths WHERE kind = 6
        UNION ALL SELECT repo, path, 'references', 'out.' || (n % 15), nl + 7, nl + 7 FROM paths WHERE kind = 6
        UNION ALL SELECT repo, path, 'references', 'lone.' || (n % 9), nl + 8, nl + 8 FROM paths WHERE kind = 6""",
    "troles": """
        SELECT repo, role, topic, min_by(path, w) AS path, min_by(line, w) AS line
        FROM (SELECT *, (replace(path, '/', chr(1)), pos) AS w FROM topics)
        WHERE role <> 'references' OR (repo, topic) NOT IN (SELECT (repo, topic) FROM topics WHERE role <> 'references')
        GROUP BY repo, role, topic""",
    "rts": """
        SELECT repo, path AS file, 5 AS line, 'POST' AS method, '/api/v' || (n % 3) AS path, 'h.Create' AS handler FROM paths WHERE kind = 0
        UNION ALL SELECT repo, path, 6, 'GET', '/chi/' || n, 'h.Get' FROM paths WHERE kind = 0
        UNION ALL SELECT repo, path, nl + 14, 'DELETE', '/tail/' || n, 'h.Del' FROM paths WHERE kind = 0
        UNION ALL SELECT repo, path, 1, 'PUT', '/py/' || n, '' FROM paths WHERE kind = 1
        UNION ALL SELECT repo, path, 1, 'GET', '/js/' || n, '' FROM paths WHERE kind = 2
        UNION ALL SELECT repo, path, 3, 'GET', '/api/j' || n || '/list', '' FROM paths WHERE kind = 3
        UNION ALL SELECT repo, path, 5, 'PUT', '/api/j' || n || '/old', '' FROM paths WHERE kind = 3
        UNION ALL SELECT repo, path, 1, 'GET', '/rb/' || n, '' FROM paths WHERE kind = 10""",
    "specs": """
        SELECT repo, path AS file, 'GET' AS method, '/base/s' || n || '/{id}' AS path, 'op' || n AS handler
        FROM paths WHERE kind = 7""",
    "msedges": """
        SELECT repo, 'sql::sql_table::dbo.t' || n AS source, 'in_schema' AS relation, 'sql::schema::dbo' AS target, 'EXTRACTED' AS confidence, 'L' || (nl + 4) AS loc FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_procedure::dbo.p' || n, 'in_schema', 'sql::schema::dbo', 'EXTRACTED', 'L' || (nl + 6) FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_table::dbo.t' || n, 'depends_on_object', 'sql::sql_table::dbo.base' || (n % 10), 'INFERRED', NULL FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_procedure::dbo.p' || n, 'reads_table', 'sql::sql_table::dbo.t' || n, 'INFERRED', NULL FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_procedure::dbo.p' || n, 'reads_table', 'sql::sql_table::sales.s' || (n % 7), 'INFERRED', NULL FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_procedure::dbo.p' || n, 'writes_table', 'sql::sql_table::dbo.gone' || (n % 5), 'INFERRED', NULL FROM paths WHERE kind = 4
        UNION ALL SELECT repo, 'sql::sql_procedure::dbo.p' || n, 'depends_on_object', 'sql::sql_procedure::dbo.q' || (n % 6), 'INFERRED', NULL FROM paths WHERE kind = 4""",
    "pgedges": """
        SELECT repo, 'sql::sql_table::app.t' || n AS source, 'in_schema' AS relation, 'sql::schema::app' AS target, 'EXTRACTED' AS confidence, 'L' || (nl + 2) AS loc FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_view::app.mv' || n, 'in_schema', 'sql::schema::app', 'EXTRACTED', 'L' || (nl + 3) FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_function::app.f' || n, 'in_schema', 'sql::schema::app', 'EXTRACTED', 'L' || (nl + 4) FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_trigger::app.tg' || n, 'in_schema', 'sql::schema::app', 'EXTRACTED', 'L' || (nl + 7) FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_table::app.t' || n, 'depends_on_object', 'sql::sql_table::public.base' || (n % 10), 'INFERRED', NULL FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_view::app.mv' || n, 'depends_on_object', 'sql::sql_table::public.src' || (n % 8), 'INFERRED', NULL FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_function::app.f' || n, 'reads_table', 'sql::sql_table::app.t' || n, 'INFERRED', NULL FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_function::app.f' || n, 'writes_table', 'sql::sql_table::public.audit' || (n % 4), 'INFERRED', NULL FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_trigger::app.tg' || n, 'triggers_on', 'sql::sql_table::app.t' || n, 'EXTRACTED', 'L' || (nl + 7) FROM paths WHERE kind = 5
        UNION ALL SELECT repo, 'sql::sql_trigger::app.tg' || n, 'depends_on_object', 'sql::sql_function::app.f' || n, 'EXTRACTED', NULL FROM paths WHERE kind = 5""",
    "glues": """
        SELECT j.repo, 'job' || j.n AS name, 's3://b/etl_' || (j.n + 1) || '.py' AS script, 'cron(' || (j.n % 10) || ')' AS schedule,
               j.path, j.nl + 2 AS line, CASE WHEN s.n IS NULL THEN '' ELSE 'db.src' || (s.n % 10) END AS sources,
               CASE WHEN s.n IS NULL THEN '' ELSE 'db.dst' || (s.n % 10) END AS dests
        FROM (SELECT * FROM paths WHERE kind = 8) j LEFT JOIN (SELECT * FROM paths WHERE kind = 9) s ON s.n = j.n + 1""",
}


def _c(name, sql):
    return query(name, sql, _DOCS)


def _extractable(t):
    return t.files()


@_c(
    "a3_select_files",
    "SELECT repo, path FROM paths WHERE kind IN (0, 1, 2, 3, 9)",
)
def a3_select_files(t):
    wanted = kafka.GO_EXTENSIONS + kafka.JVM_EXTENSIONS + kafka.JS_EXTENSIONS + kafka.PY_EXTENSIONS
    return select_files(_extractable(t), None, wanted, skip_tests=True).select("repo", "path")


@_c("c1_code_topics", "SELECT repo, path, role, topic, CAST(line AS BIGINT) AS line FROM topics WHERE path NOT LIKE 'config%'")
def c1_code_topics(t):
    return kafka.code_topics(_extractable(t)).select("repo", "path", "role", "topic", "line")


@_c("c2_config_topics", "SELECT repo, path, role, topic, CAST(line AS BIGINT) AS line FROM topics WHERE path LIKE 'config%'")
def c2_config_topics(t):
    return kafka.config_topics(_extractable(t)).select("repo", "path", "role", "topic", "line")


@_c("c3_topic_roles", "SELECT repo, role, topic, path, CAST(line AS BIGINT) AS line FROM troles")
def c3_topic_roles(t):
    return kafka.topic_roles(_extractable(t)).drop("ord")


@_c(
    "c3_kafka_edges",
    """
    SELECT repo, 'repo::' || repo AS source, 'topic::' || topic AS target, role AS relation, 'INFERRED' AS confidence,
           0.75::DOUBLE AS confidence_score, path AS source_file, 'L' || line AS source_location FROM troles
    """,
)
def c3_kafka_edges(t):
    return kafka.extract(_extractable(t)).edges.select(
        "repo", "source", "target", "relation", "confidence", "confidence_score", "source_file", "source_location"
    )


def _score(markers) -> str:
    def one(regex, weight):
        quoted = regex.replace("'", "''")
        return f"CASE WHEN regexp_matches(content, '{quoted}') THEN {weight} ELSE 0 END"

    return " + ".join(one(r, w) for r, w in markers)


@_c(
    "c4_dialects",
    f"""
    SELECT path, CAST(pg AS BIGINT) AS pg, CAST(ms AS BIGINT) AS ms,
           CASE WHEN pg > ms THEN 'postgres' WHEN ms > pg THEN 'mssql' ELSE 'unknown' END AS dialect,
           CASE WHEN pg > ms THEN 'postgres' ELSE 'mssql' END AS owner
    FROM (SELECT path, {_score(POSTGRES_MARKERS)} AS pg, {_score(TSQL_MARKERS)} AS ms FROM sqlfiles)
    """,
)
def c4_dialects(t):
    text = F.col("content")
    return select_files(_extractable(t), None, (".sql",)).select(
        "path", score(text, POSTGRES_MARKERS).alias("pg"), score(text, TSQL_MARKERS).alias("ms"),
        dialect(text).alias("dialect"), owner(text).alias("owner"),
    )


@_c(
    "c5_tsql_objects",
    """
    SELECT repo, 'sql_table' AS kind, 'dbo' AS "schema", 't' || n AS name, nl + 4 AS line FROM paths WHERE kind = 4
    UNION ALL SELECT repo, 'sql_procedure', 'dbo', 'p' || n, nl + 6 FROM paths WHERE kind = 4
    """,
)
def c5_tsql_objects(t):
    return tsql.objects(_extractable(t)).select("repo", "kind", "schema", "name", "line")


_EDGE = ("repo", "source", "relation", "target", "confidence", "source_location AS loc")


@_c("c6_tsql_edges", "SELECT * FROM msedges")
def c6_tsql_edges(t):
    return tsql.extract(_extractable(t)).edges.selectExpr(*_EDGE)


@_c(
    "c7_postgres_objects",
    """
    SELECT repo, 'sql_table' AS kind, 'app' AS "schema", 't' || n AS name, nl + 2 AS line, false AS materialized FROM paths WHERE kind = 5
    UNION ALL SELECT repo, 'sql_view', 'app', 'mv' || n, nl + 3, true FROM paths WHERE kind = 5
    UNION ALL SELECT repo, 'sql_function', 'app', 'f' || n, nl + 4, false FROM paths WHERE kind = 5
    UNION ALL SELECT repo, 'sql_trigger', 'app', 'tg' || n, nl + 7, false FROM paths WHERE kind = 5
    """,
)
def c7_postgres_objects(t):
    return postgres.objects(_extractable(t)).where("kind <> 'alter'").select(
        "repo", "kind", "schema", "name", "line", "materialized"
    )


@_c("c8_postgres_edges", "SELECT * FROM pgedges")
def c8_postgres_edges(t):
    return postgres.extract(_extractable(t)).edges.selectExpr(*_EDGE)


@_c(
    "c10_code_lines",
    """
    SELECT path, CAST(count(*) AS BIGINT) AS lines FROM (
      SELECT path, unnest(range(CASE kind WHEN 0 THEN nl + 15 WHEN 1 THEN nl + 6 WHEN 2 THEN nl + 5 WHEN 3 THEN nl + 11
             WHEN 9 THEN nl + 5 ELSE nl + 3 END)) FROM paths WHERE kind IN (0, 1, 2, 3, 9, 10)) GROUP BY path
    """,
)
def c10_code_lines(t):
    return lexing.code_lines(_extractable(t)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@_c(
    "c10_code_without_comments",
    """
    SELECT path, CASE kind WHEN 0 THEN 12 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 9 WHEN 9 THEN 3 ELSE 1 END AS code_lines
    FROM paths WHERE kind IN (1, 2, 3, 9, 10)
    UNION ALL SELECT path, 12 FROM paths WHERE kind = 0
    """,
)
def c10_code_without_comments(t):
    # Lines that still hold something once comments are gone.
    lines = lexing.code_lines(_extractable(t)).where(F.trim("text") != "")
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("code_lines"))


_ROUTE = """
    SELECT repo, file, method, path, handler, CAST(line AS BIGINT) AS line, 'code' AS source, false AS documented FROM rts
    UNION ALL SELECT repo, min(file), method, path, min(handler), 0, 'openapi', true FROM specs GROUP BY repo, method, path
"""


@_c("c9_c11_c12_code_routes", "SELECT repo, file, method, path, handler, CAST(line AS BIGINT) AS line FROM rts")
def c9_c11_c12_code_routes(t):
    from loomgraph.operators.extract.http import code_routes

    found, _ = code_routes(_extractable(t))
    return found.select("repo", F.col("path").alias("file"), "method", F.col("route").alias("path"), "handler", "line")


# One file a part, each with a route of one framework: path, content, and the route as SQL.
_FRAMEWORKS = (
    ("src/r{}.go", 'package p\n  r.Get("/chi/{}", h.Get)\n', "'GET', '/chi/' || k, 'h.Get'"),
    ("src/r{}.go", '  r.HandleFunc("/gorilla/{}", h.List).Methods("POST")\n\n', "'POST', '/gorilla/' || k, 'h.List'"),
    ("src/r{}.go", 'package p\n  http.HandleFunc("/net/{}", serve)\n', "'ANY', '/net/' || k, 'serve'"),
    ("app/r{}.py", '\n@app.route("/flask/{}", methods=["PUT"])\n', "'PUT', '/flask/' || k, ''"),
    ("app/urls{}.py", 'urlpatterns = [\n    path("django/{}", views.show),\n]\n', "'ANY', 'django/' || k, 'views.show'"),
    ("web/r{}.ts", "\nrouter.patch('/express/{}', h)\n", "'PATCH', '/express/' || k, ''"),
    ("web/R{}.kt", 'class R {\n  @DeleteMapping("/spring/{}")\n', "'DELETE', '/spring/' || k, ''"),
    ("web/R{}.cs", 'class R {\n  [Route("aspnet/{}")]\n', "'ANY', 'aspnet/' || k, ''"),
    ("config/routes{}.rb", "\n  match '/rails/{}', to: 'x'\n", "'ANY', '/rails/' || k, ''"),
    ("routes/r{}.php", "<?php\nRoute::options('/laravel/{}', X::class); // Route::get('/dead/{}')\n", "'OPTIONS', '/laravel/' || k, ''"),
)


def _part_files(t, templates):
    """Files made of the rows of ``part``; the templates take turns."""
    k, repo = F.col("p_partkey").cast("string"), F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string"))
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, template in enumerate(templates):
        mine = F.col("p_partkey") % len(templates) == i
        filled = [F.array_join(F.array(*[F.lit(x) for x in text.split("{}")]), "\u0001") for text in template[:2]]
        path, content = (F.when(mine, F.replace(f, F.lit("\u0001"), k)).otherwise(old) for f, old in zip(filled, (path, content)))
    return t.table("part").select(repo.alias("repo"), path.alias("path"), content.alias("content"))


def _framework_sql() -> str:
    rows = []
    for i, (path, content, route) in enumerate(_FRAMEWORKS):
        line = 1 + content[: content.index("{}")].count("\n")
        file = "'" + path.replace("{}", "' || k || '") + "'"
        rows.append(f"SELECT repo, {file} AS file, {line} AS line, {route} FROM p WHERE k % {len(_FRAMEWORKS)} = {i}")
    columns = "repo, file, line, method, path, handler"
    return f"""
    SELECT repo, file, method, path, handler, CAST(line AS BIGINT) AS line FROM (
      WITH p AS (SELECT 'NATION_' || (p_size % 25) AS repo, p_partkey AS k FROM part) {' UNION ALL '.join(rows)}) x({columns})
    """


@_c("c9_all_frameworks", _framework_sql())
def c9_all_frameworks(t):
    """One route of each of the ten frameworks in turn."""
    from loomgraph.operators.extract.http import code_routes

    found, _ = code_routes(_part_files(t, _FRAMEWORKS))
    return found.select("repo", F.col("path").alias("file"), "method", F.col("route").alias("path"), "handler", "line")


_YAML_SPEC = (
    "api/{}/openapi.yaml",
    "openapi: 3.0.0\nservers:\n  - url: https://x.example.com/v{}/\npaths:\n  /orders/{id}:\n    get:\n"
    "      operationId: order{}\n      tags: [a, b]\n    parameters: []\n  /items:\n    post: {}\n",
)


@_c(
    "c13_yaml_spec_routes",
    """
    WITH p AS (SELECT 'NATION_' || (p_size % 25) AS repo, p_partkey AS k, 'api/' || p_partkey || '/openapi.yaml' AS file FROM part)
    SELECT repo, file, 'GET' AS method, '/v' || k || '/orders/{id}' AS path, 'order' || k AS handler, 'a|b' AS tags FROM p
    UNION ALL SELECT repo, file, 'POST', '/v' || k || '/items', '', '' FROM p
    """,
)
def c13_yaml_spec_routes(t):
    """Routes of YAML specifications, one a part."""
    path, content = _YAML_SPEC
    found, _ = routes.spec_routes(_part_files(t, [(path, content.replace("post: {}", "post: { }"))]))
    return found.select("repo", F.col("path").alias("file"), "method", F.col("route").alias("path"), "handler", "tags")


_YAML_JOB = (
    "cf/job{}.yaml",
    "AWSTemplateFormatVersion: '2010-09-09'\nResources:\n  Job:\n    Type: AWS::Glue::Job\n    Properties:\n      Name: etl-{}\n"
    "      Command:\n        ScriptLocation: !Sub 's3://b/y{}.py'\n  T:\n    Type: AWS::Glue::Trigger\n    Properties:\n"
    "      Schedule: cron({})\n      Actions: [{JobName: etl-{}}]\n",
)


@_c(
    "c16_yaml_jobs",
    """
    SELECT 'NATION_' || (p_size % 25) AS repo, 'cf/job' || p_partkey || '.yaml' AS path, 'etl-' || p_partkey AS name,
           's3://b/y' || p_partkey || '.py' AS script, 'cron(' || p_partkey || ')' AS schedule
    FROM part
    """,
)
def c16_yaml_jobs(t):
    """Glue jobs of YAML templates, one a part."""
    return glue.cloudformation_jobs(_part_files(t, [_YAML_JOB]))[0].select("repo", "path", "name", "script", "schedule")


@_c(
    "c11_unresolved_routes",
    """
    SELECT repo, 'httpapi' AS extractor, path || ':11: GET route with path identifier "Missing' || n
      || '" dropped: does not resolve to a string constant' AS message FROM paths WHERE kind = 0
    """,
)
def c11_unresolved_routes(t):
    from loomgraph.operators.extract.http import code_routes

    return code_routes(_extractable(t))[1]


@_c("c13_spec_routes", "SELECT repo, file, method, path, handler, 't' AS tags FROM specs")
def c13_spec_routes(t):
    found, _ = routes.spec_routes(_extractable(t))
    return found.select(
        "repo", F.col("path").alias("file"), "method", F.col("route").alias("path"), "handler", "tags"
    )


@_c("c14_routes", _ROUTE)
def c14_routes(t):
    found, _ = routes.routes(_extractable(t))
    return found.select("repo", "file", "method", "path", "handler", "line", "source", "documented")


@_c(
    "c14_route_edges",
    f"""
    SELECT 'repo::' || repo AS source, 'route::' || repo || '::' || method || '::' || path || '::' || file AS target,
           'exposes_route' AS relation, CASE WHEN documented THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
    FROM ({_ROUTE})
    """,
)
def c14_route_edges(t):
    return routes.extract(_extractable(t)).edges.select("source", "target", "relation", "confidence")


@_c("c15_terraform_jobs", "SELECT repo, path, name, script, schedule, line FROM glues")
def c15_terraform_jobs(t):
    return glue.terraform_jobs(_extractable(t)).select("repo", "path", "name", "script", "schedule", "line")


@_c(
    "c16_cloudformation_jobs",
    """
    SELECT 'NATION_' || (p_size % 25) AS repo, 'cf/' || p_partkey || '.json' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'J' ELSE 'etl-' || p_partkey END AS name,
           's3://b/p' || p_partkey || '.py' AS script, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'cron(' || p_size || ')' END AS schedule
    FROM part
    """,
)
def c16_cloudformation_jobs(t):
    k = F.col("p_partkey").cast("string")
    named = F.col("p_partkey") % 3 != 0
    name = F.when(named, F.concat(F.lit('"Name":"etl-'), k, F.lit('",'))).otherwise("")
    content = F.concat(
        F.lit('{"AWSTemplateFormatVersion":"2010-09-09","Resources":{"J":{"Type":"AWS::Glue::Job","Properties":{'),
        name, F.lit('"Command":{"ScriptLocation":"s3://b/p'), k,
        F.lit('.py"}}},"T":{"Type":"AWS::Glue::Trigger","Properties":{"Schedule":"cron('), F.col("p_size").cast("string"),
        F.lit(')","Actions":[{"JobName":"etl-'), k, F.lit('"}]}}}}'),
    )
    repo = F.concat(F.lit("NATION_"), (F.col("p_size") % 25).cast("string"))
    files = t.table("part").select(
        repo.alias("repo"), F.concat(F.lit("cf/"), k, F.lit(".json")).alias("path"), content.alias("content")
    )
    return glue.cloudformation_jobs(files)[0].select("repo", "path", "name", "script", "schedule")


_ALONE = """
    SELECT repo, 'etl_' || n AS name, path AS script, '' AS schedule, path, 0 AS line, 'db.src' || (n % 10) AS sources,
           'db.dst' || (n % 10) AS dests
    FROM paths WHERE kind = 9 AND n - 1 NOT IN (SELECT n FROM paths WHERE kind = 8)
"""


@_c("c17_glue_jobs", f"SELECT * FROM glues UNION ALL {_ALONE}")
def c17_glue_jobs(t):
    return glue.jobs(_extractable(t))[0].select(
        "repo", "name", "script", "schedule", "path", "line", "sources", "dests"
    )


@_c(
    "c18_glue_edges",
    """
    SELECT 'repo::' || repo AS source, 'glue::job::' || repo || '::' || name AS target, 'contains' AS relation, NULL AS context FROM glues
    UNION ALL SELECT 'glue::job::' || repo || '::' || name, 'sql::sql_table::' || sources, 'reads_source', NULL FROM glues WHERE sources <> ''
    UNION ALL SELECT 'glue::job::' || repo || '::' || name, 'sql::sql_table::' || dests, 'writes_destination', NULL FROM glues WHERE dests <> ''
    UNION ALL SELECT 'glue::schedule::' || repo || '::' || name, 'glue::job::' || repo || '::' || name, 'scheduled', schedule FROM glues
    """,
)
def c18_glue_edges(t):
    return glue.extract(_extractable(t)).edges.select("source", "target", "relation", "context")


@_c(
    "c19_dependency_edges",
    """
    SELECT 'repo::' || repo AS source, 'pkg::pypi::pkg' || (n % 60) AS target, 'depends_on' AS relation, 'runtime' AS context FROM paths WHERE kind = 11
    UNION ALL SELECT 'repo::' || repo, 'pkg::pypi::org-lib' || (n % 9), 'depends_on', 'runtime' FROM paths WHERE kind = 11
    UNION ALL SELECT 'repo::' || repo, 'repo::lib' || (n % 9), 'depends_on_repo', 'runtime' FROM paths WHERE kind = 11
    """,
)
def c19_dependency_edges(t):
    found = deps.extract(deps.manifest_deps(_extractable(t)), ["org-"])
    return found.edges.select("source", "target", "relation", "context")


@_c(
    "c20_run_summary",
    """
    SELECT repo, extractor, CAST(sum(e) AS BIGINT) AS edges, CAST(sum(w) AS BIGINT) AS warnings, false AS failed FROM (
      SELECT repo, 'kafka' AS extractor, count(*) AS e, 0 AS w FROM troles GROUP BY repo
      UNION ALL SELECT repo, 'mssql', count(*), 0 FROM msedges GROUP BY repo
      UNION ALL SELECT repo, 'postgres', count(*), 0 FROM pgedges GROUP BY repo)
    GROUP BY repo, extractor
    """,
)
def c20_run_summary(t):
    files = _extractable(t)
    all_ = kafka.extract(files) + tsql.extract(files) + postgres.extract(files)
    broken = build.violations(all_.nodes, all_.edges)
    none = broken.select("repo", "extractor", F.lit("").alias("message")).where(F.lit(False))
    summary = build.run_summary(all_.nodes, all_.edges, none, broken)
    return summary.select("repo", "extractor", "edges", "warnings", "failed")


# --- the whole run, from files to the store -----------------------------------


def _indexed(t, allow_partial: bool, extractors: dict | None = None):
    """Status of an index run over all files into an empty store, and the topics and jobs that it owns."""
    files = _extractable(t)
    runs = files.select("repo").distinct().select("repo", F.lit("c1").alias("commit"), F.lit("r1").alias("run"))
    store = GraphStore(t.spark, f"{work_folder(t.spark)}/indexed")
    none = {kind: t.spark.createDataFrame([], "repo string, ord long, " + ", ".join(f"`{n}` {d.simpleString()}" for n, d in fields.items()))
            for kind, fields in (("nodes", schemas.NODE_FIELDS), ("links", schemas.LINK_FIELDS))}
    status = index_files(store, none["nodes"], none["links"], files, runs, allow_partial, ["org-"], extractors)
    graph = store.read()
    owned = graph.ownership.join(graph.entities.select("node_key", "label"), "node_key").groupBy("repo").agg(
        F.count(F.when(F.col("label") == "KafkaTopic", True)).alias("topics"),
        F.count(F.when(F.col("label") == "GlueJob", True)).alias("jobs"),
    )
    zero = F.lit(0)
    return status.join(owned, "repo", "left").select(
        "repo", "status", F.coalesce("topics", zero).alias("topics"), F.coalesce("jobs", zero).alias("jobs")
    )


_OWNED = f"""
    SELECT r.repo, coalesce(topics, 0) AS topics, coalesce(jobs, 0) AS jobs FROM (SELECT DISTINCT repo FROM paths) r
    LEFT JOIN (SELECT repo, count(DISTINCT topic) AS topics FROM troles GROUP BY repo) k ON k.repo = r.repo
    LEFT JOIN (SELECT repo, count(DISTINCT name) AS jobs FROM (SELECT repo, name FROM glues UNION ALL SELECT repo, name FROM ({_ALONE}))
               GROUP BY repo) g ON g.repo = r.repo"""


@_c("index_run_from_files", f"SELECT repo, 'success' AS status, topics, jobs FROM ({_OWNED})")
def index_run_from_files(t):
    return _indexed(t, False)


_LIMPING = ("NATION_1", "NATION_4", "NATION_9")


def _limping(files):
    """Kafka extraction that loses a topic's name in some repositories."""
    found = kafka.extract(files)
    lost = F.col("repo").isin(*_LIMPING)
    nodes = found.nodes.withColumn("label", F.when(~lost, F.col("label")))
    return Fragments(nodes, found.edges, found.warnings)


@_c(
    "index_run_fails_closed",
    f"""SELECT repo, CASE WHEN repo IN {_LIMPING} THEN 'failed' ELSE 'success' END AS status,
        CASE WHEN repo IN {_LIMPING} THEN 0 ELSE topics END AS topics, CASE WHEN repo IN {_LIMPING} THEN 0 ELSE jobs END AS jobs
    FROM ({_OWNED}) WHERE repo NOT IN {_LIMPING} OR repo IN (SELECT repo FROM troles)""",
)
def index_run_fails_closed(t):
    return _indexed(t, False, {"kafka": _limping, "glue": glue.extract})


@_c(
    "index_run_allow_partial",
    f"SELECT repo, 'success' AS status, CASE WHEN repo IN {_LIMPING} THEN 0 ELSE topics END AS topics, jobs FROM ({_OWNED})",
)
def index_run_allow_partial(t):
    return _indexed(t, True, {"kafka": _limping, "glue": glue.extract})
