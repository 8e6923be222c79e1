from pyspark.sql import functions as F

from loomgraph.operators import build
from loomgraph.operators.extract import deps, glue, kafka, postgres, routes, tsql
from loomgraph.operators.extract.dialect import dialect, owner


def topics(files, *rows):
    return {(r.role, r.topic) for r in kafka.topic_roles(files(*rows)).collect()}


def test_kafka_code(files):
    assert topics(
        files,
        ("a.go", 'w := kafka.Writer{\n  Addr: x,\n  Topic: "orders.v1",\n}\nc.SubscribeTopics([]string{"in.a", "in.b"}, nil)\n'),
        ("B.java", 'k.send(new ProducerRecord<String, String>("jvm.out", v));\n@KafkaListener(topics = {"jvm.in"})\n'),
        ("c.ts", 'await p.send({ topic: "js.out" })\nc.subscribe({ topic: `x`, topic: \'js.in\' })\n'),
        ("d.py", 'p.produce("py.out")\nKafkaConsumer("py.in")\n'),
        ("node_modules/e.py", 'p.produce("skipped")\n'),
        ("f.txt", 'p.produce("skipped")\n'),
    ) == {
        ("produces", "orders.v1"), ("consumes", "in.a"), ("produces", "jvm.out"), ("consumes", "jvm.in"),
        ("produces", "js.out"), ("consumes", "js.in"), ("produces", "py.out"), ("consumes", "py.in"),
    }


def test_kafka_yaml_roles_and_rejects(files):
    text = (
        "app:\n  producer:\n    topic: 'out.a' # note\n  consumer:\n    topics: [in.a, TBD, \"in.b\"]\n"
        "  topic: plain.x\n  topic-path: /not/a/topic\n  other-topic: in.a\n"
    )
    assert topics(files, ("config/kafka.yml", text)) == {
        ("produces", "out.a"), ("consumes", "in.a"), ("consumes", "in.b"), ("references", "plain.x"),
    }
    assert topics(files, ("config/app.yml", "x:\n  topic: plain.x\n")) == set()


def test_kafka_first_occurrence_follows_directory_order(files):
    row = kafka.topic_roles(files(("a.py", 'p.send("t.x")'), ("a/z.py", '\np.send("t.x")'))).first()
    assert (row.path, row.line) == ("a/z.py", 2)


def test_dialects(spark):
    cases = [
        ("CREATE TABLE t (id int)", "unknown"),
        ("CREATE TABLE t (id serial)", "postgres"),
        ("SELECT 1\nGO\n", "mssql"),
        ("CREATE FUNCTION f() AS $$ BEGIN END $$ LANGUAGE plpgsql", "postgres"),
        ("CREATE TABLE [dbo].[t] (a NVARCHAR(MAX))", "mssql"),
        ("select x::text", "postgres"),
    ]
    df = spark.createDataFrame(cases, "text string, want string")
    got = df.select(dialect(F.col("text")).alias("d"), owner(F.col("text"), "postgres").alias("o")).collect()
    assert [r.d for r in got] == [c[1] for c in cases]
    assert got[0].o == "postgres"


def edges(fragments):
    return {(r.source.split("::")[-1], r.relation, r.target.split("::", 1)[1]) for r in fragments.edges.collect()}


def test_tsql_objects_and_edges(files):
    sql = (
        "SET NOCOUNT ON\nGO\nCREATE SCHEMA sales\nGO\nCREATE TABLE [dbo].[Orders] (id int,\n"
        " FOREIGN KEY (id) REFERENCES sales.Customers(id))\nGO\nCREATE OR ALTER PROC usp_Load AS\n"
        "  DELETE FROM dbo.Old\n  INSERT INTO dbo.New SELECT * FROM Orders o JOIN sales.Customers c ON 1=1\n"
        "  EXEC dbo.usp_Next\n  EXEC sp_executesql @x\nGO\nCREATE VIEW v AS SELECT * FROM Orders\nGO\n"
        "CREATE TRIGGER trg ON dbo.Orders AFTER UPDATE\nAS\n  UPDATE dbo.Audit SET a = 1 FROM inserted\n"
    )
    got = edges(tsql.extract(files(("db/a.sql", sql))))
    assert got == {
        ("dbo.Orders", "in_schema", "schema::dbo"), ("dbo.usp_Load", "in_schema", "schema::dbo"),
        ("dbo.v", "in_schema", "schema::dbo"), ("dbo.trg", "in_schema", "schema::dbo"),
        ("dbo.Orders", "depends_on_object", "sql_table::sales.Customers"),
        ("dbo.usp_Load", "writes_table", "sql_table::dbo.Old"),
        ("dbo.usp_Load", "writes_table", "sql_table::dbo.New"),
        ("dbo.usp_Load", "reads_table", "sql_table::dbo.Orders"),
        ("dbo.usp_Load", "reads_table", "sql_table::sales.Customers"),
        ("dbo.usp_Load", "depends_on_object", "sql_procedure::dbo.usp_Next"),
        ("dbo.v", "depends_on_object", "sql_table::dbo.Orders"),
        ("dbo.trg", "triggers_on", "sql_table::dbo.Orders"),
        ("dbo.trg", "writes_table", "sql_table::dbo.Audit"),
    }


PG = (
    "-- CREATE TABLE dead (x int);\n/* CREATE TABLE a /* nested */ CREATE TABLE b */\n"
    'CREATE TABLE IF NOT EXISTS "Orders" (id serial, c int REFERENCES app.customers, t text DEFAULT \'CREATE TABLE s\');\n'
    "CREATE MATERIALIZED VIEW mv AS WITH x AS (SELECT * FROM base) SELECT * FROM x, unnest(arr) JOIN gen(1) g ON true;\n"
    "CREATE OR REPLACE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $body$\nBEGIN\n -- INSERT INTO hidden\n"
    "  INSERT INTO audit SELECT it.* FROM orders; DELETE FROM ONLY old_rows; PERFORM note(1); CALL app.p();\nEND $body$;\n"
    "CREATE TRIGGER tg AFTER INSERT ON app.orders FOR EACH ROW EXECUTE FUNCTION f();\n"
    "ALTER TABLE ONLY app.orders ADD CONSTRAINT k FOREIGN KEY (c) REFERENCES customers(id);\n"
    "ALTER TABLE app.orders ADD CONSTRAINT k2 FOREIGN KEY (c) REFERENCES customers(id);\nSELECT * FROM tail;\n"
)


def test_postgres_objects_and_edges(files):
    fragments = postgres.extract(files(("db/b.sql", PG)))
    got = edges(fragments)
    assert got == {
        ("public.Orders", "in_schema", "schema::public"), ("public.mv", "in_schema", "schema::public"),
        ("public.f", "in_schema", "schema::public"), ("app.tg", "in_schema", "schema::app"),
        ("public.Orders", "depends_on_object", "sql_table::app.customers"),
        ("public.mv", "depends_on_object", "sql_table::public.base"),
        ("public.f", "writes_table", "sql_table::public.audit"),
        ("public.f", "reads_table", "sql_table::public.orders"),
        ("public.f", "writes_table", "sql_table::public.old_rows"),
        ("public.f", "depends_on_object", "sql_function::public.note"),
        ("public.f", "depends_on_object", "sql_procedure::app.p"),
        ("app.tg", "triggers_on", "sql_table::app.orders"),
        ("app.tg", "depends_on_object", "sql_function::public.f"),
        ("app.orders", "depends_on_object", "sql_table::public.customers"),
    }
    made = build.dedup_fragment_nodes(fragments.nodes).collect()
    assert {r.id: r.metadata.materialized for r in made if r.type == "sql_view"} == {"sql::sql_view::public.mv": True}
    assert fragments.edges.where("context = 'foreign key'").count() == 1
    lines = {r.label: r.source_location for r in made if r.source_location}
    assert lines == {"public.Orders": "L3", "public.mv": "L4", "public.f": "L5", "app.tg": "L10"}


def routed(files, *rows):
    found, warnings = routes.routes(files(*rows))
    return {(r.method, r.path) for r in found.collect()}, [w.message for w in warnings.collect()]


def test_go_constants_groups_and_wrapped_calls(files):
    got, warnings = routed(
        files,
        ("consts.go", 'package c\nconst (\n  V1 = "/v1"\n  Charges Route = V1 + "/charges"\n  EMPTY = ""\n  URL = "https://x"\n  Loop = Loop2\n  Loop2 = Loop\n)\n'),
        ("main.go",
         'func f() {\n  api := r.Group("/api")\n  v1 := api.Group(constants.V1)\n  v1.POST(constants.Charges, h.Create)\n'
         '  v1.GET(constants.EMPTY, h.Own)\n  r.GET(local, h)\n  local := "/health"\n  r.GET(constants.URL, h)\n  r.GET(constants.Loop, h)\n'
         '  api.PUT(\n    "/wrapped/:id",\n    h.Put,\n  )\n  // r.GET("/dead", h)\n  viper.Get("server.port")\n  x.Get("/chi", h)\n}\n'),
        ("main_test.go", 'r.GET("/test", h)\n'),
        ("testdata/x.go", 'r.GET("/data", h)\n'),
    )
    assert got == {
        ("POST", "/api/v1/v1/charges"), ("GET", "/api/v1"), ("GET", "/health"), ("PUT", "/api/wrapped/:id"), ("GET", "/chi"),
    }
    assert len(warnings) == 2 and all("does not resolve" in w for w in warnings)


def test_other_frameworks(files):
    got, _ = routed(
        files,
        ("a.py", '@bp.route("/f", methods=["POST", "GET"])\n@app.delete("/fa")\n# @app.get("/dead")\nre_path(r"dj/x", views.x)\n'),
        ("b.ts", 'router.all("/all", h) // app.get("/dead")\nconst t = `\n app.get("/tpl")\n`; app.patch(\'/p\', h)\n'),
        # The fixed verb pattern knows no closing parenthesis, so a verb with a path gives nothing.
        ("c.cs", '[HttpGet("{id}")]\n[HttpPost]\n[Route("api/x")]\n'),
        ("d.rb", "  match '/m', to: 'x'\n"),
        ("e.php", "Route::post('/l', X::class); # Route::get('/dead')\n"),
    )
    assert got == {
        ("POST", "/f"), ("DELETE", "/fa"), ("ANY", "/dj/x"), ("ANY", "/all"), ("PATCH", "/p"),
        ("POST", "/"), ("ANY", "/api/x"), ("ANY", "/m"), ("POST", "/l"),
    }


def test_spring_prefixes(files):
    got, _ = routed(
        files,
        ("A.java",
         '@RestController\n@RequestMapping("/api")\n@Secured\npublic class A {\n  @GetMapping("/u")\n  A u() {}\n'
         '  @RequestMapping(value = "/old", method = RequestMethod.PUT)\n  A o() {}\n  @RequestMapping("/any")\n  A p() {}\n}\n'),
        ("B.kt", '@RequestMapping("/inline") class B {\n  @PostMapping("save")\n'),
        ("C.java", 'class C {\n  @RequestMapping("/tail")\n'),
        ("D.java", '@GetMapping("/bare")\n'),
    )
    assert got == {
        ("GET", "/api/u"), ("PUT", "/api/old"), ("ANY", "/api/any"), ("POST", "/inline/save"), ("ANY", "/tail"), ("GET", "/bare"),
    }


def test_specification_wins_over_code(files):
    spec = '{"swagger":"2.0","basePath":"/api","paths":{"/tx/{id}":{"get":{"operationId":"tx","tags":["a"]}},"/only":{"post":{}}}}'
    yml = "openapi: 3.0.0\nservers:\n  - url: https://h.io/v3/\npaths:\n  /y:\n    put: {}\n"
    found, warnings = routes.routes(
        files(("docs/swagger.json", spec), ("openapi.yaml", yml), ("old-openapi.json", "{}"), ("x.js", 'app.get("/api/tx/:id", h)\napp.get("/health", h)\n'))
    )
    rows = {(r.method, r.path): (r.source, r.documented, r.classification) for r in found.collect()}
    assert rows == {
        ("GET", "/api/tx/{id}"): ("openapi", True, "business"), ("POST", "/api/only"): ("openapi", True, "business"),
        ("PUT", "/v3/y"): ("openapi", True, "business"), ("GET", "/health"): ("code", False, "infra"),
    }
    assert [w.message for w in warnings.collect()] == ["old-openapi.json: openapi parse: no version key"]


def test_glue_jobs_merge_scripts(files):
    script = (
        "from awsglue.job import Job\njob = Job(glueContext)\n"
        'glueContext.create_dynamic_frame.from_catalog(database="db", table_name="src")\n'
        "glueContext.write_dynamic_frame.from_catalog(frame=f, database='db', table_name='dst')\n"
    )
    tf = (
        'resource "aws_glue_job" "res" {\n  script_location = "s3://b/etl.py"\n}\n'
        'resource "aws_glue_trigger" "t" {\n  schedule = "cron(1)"\n  job_name = "res"\n}\n'
    )
    cfn = (
        'AWSTemplateFormatVersion: "2010"\nResources:\n  J:\n    Type: AWS::Glue::Job\n    Properties:\n'
        "      Command: {ScriptLocation: !Sub 's3://x/cf.py'}\n  T:\n    Type: AWS::Glue::Trigger\n"
        "    Properties:\n      Schedule: cron(2)\n      Actions: [{JobName: J}]\n"
    )
    found, _ = glue.jobs(files(("a.tf", tf), ("b.yaml", cfn), ("jobs/etl.py", script), ("jobs/solo.py", script), ("c.py", "import boto3")))
    rows = {r.name: (r.schedule, r.sources, r.dests, r.line) for r in found.collect()}
    assert rows == {
        "res": ("cron(1)", ["db.src"], ["db.dst"], 1), "J": ("cron(2)", [], [], 0), "solo": ("", ["db.src"], ["db.dst"], 0),
    }


def test_dependencies(files):
    rows = deps.manifest_deps(files(("go.mod", "module x\nrequire (\n\tgithub.com/org/lib v1.0.0\n\tgolang.org/x/net v0.1.0 // indirect\n)\n"), ("package.json", '{"devDependencies":{"jest":"1"}}')))
    got = edges(deps.extract(rows, ["github.com/org/"]))
    assert got == {
        ("r", "depends_on", "go::github.com/org/lib"), ("r", "depends_on", "go::golang.org/x/net"),
        ("r", "depends_on", "npm::jest"), ("r", "depends_on_repo", "lib"),
    }


def test_names_and_groups_resolve_to_any_depth(files):
    chain = "\n".join(f"const N{i} = N{i + 1}" for i in range(30))
    groups = "\n".join(f'  g{i + 1} := g{i}.Group("/p{i + 1}")' for i in range(30))
    text = (
        f'package p\n{chain}\nconst N30 = "/deep" + Tail\nconst Tail = "/end"\nconst A = B\nconst B = A\n'
        f'func f(g0 R) {{\n{groups}\n  g30.GET("/x", h)\n  g0.POST(N0, h)\n  g0.PUT(A, h)\n  c := c.Group("/loop")\n  c.GET("/y", h)\n}}\n'
    )
    found = routes.extract(files(("a.go", text)))
    names = {n.label for n in found.nodes.collect() if n.type == "http_route"}
    assert names == {"GET " + "".join(f"/p{i}" for i in range(1, 31)) + "/x", "POST /deep/end", "GET /loop/y"}
    assert [w.message.split('"')[1] for w in found.warnings.collect() if "dropped" in w.message] == ["A"]


def test_bounds_of_wrapped_calls_can_be_lifted(files):
    from loomgraph.operators.extract import http, lexing

    text = "package p\nfunc f() {\n  r.GET(\n" + "\n".join(f"    // {i}" for i in range(30)) + '\n    "/late", h)\n}\n'
    code = lexing.code_files(files(("a.go", text)))
    assert not [r for r in http.wrapped_calls(code).collect() if "/late" in r.text]
    assert [r.line for r in http.wrapped_calls(code, None, None).collect() if "/late" in r.text] == [3]
