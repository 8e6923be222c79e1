import json
from types import SimpleNamespace

from loomgraph.operators.extract import routes
from loomgraph.plans import extract_queries

MIB = 1 << 20


def test_large_files_are_read_whole(files):
    spec = json.dumps({"openapi": "3.0", "info": {"description": "x" * (11 * MIB)}, "paths": {"/a": {"get": {"operationId": "f"}}}})
    rows = files(
        ("api/openapi.json", spec),
        ("db/large.sql", "CREATE TABLE t (id int) -- " + "x" * (9 * MIB)),
        ("src/large.go", "package a // " + "x" * (3 * MIB)),
    )
    table = SimpleNamespace(files=lambda: rows)
    route = [("api/openapi.json", "GET", "/a")]
    found, unread = routes.spec_routes(rows)
    assert [(r.path, r.method, r.route) for r in found.collect()] == route and unread.count() == 0
    limited, unread = routes.spec_routes(rows, max_bytes=10 * MIB)
    assert limited.count() == 0 and "exceeds the cap" in unread.first().message
    assert [(r.file, r.method, r.path) for r in extract_queries.c13_spec_routes(table).collect()] == route
    assert [r.path for r in extract_queries.c4_dialects(table).collect()] == ["db/large.sql"]
    assert [r.path for r in extract_queries.a3_select_files(table).collect()] == ["src/large.go"]
