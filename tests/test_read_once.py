"""Costly steps run once, however often their result is read."""

from loomgraph.operators.extract import glue, routes

TEMPLATE = """Resources:
  J:
    Type: AWS::Glue::Job
    Properties:
      Name: etl
      Command: {ScriptLocation: !Sub 's3://b/y.py'}
  T:
    Type: AWS::Glue::Trigger
    Properties:
      Schedule: cron(1)
      Actions: [{JobName: etl}]
"""
SPEC = "openapi: 3.0.0\npaths:\n  /a:\n    get:\n      operationId: x\n"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_yaml_is_read_once(files):
    rows = files(("cf/a.yaml", TEMPLATE), ("cf/bad.yaml", "AWS::Glue::Job: [x"), ("api/openapi.yaml", SPEC))
    jobs, unread = glue.cloudformation_jobs(rows)
    found, _ = routes.spec_routes(rows)
    for df in (jobs, unread, found):
        assert "convert(" not in _plan(df)
    assert [(r.name, r.script, r.schedule) for r in jobs.collect()] == [("etl", "s3://b/y.py", "cron(1)")]
    assert [r.message for r in unread.collect()] == ["cf/bad.yaml: template cannot be read"]
    assert [(r.method, r.route, r.handler) for r in found.collect()] == [("GET", "/a", "x")]
