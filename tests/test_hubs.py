"""Hubs: nodes with a large part of all edges must not meet them in one task."""

import pytest

from loomgraph import schemas
from loomgraph.operators import upkeep
from loomgraph.plans.projections import GraphTables

HUB = "platform::repo::A"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _graph(spark):
    def rows(data, columns, fields):
        return schemas.conform(spark.createDataFrame(data, columns), fields)

    return upkeep.Graph(
        rows([(HUB, None), ("a", "A"), ("b", "B")], "node_key string, repo string", schemas.ENTITY_FIELDS),
        rows([(HUB, "a"), (HUB, "b"), ("b", HUB), ("a", "b")], "src string, dst string", schemas.EDGE_FIELDS),
        rows([("A", "a"), ("B", "b"), ("A", HUB)], "repo string, node_key string", schemas.OWNERSHIP_FIELDS),
    )


def test_shared_ends_pass_without_a_join(spark, no_broadcast):
    def left(*keys):
        kept = upkeep._detach(_graph(spark), spark.createDataFrame([(k,) for k in keys], "node_key string"))
        return kept, sorted((r.src, r.dst) for r in kept.edges.collect()), sorted(r.node_key for r in kept.ownership.collect())

    kept, edges, owned = left("a")
    assert (edges, owned) == ([("b", HUB), (HUB, "b")], ["b", HUB])
    assert "Union" in _plan(kept.edges)
    # A removed key that looks shared still takes its edges with it.
    _, edges, owned = left(HUB)
    assert (edges, owned) == ([("a", "b")], ["a", "b"])


def test_an_end_is_taken_once_before_it_meets_the_shared_nodes(spark, no_broadcast):
    touched = upkeep.touched_shared(_graph(spark).edges, spark.createDataFrame([(HUB,), ("platform::repo::Z",)], "node_key string"))
    plan = _plan(touched)
    assert plan.index("LeftSemi") < plan.index("Aggregate")
    assert [r.node_key for r in touched.collect()] == [HUB]


def test_raw_graph_needs_no_edges_of_routes(spark, monkeypatch):
    def refuse(self):
        raise AssertionError("edges of routes")

    monkeypatch.setattr(GraphTables, "_routes_on_packages", refuse)
    t = GraphTables(spark, "/root/testdata/sf0.001")
    packages = t.derive_raw_nodes().where("type = 'package' AND id LIKE 'pkg::%'")
    assert packages.count() == t.repository_packages().count() > 0
