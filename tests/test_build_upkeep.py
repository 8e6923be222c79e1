import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import build, upkeep
from loomgraph.plans.index_run import import_run
from loomgraph.sources.store import GraphStore


def nodes(spark, *rows):
    """(repo, ord, id, label[, origin, type, version])"""
    full = [tuple(r) + (None,) * (7 - len(r)) for r in rows]
    df = spark.createDataFrame(
        full, "repo string, ord int, id string, label string, origin string, type string, version string"
    )
    df = df.withColumn("metadata", schemas.metadata_struct(version=F.col("version"))).drop("version")
    return schemas.conform(df, schemas.NODE_FIELDS, keep=("repo", "ord"))


def links(spark, *rows):
    """(repo, ord, source, target, relation[, weight])"""
    full = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
    df = spark.createDataFrame(
        full, "repo string, ord int, source string, target string, relation string, weight double"
    )
    return schemas.conform(df, schemas.LINK_FIELDS, keep=("repo", "ord"))


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), "repo string, commit string, run string")


def test_merge_fills_gaps_only(spark):
    graph = nodes(spark, ("r", 0, "a", "A"), ("r", 1, "b", "B", None, "sql_view", "1"))
    frags = nodes(spark, ("r", 0, "a", "other", "platform", "sql_table", "2"), ("r", 1, "c", "C")).withColumn(
        "extractor", F.lit("x")
    )
    out = {r.id: r for r in build.merge_nodes(graph, frags).collect()}
    assert set(out) == {"a", "b", "c"}
    assert (out["a"].label, out["a"].type, out["a"].metadata.version) == ("A", "sql_table", "2")
    assert (out["b"].type, out["b"].metadata.version) == ("sql_view", "1")


def test_fragment_dedup_and_edge_defaults(spark):
    rows = nodes(spark, ("r", 1, "a", ""), ("r", 2, "a", "Second", None, "package"), ("r", 3, "a", "Third", None, "sql_table", "3"))
    one = build.dedup_fragment_nodes(rows.withColumn("extractor", F.lit("x"))).first()
    assert (one.label, one.type, one.metadata.version, one.origin) == ("Second", "package", "3", "platform")
    edges = spark.createDataFrame(
        [(None, None, None), ("INFERRED", 0.0, 2.0), ("AMBIGUOUS", 0.9, 0.0), ("BAD", None, None)],
        "confidence string, confidence_score double, weight double",
    )
    got = [tuple(r) for r in build.edge_defaults(edges).collect()]
    assert got == [("EXTRACTED", 1.0, 1.0), ("INFERRED", 0.75, 2.0), ("AMBIGUOUS", 0.9, 1.0), ("BAD", 0.0, 1.0)]


def test_resolve_counts_unknown_before_dangling(spark):
    ns = nodes(spark, ("r", 0, "a", "A"), ("r", 1, "b", "B"))
    ls = links(spark, ("r", 0, "a", "b", "calls"), ("r", 1, "a", "zz", "bogus"), ("r", 2, "a", "zz", "calls"))
    status = [r.status for r in build.resolve_links(ls, ns).orderBy("ord").collect()]
    assert status == ["ok", "unknown", "dangling"]


def graph_of(spark, ns, ls, rs, before=None):
    before = before or upkeep.Graph(
        *[
            spark.createDataFrame([], ", ".join(f"{n} {d.simpleString()}" for n, d in f.items()))
            for f in (schemas.ENTITY_FIELDS, schemas.EDGE_FIELDS, schemas.OWNERSHIP_FIELDS)
        ]
    )
    entities = build.to_entities(ns)
    edges = build.to_edges(build.resolve_links(ls, ns))
    return upkeep.Graph(
        upkeep.upsert_nodes(before.entities, entities, rs),
        upkeep.upsert_edges(before.edges, edges, rs),
        upkeep.upsert_ownership(before.ownership, entities, rs),
    )


SQL_A = ("sql::sql_table::dbo.a", "dbo.a", "platform", "sql_table")
SQL_B = ("sql::sql_table::dbo.b", "dbo.b", "platform", "sql_table")


def shared_pair(spark, repo):
    ns = nodes(spark, (repo, 0, *SQL_A), (repo, 1, *SQL_B))
    ls = links(spark, (repo, 0, SQL_A[0], SQL_B[0], "depends_on_object"))
    return ns, ls


def test_shared_edges_are_per_repository_and_swept_apart(spark):
    n1, l1 = shared_pair(spark, "r1")
    n2, l2 = shared_pair(spark, "r2")
    both = graph_of(spark, n1.unionByName(n2), l1.unionByName(l2), runs(spark, ("r1", "c", "1"), ("r2", "c", "1")))
    assert sorted(r.repo for r in both.edges.collect()) == ["r1", "r2"]
    assert both.entities.count() == 2 and both.entities.where("repo IS NOT NULL").count() == 0
    # r1 no longer writes anything: its edge goes, the shared nodes stay for r2.
    swept = upkeep.sweep(both, runs(spark, ("r1", "c", "2")))
    assert [r.repo for r in swept.edges.collect()] == ["r2"] and swept.entities.count() == 2
    again = upkeep.sweep(swept, runs(spark, ("r2", "c", "2")))
    assert again.edges.count() == 0 and again.entities.count() == 0 and again.ownership.count() == 0


def test_hash_gate_keeps_drift_until_forced(spark):
    ns, ls = nodes(spark, ("r", 0, "a", "A")), links(spark)
    first = graph_of(spark, ns, ls, runs(spark, ("r", "c1", "1")))
    drift = upkeep.Graph(first.entities.withColumn("name", F.lit("edited")), first.edges, first.ownership)
    rs = runs(spark, ("r", "c2", "2"))
    kept = upkeep.upsert_nodes(drift.entities, build.to_entities(ns), rs).first()
    assert (kept.name, kept.last_run) == ("edited", "2")
    assert upkeep.upsert_nodes(drift.entities, build.to_entities(ns), rs, rewrite_all=True).first().name == "A"
    relabeled = ns.withColumn("type", F.lit("sql_view"))
    assert upkeep.upsert_nodes(first.entities, build.to_entities(relabeled), rs).first().label == "SqlView"


def test_last_row_wins_and_unstamped_rows_are_swept(spark):
    ns = nodes(spark, ("r", 0, "a", "A"), ("r", 1, "b", "B"))
    ls = links(spark, ("r", 0, "a", "b", "calls", 1.0), ("r", 1, "a", "b", "calls", 5.0))
    g = graph_of(spark, ns, ls, runs(spark, ("r", "c", "1")))
    assert [r.weight for r in g.edges.collect()] == [5.0]
    legacy = upkeep.Graph(
        g.entities, g.edges.withColumn("repo", F.lit(None).cast("string")).withColumn("last_run", F.lit(None).cast("string")),
        g.ownership,
    )
    assert upkeep.sweep(legacy, runs(spark, ("r", "c", "1"))).edges.count() == 0


def test_refusals(spark):
    g = graph_of(spark, nodes(spark), links(spark), runs(spark, ("r", "c", "1")))
    for bad in (("r", "", "1"), ("r", "c", ""), ("", "c", "1")):
        with pytest.raises(ValueError):
            upkeep.sweep(g, runs(spark, bad))
    with pytest.raises(ValueError):
        upkeep.delete_repositories(g, spark.createDataFrame([], "name string"), [""])


def test_import_twice_is_import_once_and_untouched_parts_stay(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "graph"))
    ns = nodes(spark, ("r1", 0, "a", "A"), ("r1", 1, "b", "B"), ("r2", 0, "c", "C"), ("r1", 2, *SQL_A))
    ls = links(spark, ("r1", 0, "a", "b", "calls"), ("r1", 1, "b", SQL_A[0], "reads_table"))
    verdicts = import_run(store, ns, ls, runs(spark, ("r1", "c1", "x1"), ("r2", "c1", "x1")))
    assert {r.status for r in verdicts.collect()} == {"success"}

    def content():
        g = store.read()
        return sorted(r.node_key for r in g.entities.collect()), sorted((r.src, r.dst) for r in g.edges.collect())

    once = content()
    import_run(store, ns.where("repo = 'r1'"), ls, runs(spark, ("r1", "c1", "x2")))
    assert content() == once
    live = {r.part: r.generation for r in store.current().collect()}
    assert live["r2"] == 1 and live["r1"] == 2
    # r1 shrinks to nothing: its nodes, its edges and the orphaned shared node go.
    gone = import_run(store, ns.where("repo = 'r1'").limit(0), ls.limit(0), runs(spark, ("r1", "c3", "x3")))
    assert [r.status for r in gone.collect()] == ["success"]
    assert [r.name for r in store.read().entities.collect()] == ["C"]
