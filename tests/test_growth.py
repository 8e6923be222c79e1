"""Work that must not grow faster than its input."""

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas, session
from loomgraph.operators import build, hotspots, upkeep
from loomgraph.operators.search_index import SearchIndex
from loomgraph.plans import graph_queries
from loomgraph.plans.projections import GraphTables
from loomgraph.sources.store import shared_ends


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ownership_is_made_without_the_edges(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("links are resolved for ownership")

    monkeypatch.setattr(build, "resolve_links", refuse)
    t = GraphTables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(t, "_stored", lambda name, make, fields, partition=None: make())
    assert graph_queries.stored_first_run(t).ownership.count() == t.derive_raw_nodes().count()


def test_links_of_a_shared_end_meet_it_by_broadcast(spark, no_broadcast, monkeypatch):
    nodes = schemas.conform(
        spark.createDataFrame([("r", 1, "hub"), ("r", 2, "a"), ("r", 3, "b"), ("q", 1, "hub")], "repo string, ord long, id string"),
        schemas.NODE_FIELDS, keep=("repo", "ord"),
    )
    ends = [("r", "hub", "a"), ("r", "hub", "b"), ("r", "hub", "gone"), ("q", "hub", "a"), ("r", "gone", "gone"), (None, "hub", "a"), ("r", None, "b")]
    links = schemas.conform(
        spark.createDataFrame([(*e, 1) for e in ends], "repo string, source string, target string, ord long").withColumn("relation", F.lit("calls")),
        schemas.LINK_FIELDS, keep=("repo", "ord"),
    )

    def resolved():
        found = build.resolve_links(links, nodes)
        return _physical(found), sorted((str(r.repo), str(r.source), r.target, str(r.src), str(r.dst), r.status) for r in found.collect())

    plan, want = resolved()
    assert "BroadcastHashJoin" not in plan and len(want) == len(ends)
    monkeypatch.setattr(build, "HOT_ROWS", 2)
    plan, found = resolved()
    assert "BroadcastHashJoin" in plan and found == want


def test_edges_are_folded_and_merged_by_one_shuffle(spark, no_broadcast):
    edge = schemas.conform(spark.createDataFrame([("a", "b", "CALLS", "r")], "src string, dst string, type string, repo string"), schemas.EDGE_FIELDS)
    runs = spark.createDataFrame([("r", "c2", "run2")], "repo string, commit string, run string")
    merged = upkeep.upsert_edges(edge, edge.withColumn("ord", F.lit(1)), runs)
    # One exchange of the stored edges, one of the incoming ones.
    assert _physical(merged).count("Exchange hashpartitioning") == 2
    assert [(r.src, r.last_run) for r in merged.collect()] == [("a", "run2")]


def test_stamps_reach_the_rows_by_broadcast(spark, no_broadcast):
    nodes = schemas.conform(spark.createDataFrame([("r", 1, "a")], "repo string, ord long, id string"), schemas.NODE_FIELDS, keep=("repo", "ord"))
    runs = spark.createDataFrame([("r", "c", "run")], "repo string, commit string, run string")
    stamped = upkeep._stamped(build.to_entities(nodes), runs, "import_repo")
    assert "BroadcastHashJoin" in _physical(stamped) and stamped.first().last_run == "run"


def test_ownership_keeps_old_stamps_of_an_import_without_commit(spark):
    own = spark.createDataFrame(
        [("r", "a", "c1", "r1"), ("r", "gone", "c1", "r1"), ("q", "a", "c1", "r1")], "repo string, node_key string, last_commit string, last_run string"
    )
    incoming = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "new")], "import_repo string, node_key string")

    def after(commit):
        runs = spark.createDataFrame([("r", commit, "r2")], "repo string, commit string, run string")
        return sorted((r.repo, r.node_key, str(r.last_run)) for r in upkeep.upsert_ownership(own, incoming, runs).collect())

    assert after("c2") == [("q", "a", "r1"), ("r", "a", "r2"), ("r", "gone", "r1"), ("r", "new", "r2")]
    assert after("") == [("q", "a", "r1"), ("r", "a", "r1"), ("r", "gone", "r1"), ("r", "new", "None")]


def test_stored_rows_are_read_by_column(spark):
    rows = session.stored(spark.range(3).select("id", F.array(F.lit("x")).alias("tags"), F.lit(None).cast("string").alias("none")))
    assert rows.inputFiles() and sorted(r.id for r in rows.collect()) == [0, 1, 2]
    assert "ReadSchema: struct<id:bigint>" in _physical(rows.select("id"))


def test_a_relevance_search_makes_no_trigrams(spark, monkeypatch):
    made = []
    real = SearchIndex.add_lists
    monkeypatch.setattr(SearchIndex, "add_lists", lambda self, entities, kind: made.append(kind) or real(self, entities, kind))
    t = GraphTables(spark, "/root/testdata/sf0.001")
    written = {}
    monkeypatch.setattr(t, "_once", lambda name, make: written.get(name) or written.setdefault(name, _made(spark, make)))
    assert t.search_index().relevance_search("widget").count() > 0 and made == ["token"]
    assert t.search_index().substring_search("runserver1").count() > 0 and made == ["token", "gram"]


def _made(spark, make) -> str:
    path = f"{session.work_folder(spark)}/made"
    make(path)
    return path


def test_a_scope_leaves_out_edges_to_shared_nodes(spark):
    shared = "platform::pkg::p"
    ends = [("a", "b", "CALLS"), ("c", "b", "CALLS"), ("a", shared, "DEPENDS_ON")]
    edges = schemas.conform(spark.createDataFrame([(*e, "r") for e in ends], "src string, dst string, type string, repo string"), schemas.EDGE_FIELDS)

    def found(owner):
        nodes = spark.createDataFrame([("b", "b", "r"), (shared, "p", owner)], "node_key string, name string, repo string")
        rows = hotspots.hotspots(schemas.conform(nodes, schemas.ENTITY_FIELDS), edges, ["r"])
        return rows._jdf.queryExecution().optimizedPlan().toString(), [(r.name, r.fan_in) for r in rows.collect()]

    plan, rows = found(None)
    assert "RLIKE" in plan and rows == [("b", 2)]
    # A node that looks shared but has a repository is still counted.
    assert found("r")[1] == [("b", 2), ("p", 1)]


def test_calls_are_folded_by_hash(spark):
    assert "SortAggregate" not in _physical(GraphTables(spark, "/root/testdata/sf0.001")._calls())


@pytest.mark.parametrize("name", ["d5_residue_before_sweep", "d5_sweep_counts"])
def test_marks_carry_keys_and_stamps_of_rows_an_import_can_meet(spark, monkeypatch, name):
    """The whole graph is not written twice over to count what a sweep would remove; the counts are those of the whole graph."""
    written, stored = {}, GraphTables._stored

    def recorded(self, table, build, fields, partition=None):
        written[table] = stored(self, table, build, fields, partition)
        return written[table]

    monkeypatch.setattr(GraphTables, "_stored", recorded)
    t = GraphTables(spark, "/root/testdata/sf0.001")
    whole = {"d5_residue_before_sweep": upkeep.residue, "d5_sweep_counts": upkeep.sweep_counts}[name](*graph_queries._second_run(t))
    want = sorted(map(tuple, whole.collect()))
    written.clear()
    got = sorted(map(tuple, getattr(graph_queries, name)(t).collect()))
    assert got == want and any(r[-1] for r in got)
    swept = {f"NATION_{i}" for i in range(10)}
    assert not {"run1_entities", "run2_entities", "run1_edges", "run2_edges"} & set(written)
    assert not {"name", "content_hash"} & set(written["run2_marks_entities"].columns)
    for part in ("entities", "edges", "ownership"):
        assert {r.repo for r in written[f"run2_marks_{part}"].select("repo").distinct().collect()} <= swept | {None}


def test_nodes_of_much_shared_ends_are_picked_before_they_are_folded(spark, no_broadcast, monkeypatch):
    nodes = spark.createDataFrame([("r", k, f"n{k}") for k in range(6)] + [("r", 9, "n0")], "repo string, ord long, id string")
    links = spark.createDataFrame([("r", k, f"n{k}", "n0", "calls") for k in range(1, 6)], "repo string, ord long, source string, target string, relation string")
    plans, cut = [], build.cut_lineage
    monkeypatch.setattr(build, "HOT_ROWS", 3)
    monkeypatch.setattr(build, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    found = build.resolve_links(schemas.conform(links, schemas.LINK_FIELDS, keep=("repo", "ord")), schemas.conform(nodes, schemas.NODE_FIELDS, keep=("repo", "ord")))
    assert [p.index("max_by") < p.index("LeftSemi") for p in plans if "max_by" in p] == [True]
    assert {(r.target, r.status) for r in found.collect()} == {("n0", "ok")} and found.select("dst").distinct().count() == 1


def test_links_of_no_type_do_not_meet_the_keys(spark, no_broadcast):
    nodes = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b")], "repo string, ord long, id string")
    links = spark.createDataFrame([("r", 0, "a", "b", "calls"), ("r", 1, "a", "b", "bogus"), ("r", 2, "a", "gone", "calls")], "repo string, ord long, source string, target string, relation string")
    found = build.to_edges(build.resolve_links(schemas.conform(links, schemas.LINK_FIELDS, keep=("repo", "ord")), schemas.conform(nodes, schemas.NODE_FIELDS, keep=("repo", "ord"))))
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ord, r.type) for r in found.collect()] == [(0, "CALLS")]


@pytest.mark.parametrize("name", ["d3_sweep_nodes", "d5_residue_after_sweep"])
def test_a_sweep_carries_keys_and_stamps_of_rows_an_import_can_meet(spark, monkeypatch, name):
    """Rows of repositories that are not swept stay where the first run wrote them; the result is that of the whole graph."""
    written, stored = {}, GraphTables._stored

    def recorded(self, table, build, fields, partition=None):
        written[table] = stored(self, table, build, fields, partition)
        return written[table]

    monkeypatch.setattr(GraphTables, "_stored", recorded)
    t = GraphTables(spark, "/root/testdata/sf0.001")
    graph, runs = graph_queries._second_run(t)
    whole = upkeep.sweep(graph, runs)
    whole = whole.entities.select("node_key", "repo", "last_run") if name == "d3_sweep_nodes" else upkeep.residue(whole, runs)
    want = sorted(map(str, whole.collect()))
    written.clear()
    assert sorted(map(str, getattr(graph_queries, name)(t).collect())) == want and want
    assert not {"run1_entities", "run2_entities", "run1_edges", "run2_edges"} & set(written)
    swept = {f"NATION_{i}" for i in range(10)}
    for part in ("entities", "edges", "ownership"):
        assert {r.repo for r in written[f"run2_marks_{part}"].select("repo").distinct().collect()} <= swept | {None}


def test_a_swept_part_keeps_shared_nodes_that_the_other_part_holds(spark):
    """A sweep of marked rows alone removes what a sweep of the whole graph removes."""
    def rows(data, columns, fields):
        return schemas.conform(spark.createDataFrame(data, columns), fields)

    held, lone = "platform::pkg::held", "platform::pkg::lone"
    entities = rows([("a", "A", None, "1"), ("b", "B", None, "1"), (held, None, True, "1"), (lone, None, True, "1")], "node_key string, repo string, shared boolean, last_run string", upkeep.MARK_ENTITY_FIELDS)
    edges = rows([("a", held, "X", "A", "1"), ("a", lone, "X", "A", "1"), ("b", held, "X", "B", "1")], "src string, dst string, type string, repo string, last_run string", upkeep.MARK_EDGE_FIELDS)
    own = rows([("A", "a", "1"), ("A", held, "1"), ("A", lone, "1"), ("B", "b", "1"), ("B", held, "1")], "repo string, node_key string, last_run string", schemas.OWNERSHIP_FIELDS)
    runs = spark.createDataFrame([("A", "c2", "2")], "repo string, commit string, run string")
    whole = upkeep.sweep(upkeep.Graph(entities, edges, own), runs)
    mine = [df.where("repo IS NULL OR repo = 'A'") for df in (entities, edges, own)]
    part = upkeep.sweep(upkeep.Graph(*mine), runs, shared_ends(upkeep.unmet(edges, runs)).select("node_key"))
    assert part.entities.columns == list(upkeep.MARK_ENTITY_FIELDS) and part.edges.columns == list(upkeep.MARK_EDGE_FIELDS)
    assert {r.node_key for r in whole.entities.collect()} == {"b", held}
    assert {r.node_key for r in part.entities.collect()} == {held} and part.edges.count() == part.ownership.count() == 0
