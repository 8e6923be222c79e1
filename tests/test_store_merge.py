import pathlib

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import build, upkeep
from loomgraph.plans import graph_queries, index_run
from loomgraph.plans.index_run import import_run
from loomgraph.plans.projections import _WRITTEN, GraphTables
from loomgraph.session import drop_work_folders, file_names, publish_file, work_folder
from loomgraph.sources import store as stores
from loomgraph.sources.store import CommitConflict, GraphStore, changed_parts, shared_rows
from tests.test_build_upkeep import graph_of, links, nodes, runs


@pytest.fixture
def graph(spark):
    ns = nodes(spark, ("r1", 0, "a", "A"), ("r1", 1, "b", "B"))
    return graph_of(spark, ns, links(spark, ("r1", 0, "a", "b", "calls")), runs(spark, ("r1", "c", "1")))


def parts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "part string")


def test_a_failed_commit_leaves_nothing_behind(spark, tmp_path, graph):
    store = GraphStore(spark, str(tmp_path / "graph"))
    broken = upkeep.Graph(graph.entities, graph.edges, graph.ownership.withColumn("repo", F.raise_error(F.lit("disk full")).cast("string")))
    with pytest.raises(Exception):
        store.commit(broken, parts(spark, "r1"))
    assert store.last() == 0 and store.read().entities.count() == 0
    assert store.commit(graph, parts(spark, "r1")) == 1
    assert sorted(r.node_id for r in store.read().entities.collect()) == ["a", "b"]
    dead = [r.attempt for r in store.dead_attempts().collect()]
    assert len(dead) == 1
    store.drop_attempts(dead)
    assert store.dead_attempts().count() == 0 and store.read().entities.count() == 2


def test_the_slower_of_two_writers_is_refused(spark, tmp_path, graph):
    path = str(tmp_path / "graph")
    one, two = GraphStore(spark, path), GraphStore(spark, path)
    seen = two.last()
    one.commit(graph, parts(spark, "r1"))
    with pytest.raises(CommitConflict):
        two.commit(graph, parts(spark, "r1"), seen)
    assert two.commit(graph, parts(spark, "r1")) == 2
    assert one.read().entities.count() == 2
    live = {r.attempt for r in one.current().collect()}
    with pytest.raises(ValueError):
        one.drop_attempts(list(live))


def test_broken_generations_are_passed_over(spark, tmp_path, graph):
    """A file without content, one that broke off, and one whose attempt is unknown block no later commit."""
    store = GraphStore(spark, str(tmp_path / "graph"))
    folder = tmp_path / "graph" / "generations"
    folder.mkdir(parents=True)
    (folder / f"{1:020d}").write_text("")
    assert store.last() == 0 and store.commit(graph, parts(spark, "r1")) == 2
    (folder / f"{3:020d}").write_text("0123456789abc")
    (folder / f"{4:020d}").write_text("")
    assert store.last() == 2 and store.read().entities.count() == 2
    assert store.commit(graph, parts(spark, "r1")) == 5 and store.last() == 5
    (folder / f"{6:020d}").write_text("0" * 32)  # whole, but its log is missing
    assert store.read().entities.count() == 2
    assert store.commit(graph, parts(spark, "r1")) == 7


def test_one_number_has_one_writer(spark, tmp_path):
    folder = str(tmp_path / "generations")
    assert publish_file(spark, folder, "1", "one") and not publish_file(spark, folder, "1", "two")
    assert (tmp_path / "generations" / "1").read_text() == "one"
    assert file_names(spark, folder) == ["1"] and file_names(spark, folder + "/none") == []


def test_changed_rows_change_their_part(spark, graph):
    same = upkeep.Graph(graph.entities, graph.edges, graph.ownership)
    assert changed_parts(graph, same).count() == 0
    moved = upkeep.Graph(graph.entities.withColumn("name", F.when(F.col("node_id") == "a", "other").otherwise(F.col("name"))), graph.edges, graph.ownership)
    assert [r.part for r in changed_parts(graph, moved).collect()] == ["r1"]


def test_an_import_compares_shared_parts_only(spark, tmp_path, monkeypatch):
    """Parts of the imported repositories are written in any case, so their rows are not hashed to see whether they changed."""
    table = ("sql::sql_table::dbo.a", "dbo.a", "platform", "sql_table")
    ns = nodes(spark, ("r1", 0, "a", "A"), ("r1", 1, *table))
    ls, store, compared = links(spark, ("r1", 0, "a", table[0], "reads_table")), GraphStore(spark, str(tmp_path / "graph")), []
    monkeypatch.setattr(index_run, "changed_parts", lambda *graphs: compared.append(graphs) or changed_parts(*graphs))
    for community in (1, 2):
        import_run(store, ns.withColumn("community", F.lit(community)), ls, runs(spark, ("r1", "c", str(community))))
    assert {r.community for r in store.read().entities.collect()} == {2} and store.read().entities.count() == 2
    assert [sum(rows.count() for rows in (g.entities, g.edges, g.ownership)) for pair in compared for g in pair] == [0, 1, 1, 1]
    moved = shared_rows(upkeep.Graph(*[df.where("repo IS NULL OR repo = 'r1'") for df in (store.read().entities, store.read().edges, store.read().ownership)]))
    assert [r.node_id for r in moved.entities.collect()] == [table[0]] and moved.edges.count() == moved.ownership.count() == 0


def test_a_commit_makes_each_table_once(spark, tmp_path, graph, monkeypatch):
    """Shared ends are those of the edges as written; the edges given are not made again for them."""
    store, read, ends = GraphStore(spark, str(tmp_path / "graph")), [], stores.shared_ends
    monkeypatch.setattr(stores, "shared_ends", lambda edges: read.extend(edges.inputFiles()) or ends(edges))
    store.commit(graph, parts(spark, "r1"))
    assert read and all("/graph/edges/attempt=" in f for f in read)


def test_the_first_graph_is_written_to_the_store_only(spark, monkeypatch):
    written, stored = [], GraphTables._stored
    monkeypatch.setattr(GraphTables, "_stored", lambda self, table, *rest: written.append(table) or stored(self, table, *rest))
    found = graph_queries.a5_store_import(GraphTables(spark, "/root/testdata/sf0.001"))
    assert found.where("last_run = 'r1'").count() and found.where("last_run = 'r2'").count()
    assert "raw_nodes" in written and not any(table.startswith("run") for table in written)


def test_an_import_reads_and_writes_its_parts_only(spark, tmp_path):
    table, view = ("sql::sql_table::dbo.a", "dbo.a", "platform", "sql_table"), ("sql::sql_table::dbo.zz", "dbo.zz", "platform", "sql_table")
    ns = nodes(spark, *[(f"r{i}", 0, "a", f"A{i}") for i in range(6)], ("r1", 1, *table), ("r2", 1, *table), ("r2", 2, *view))
    ls = links(spark, ("r1", 0, "a", table[0], "reads_table"), ("r2", 0, "a", table[0], "reads_table"), ("r2", 1, "a", view[0], "reads_table"))
    store = GraphStore(spark, str(tmp_path / "graph"))
    import_run(store, ns, ls, runs(spark, *[(f"r{i}", "c", "1") for i in range(6)]))
    before = {r.part: r.attempt for r in store.current().collect()}
    own = spark.createDataFrame([("r2",)], "part string")
    plan = store.read(own).edges._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    # r2 drops the view and keeps the table, which r1 reads as well.
    second = ns.where("repo = 'r2' and ord < 2"), ls.where("repo = 'r2' and ord < 1")
    assert [r.status for r in import_run(store, *second, runs(spark, ("r2", "c", "2"))).collect()] == ["success"]
    after = {r.part: r.attempt for r in store.current().collect()}
    changed = {p for p in after if after[p] != before.get(p)}
    assert "r2" in changed and not changed & {"r0", "r1", "r3", "r4", "r5"} and len(changed) <= 3
    names = {r.name for r in store.read().entities.collect()}
    assert "dbo.a" in names and "dbo.zz" not in names
    # Nothing of r2 is left, but r1's edge, which is not read, holds the table.
    import_run(store, ns.limit(0), ls.limit(0), runs(spark, ("r2", "c", "3")))
    assert "dbo.a" in {r.name for r in store.read().entities.collect()}
    import_run(store, ns.where("repo = 'r1' and ord < 1"), ls.limit(0), runs(spark, ("r1", "c", "4")))
    assert "dbo.a" not in {r.name for r in store.read().entities.collect()}


def test_order_of_a_merge_is_numeric_and_graph_rows_stay(spark):
    graph = nodes(spark, ("r", 9, "a", "nine"), ("r", 10, "a", "ten"), ("r", 11, "b", ""))
    frags = nodes(spark, ("r", 10, "b", "late", None, "sql_view"), ("r", 9, "b", "early"), ("r", 2, "a", "x", None, "package"))
    merged = build.merge_nodes(graph, frags.withColumn("extractor", F.lit("x")))
    got = sorted((r.id, r.ord.number, r.label, r.type) for r in merged.collect())
    assert got == [("a", 9, "nine", None), ("a", 10, "ten", "package"), ("b", 11, "early", "sql_view")]
    entities = build.to_entities(merged)
    last = upkeep.upsert_nodes(_empty(spark, schemas.ENTITY_FIELDS), entities, runs(spark, ("r", "c", "1")))
    assert {r.node_id: r.name for r in last.collect() if r.node_id == "b"} == {"b": "early"}


def test_the_last_link_of_a_merge_wins(spark):
    ns = nodes(spark, ("r", 0, "a", "A"), ("r", 1, "b", "B"))
    ls = links(spark, ("r", 9, "a", "b", "calls", 9.0), ("r", 10, "a", "b", "calls", 10.0))
    merged = build.merge_links(ls, ls.limit(0).withColumn("extractor", F.lit("x")))
    edges = build.to_edges(build.resolve_links(merged, ns))
    kept = upkeep.upsert_edges(_empty(spark, schemas.EDGE_FIELDS), edges, runs(spark, ("r", "c", "1")))
    assert [r.weight for r in kept.collect()] == [10.0]


def _empty(spark, fields):
    return spark.createDataFrame([], ", ".join(f"{n} {d.simpleString()}" for n, d in fields.items()))


def test_appended_rows_are_seen(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = GraphTables(spark, str(tmp_path)).entities().count()
    one = spark.read.parquet(f"{source}/customer.parquet").limit(1)
    one.withColumn("c_custkey", (F.col("c_custkey") + 9_000_000).cast(one.schema["c_custkey"].dataType)).write.mode("append").parquet(f"{tmp_path}/customer.parquet")
    assert GraphTables(spark, str(tmp_path)).entities().count() > before


def test_work_tables_can_be_dropped(spark):
    path = work_folder(spark)
    spark.range(3).write.parquet(f"{path}/x")
    assert drop_work_folders(spark) >= 1 and file_names(spark, f"{path}/x") == []
    _WRITTEN.clear()  # so that later tests write their tables again


def test_no_machine_local_folder_is_made():
    root = pathlib.Path(__file__).parent.parent / "loomgraph"
    assert not [p for p in root.rglob("*.py") if "tempfile" in p.read_text()]
