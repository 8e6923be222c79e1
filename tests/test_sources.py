import json
import random

from loomgraph import schemas
from loomgraph.sources import graph_files
from loomgraph.sources.files import load_files
from loomgraph.sources.graph_files import load_graph_documents


def test_files_of_checkouts(spark, tmp_path):
    (tmp_path / "r1" / "src").mkdir(parents=True)
    (tmp_path / "r1" / "src" / "a.go").write_text("package é\n")
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "b.py").write_text("x" * 50)
    rows = {(r.repo, r.path): r.content for r in load_files(spark, str(tmp_path), 20).collect()}
    assert rows == {("r1", "src/a.go"): "package é\n"}


def test_graph_documents(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    doc = {
        "directed": False,
        "nodes": [{"id": "a", "label": "A", "_origin": "platform", "metadata": {"tags": ["x"], "other": 1}}, {"id": "b"}],
        "links": [{"source": "a", "target": "b", "relation": "calls", "weight": 2}],
        "hyperedges": ["h"],
    }
    (tmp_path / "r1" / "graph.json").write_text(json.dumps(doc, indent=1))
    nodes, links, hyperedges = load_graph_documents(spark, str(tmp_path / "r1" / "graph.json"))
    got = nodes.orderBy("ord").collect()
    assert [(r.repo, r.ord, r.id, r.origin) for r in got] == [("r1", 0, "a", "platform"), ("r1", 1, "b", None)]
    assert got[0].metadata.tags == ["x"]
    assert [(r.source, r.target, r.weight) for r in links.collect()] == [("a", "b", 2.0)]
    assert hyperedges.count() == 1


def graph_document(rng, n):
    """A node-link document whose strings hold braces, brackets, quotes, escapes and line breaks."""
    odd = ["plain", "a}b{c", 'say "x"', "back\\slash\\", '{"id": "no"}', "],\"links\": [", "é\n}", "", "\\\"}"]
    nodes = [{"id": f"n{i}", "label": rng.choice(odd), "metadata": {"version": rng.choice(odd), "tags": [rng.choice(odd)]} if i % 3 else None} for i in range(n)]
    links = [{"source": f"n{rng.randrange(n)}", "target": f"n{rng.randrange(n)}", "relation": rng.choice(odd), "weight": float(i)} for i in range(n)]
    doc = {"directed": False, "note": 'a "{" here', "graph": {"name": "}{"}, "nodes": nodes, "links": links, "hyperedges": ["h1", "h}2"]}
    keys = list(doc)
    rng.shuffle(keys)
    return {k: doc[k] for k in keys}


def test_documents_are_read_in_ranges_of_bytes(spark, tmp_path):
    rng, docs = random.Random(3), {}
    for k in range(8):
        docs[f"r{k}"] = graph_document(rng, rng.choice([1, 5, 60]))
        (tmp_path / f"r{k}").mkdir()
        indent = rng.choice([None, None, 1, 2])
        (tmp_path / f"r{k}" / "graph.json").write_text(json.dumps(docs[f"r{k}"], indent=indent, ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"]), encoding="utf-8")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "graph.json").write_text('{"nodes": [], "links": [], "hyperedges": []}')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("200b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            cuts = graph_files._cuts(spark, f"{tmp_path}/*/graph.json")
            assert size == "128m" or cuts.select("file", "block").distinct().count() > 60
            nodes, links, hyperedges = load_graph_documents(spark, f"{tmp_path}/*/graph.json")
            got = {(r.repo, r.ord): (r.id, r.label, r.metadata.version if r.metadata else None) for r in nodes.collect()}
            assert got == {(k, i): (n["id"], n["label"], n["metadata"]["version"] if n["metadata"] else None) for k, d in docs.items() for i, n in enumerate(d["nodes"])}
            got = {(r.repo, r.ord): (r.source, r.target, r.relation, r.weight) for r in links.collect()}
            assert got == {(k, i): tuple(x.values()) for k, d in docs.items() for i, x in enumerate(d["links"])}
            assert hyperedges.where("repo = 'r0'").count() <= 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_the_text_of_documents_is_stored_once(spark, tmp_path, monkeypatch):
    """Cuts are neither written nor shuffled: only whole objects are, wherever batches and ranges end."""
    rng, docs, kept, cut = random.Random(5), {}, [], graph_files.cut_lineage
    monkeypatch.setattr(graph_files, "cut_lineage", lambda df: kept.append(df.columns) or cut(df))
    for k in range(3):
        docs[f"r{k}"] = graph_document(rng, 40)
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "graph.json").write_text(json.dumps(docs[f"r{k}"]))
    settings = {"spark.sql.files.openCostInBytes": "1b", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    old = {k: spark.conf.get(k) for k in (*settings, "spark.sql.files.maxPartitionBytes")}
    try:
        for size in ("300b", "128m"):
            for k, v in (settings | {"spark.sql.files.maxPartitionBytes": size}).items():
                spark.conf.set(k, v)
            nodes, links, _ = load_graph_documents(spark, f"{tmp_path}/*/graph.json")
            assert {(r.repo, r.ord): (r.id, r.label) for r in nodes.collect()} == {(k, i): (n["id"], n["label"]) for k, d in docs.items() for i, n in enumerate(d["nodes"])}
            assert {(r.repo, r.ord): r.relation for r in links.collect()} == {(k, i): x["relation"] for k, d in docs.items() for i, x in enumerate(d["links"])}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept and not any("value" in columns for columns in kept)


def test_a_written_document_is_one_file(spark, tmp_path):
    nodes = spark.range(6000).selectExpr("concat('r', id % 7) AS repo", "id DIV 70 AS ord", "concat('n', id) AS id", "repeat(uuid(), 20) AS label")
    links = nodes.where("ord > 0").selectExpr("repo", "ord", "id AS source", "'n0' AS target", "'calls' AS relation")
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "20k"}
    old = {k: spark.conf.get(k) for k in sizes}
    try:
        # Parts of unlike sizes get unlike numbers of partitions.
        for k, v in sizes.items():
            spark.conf.set(k, v)
        graph_files.write_graph_documents(
            schemas.conform(nodes, schemas.NODE_FIELDS, keep=("repo", "ord")), schemas.conform(links, schemas.LINK_FIELDS, keep=("repo", "ord")), str(tmp_path / "docs")
        )
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = sorted(tmp_path.glob("docs/repo=*/part-*"))
    assert [f.parent.name for f in files] == [f"repo=r{k}" for k in range(7)]
    for k, file in enumerate(files):
        doc = json.loads(file.read_text())
        ids = [int(n["id"][1:]) for n in doc["nodes"]]
        assert sorted(ids) == list(range(k, 6000, 7)) and [i // 70 for i in ids] == sorted(i // 70 for i in ids)
        assert sorted(int(x["source"][1:]) for x in doc["links"]) == [i for i in range(k, 6000, 7) if i >= 70]


def test_records_are_written_compressed(spark, tmp_path):
    nodes = schemas.conform(spark.range(50).selectExpr("concat('r', id % 2) AS repo", "id AS ord", "concat('n', id) AS id", "'é\\n\"' AS label"), schemas.NODE_FIELDS, keep=("repo", "ord"))
    links = schemas.conform(spark.range(7).selectExpr("'r0' AS repo", "id AS ord", "'n0' AS source", "concat('n', id) AS target", "0.5D AS weight"), schemas.LINK_FIELDS, keep=("repo", "ord"))
    graph_files.write_graph_records(nodes, links, str(tmp_path / "g"), file_rows=10)
    written = [f for f in tmp_path.glob("g/*/repo=*/part-*")]
    assert len(written) >= 7 and all(f.name.endswith(".json.gz") for f in written)
    for rows, want in zip(graph_files.load_graph_records(spark, str(tmp_path / "g")), (nodes, links)):
        assert sorted(map(str, rows.select(*want.columns).collect())) == sorted(map(str, want.collect()))
