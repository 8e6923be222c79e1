"""Every stage of the corpus pipeline against its plain version, on a small table."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import mixing, oracles, queries, sharding
from loomgraph.llm.registry import ORACLES as queries_sql
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, corpus, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [t if t is None or len(t.split()) < 20 else " the ".join([t, sentence(rng, 60)]) for t in corpus(rng, 40)] * 2
    texts = [t if t is None else " of the ".join(t.split(" ", 3)) for t in texts]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{rng.randrange(5)}", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = [(1, " ".join(t.split()[5:40])) for t in texts if t and len(t.split()) > 80][:3] + [(2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/stage_{name}")
        out = spark.read.parquet(f"{folder}/stage_{name}")
        if name != "sharding":
            assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        check = globals()[f"check_{name}"]
        check(spark, folder, before, after)
        kept[name], docs = len(after), out
    assert kept["quality_rules"] > kept["jaccard_join"] > kept["decontamination"] > kept["mixing"] > 0
    assert corpus_pipeline.run(spark, folder).count() == kept["sharding"] == kept["mixing"]


def test_empty_tables_and_further_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.withColumn("row", F.lit(1)).withColumn("result", F.lit("x")).withColumn("id", F.lit(2)).withColumn("kept", F.lit(True))
    for rows in (wide, wide.limit(0), docs.unionByName(docs.limit(9))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{len(rows.columns)}{name}{rows.count()}")
            stage(spark, rows, folder).write.parquet(path)
            out = spark.read.parquet(path)
            assert out.columns[: len(rows.columns)] == rows.columns
            rows = out if name != "sharding" else rows
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_small_shards_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, sentence(rng, 400), "en", "s", 1) for i in range(120)] + [(500, sentence(rng, 3000), "en", "s", 1)] * 9 + [(501, "x" * 200_000, "en", "s", 1)] * 2 + [(None, None, None, None, None)] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["small_shards"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(queries_sql["small_shards"])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want
    assert len({r.shard_id for r in got.collect()}) > 10 and any("-1" in r.shard_id for r in got.collect())


def ids(rows):
    return sorted(r.doc_id for r in rows)


def check_quality_rules(spark, folder, before, after):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert ids(after) == sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.QUALITY}) WHERE kept").fetchall())


def check_jaccard_join(spark, folder, before, after):
    number, sets = brute.components([r.text for r in before], 5, 80)
    least = {}
    for r, c in zip(before, number):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert ids(after) == sorted(least.values())


def check_decontamination(spark, folder, before, after):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = {r.doc_id: brute.decontamination(r.text, items) for r in before}
    assert ids(after) == sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))


def check_mixing(spark, folder, before, after):
    tree, tokens, leaf = {}, {}, {}
    for r in before:
        path = (mixing.DOMAINS[int(r.source[3:]) % 4], r.lang or "unknown", r.source)
        tokens[r.doc_id], leaf[r.doc_id] = len(r.text.split()), path
        top = tree.setdefault(path[0], (mixing.WEIGHTS[path[:1]], {}))[1]
        lang = top.setdefault(path[1], (mixing.WEIGHTS.get(("*", path[1]), 1.0), {}))[1]
        lang[path[2]] = (1.0, lang.get(path[2], (1.0, 0))[1] + tokens[r.doc_id])
    budgets = brute.shares(tree, int(sum(tokens.values()) * 0.8))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("e"), F.xxhash64("doc_id", "text")), 1)
    taken, members = set(ids(after)), defaultdict(list)
    for r in before:
        members[leaf[r.doc_id]].append(r)
    for path, own in members.items():
        whole = sum(tokens[r.doc_id] for r in own)
        full = int(budgets[path] + 1e-6) // whole
        rows = spark.createDataFrame([(r.doc_id, r.text, full) for r in own], "doc_id long, text string, e int")
        order = {r.doc_id: r.p for r in rows.select("doc_id", place.alias("p")).collect()}
        want, used = set(order) if full else set(), 0
        for i in sorted(order, key=order.get):
            used += tokens[i]
            if used <= int(budgets[path] + 1e-6) - full * whole:
                want.add(i)
        assert taken & set(order) == want


def check_sharding(spark, folder, before, after):
    assert sum(len(r.text.encode()) for r in before) < sharding.LIMIT
    assert ids(after) == ids(before) and {r.shard_id for r in after} == {"root"}
