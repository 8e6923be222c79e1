"""The search index against the scans of the same entities."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import search, search_index
from loomgraph.operators.search_index import SearchIndex

PARTS = "get set user User order Order Nation_1 nation_3 widget é Straße list map x id".split()


def entity_rows(rng, n):
    for i in range(n):
        name = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4)))
        name = rng.choice([name, name + "()", "." + name + "()", None]) if i % 11 else rng.choice(["", "a", "ab"])
        norm = name.lower().strip("().") if name is not None and i % 7 else None
        yield (f"k{i}", f"id{i}", name, norm, f"src/{rng.choice(PARTS)}/f{i % 9}.go" if i % 5 else None, f"r{i % 4}")


@pytest.fixture(scope="module")
def entities(spark):
    rows = list(entity_rows(random.Random(4), 500))
    df = spark.createDataFrame(rows, "node_key string, node_id string, name string, norm_name string, path string, repo string")
    df = df.withColumn("name_lower", F.lower("name")).withColumn("norm_name_lower", F.lower("norm_name")).withColumn("label", F.lit("Function"))
    return schemas.conform(df, schemas.ENTITY_FIELDS).cache()


@pytest.fixture(scope="module")
def index(entities, tmp_path_factory):
    return SearchIndex.build(entities, str(tmp_path_factory.mktemp("index")))


TEXTS = ["user", "getUser()", "GETUSER", "nation_3 widget", "order order", "straße", "é", "a", "ab", "id", "rde", "none such", "src go", "()", "", "f3.go", "useruser", "usernation_1list"]


@pytest.mark.parametrize("text,repos,limit", [(t, (), 7) for t in TEXTS] + [("user", ("r1", "r3"), 100), ("nation_3 widget", ("r2",), 100)])
def test_indexed_searches_are_the_scans(entities, index, text, repos, limit):
    tiers = [("relevance_search", search.relevance_search), ("substring_search", search.substring_search)]
    for tier, scan in tiers if limit == 7 else [("search", search.search)]:
        want = [r.asDict() for r in scan(entities, text, repos, limit).collect()]
        assert [r.asDict() for r in getattr(index, tier)(text, repos, limit).collect()] == want, (tier, text)


def test_limits_can_be_lifted_and_many_hits_are_joined(entities, index, monkeypatch):
    monkeypatch.setattr(search_index, "MOST_KEYS", 5)
    want = entities.where("contains(name_lower, 'user') or contains(norm_name_lower, 'user')").count()
    assert index.substring_search("user", limit=None).count() == want > 50
    assert index.relevance_search("go", limit=None).count() == search.relevance_search(entities, "go", limit=None).count()


def test_an_empty_index(entities, tmp_path):
    empty = SearchIndex.build(entities.limit(0), str(tmp_path / "empty"))
    assert empty.search("user").count() == 0 and empty.substring_search("a").count() == 0


def test_a_search_reads_the_buckets_of_its_tokens(index):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    shown = plan(index.relevance_search("getUser nation_3 widget"))
    assert "/docs" in shown
    for scan in (plan(index._lists("tokens", "token", ["user"])), shown):
        filters = [part.split("]")[0] for part in scan.split("PartitionFilters: ")[1:]]
        assert filters and all("bucket" in f for f in filters)
    assert "/tokens" not in shown and "/entities" not in shown  # lists were read before; only the hits' buckets are left
