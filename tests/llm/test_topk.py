"""Exact top-k search against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, every=20, factor=64):
    """(query_id, rank, vec_id, score) by scoring every pair."""
    sound = [
        (i, [math.floor(factor * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (query_id, q) in enumerate(sound):
        if query_id is None or query_id % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v)), i is None, i) for b, (i, v) in enumerate(sound) if a != b]
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(query_id, rank, i, -score) for rank, (score, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(rng, n, width, kind):
    if kind == "ties":
        return [[rng.choice([-0.5, 0.0, 0.25]) for _ in range(width)] for _ in range(n)]
    if kind == "negative":
        return [[(-1) ** (i % 3 == 0) * rng.random() for _ in range(width)] for i in range(n)]
    if kind == "uneven":
        return [[rng.gauss(0, 1) for _ in range(rng.randrange(width + 1))] for _ in range(n)]
    return [[rng.gauss(0, 1) * (9 if j < 2 else 1) for j in range(width)] for _ in range(n)]


@pytest.mark.parametrize("kind,sites,depth", [("gauss", 2, None), ("ties", 3, 5), ("negative", 2, 6), ("uneven", 4, 5), ("gauss", 1, 5)])
def test_results_are_those_of_all_products(spark, monkeypatch, kind, sites, depth):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "MOST_LISTS", 3)
    monkeypatch.setattr(topk, "PAIRS", 16)
    rng = random.Random(f"{kind}{sites}")
    rows = list(enumerate(vectors(rng, 300, 7, kind), -20))
    rows += rows[:25] + [(None, rows[3][1]), (40, None), (60, [1.0, None]), (80, [float("nan")] * 7), (100, [float("inf")] * 7), (120, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = plain([(r.vec_id, r.embedding) for r in df.collect()], 5)
    assert got(topk.top_k(df, 5, F.col("vec_id") % 20 == 0, sites=sites, depth=depth)) == want


def test_fewer_vectors_than_asked_for(spark):
    for n in range(4):
        rows = [(20 * i, [float(i), 1.0], 0) for i in range(n)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert got(topk.top_k(df, 5, F.col("vec_id") % 20 == 0)) == plain([r[:2] for r in rows], 5)
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], SCHEMA), 5, F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [], 0), (21, [], 0)], SCHEMA), 5, F.col("vec_id") % 20 == 0).first().score == 0


def test_many_equal_vectors_and_products_beyond_floating_point(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-(1 << 30), 1 << 30) for _ in range(4)]) for i in range(60)] + [(100 + i, [3, 1, 4, 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "no long, rank array<long>").withColumn("query", F.lit("x")).withColumn("id", F.lit(1))
    assert got(topk.top_k(df, 7, F.col("no") % 20 == 0, vec_id="no", vector=F.col("rank"))) == plain(rows, 7, factor=1)


def test_cutoffs_keep_most_entries_at_their_sites(spark, monkeypatch):
    """The second phase sends few of all local scores where lists are long enough to bound the result."""
    rng = random.Random(5)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors(rng, 2000, 16, "plain"))], SCHEMA)
    sent = []
    collected = topk._Search.collected
    monkeypatch.setattr(topk._Search, "collected", lambda *a: sent.append(collected(*a)) or sent[0])
    assert len(got(topk.top_k(df, 10, F.col("vec_id") % 20 == 0))) == 1000
    assert sent[0].agg(F.sum(F.size("numbers"))).first()[0] < 0.25 * 2 * 100 * 2000


def test_query_against_all_products(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, v, 0) for i, v in enumerate(vectors(rng, 150, 64, "plain"))] + [(160, None, None), (None, [0.5] * 64, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()], 20)
    assert got(queries.QUERIES["op13_topk_search"](spark, str(tmp_path))) == want
