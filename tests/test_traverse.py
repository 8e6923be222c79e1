import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.operators import hotspots, lookup, search, traverse


def entities(spark, names, repos=None, norm=None):
    """names: node_key -> name"""
    rows = [(k, n, (norm or {}).get(k, n), (repos or {}).get(k, "r")) for k, n in names.items()]
    df = spark.createDataFrame(rows, "node_key string, name string, norm_name string, repo string")
    df = df.withColumns(
        {
            "name_lower": F.lower("name"), "norm_name_lower": F.lower("norm_name"),
            "label": F.lit("Class"), "path": F.concat(F.lit("p/"), "node_key"), "line": F.lit("L1"),
        }
    )
    return schemas.conform(df, schemas.ENTITY_FIELDS)


def edges(spark, pairs, kind="CALLS"):
    rows = [(a, b, kind, "r", "EXTRACTED") for a, b in pairs]
    df = spark.createDataFrame(rows, "src string, dst string, type string, repo string, confidence string")
    return schemas.conform(df, schemas.EDGE_FIELDS)


def brute_reach(pairs, starts, depth):
    out, frontier = {}, set(starts)
    for d in range(1, depth + 1):
        frontier = {b for a, b in pairs if a in frontier} - set(out)
        out.update({n: d for n in frontier})
    return out


def brute_path(pairs, sources, targets):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    best = None
    for s in sources:
        dist, queue = {s: 0}, deque([s])
        while queue:
            n = queue.popleft()
            for m in near.get(n, ()):
                if m not in dist:
                    dist[m] = dist[n] + 1
                    queue.append(m)
        for t in targets:
            if t != s and t in dist and (best is None or dist[t] < best):
                best = dist[t]
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range(25)]
    names = {k: rnd.choice(["alpha", "beta", "gamma", k]) for k in keys}
    norm = {k: rnd.choice(["alpha", "beta", names[k]]) for k in keys}
    pairs = {(rnd.choice(keys), rnd.choice(keys)) for _ in range(28)}
    ents, links = entities(spark, names, norm=norm), edges(spark, sorted(pairs))

    def match(word):
        return [k for k in keys if word in (names[k], norm[k])]

    got = {r.path[2:]: r.distance for r in traverse.blast_radius(ents, links, "Alpha", 5).collect()}
    assert got == brute_reach(pairs, match("alpha"), 5)
    rows = traverse.shortest_path(ents, links, "alpha", "beta").collect()
    want = brute_path(pairs, match("alpha"), match("beta"))
    assert (len(rows) - 1 if rows else None) == want
    if rows:
        walk = [r.path[2:] for r in rows]
        assert walk[0] in match("alpha") and walk[-1] in match("beta") and walk[0] != walk[-1]
        assert all((a, b) in pairs or (b, a) in pairs for a, b in zip(walk, walk[1:]))


def brute_smallest_path(pairs, sources, targets):
    """Keys of the shortest path that is smallest from its end."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, queue = {s: 0 for s in sources}, deque(sources)
    while queue:
        n = queue.popleft()
        for m in near.get(n, ()):
            if m not in dist:
                dist[m] = dist[n] + 1
                queue.append(m)
    found = [(dist[t], t) for t in targets if t in dist]
    if not found:
        return []
    walk = [min(found)[1]]
    while dist[walk[0]]:
        walk.insert(0, min(m for m in near[walk[0]] if dist.get(m) == dist[walk[0]] - 1))
    return walk


@pytest.mark.parametrize("seed,n,m", [(3, 60, 70), (4, 40, 90), (5, 80, 84), (6, 30, 24)])
def test_the_path_is_the_smallest_of_the_shortest(spark, seed, n, m):
    rnd = random.Random(seed)
    keys = [f"k{i:02}" for i in range(n)]
    names = {k: k for k in keys} | {k: "source" for k in keys[:2]} | {k: "target" for k in keys[-5:]}
    pairs = sorted({(rnd.choice(keys), rnd.choice(keys)) for _ in range(m)})
    rows = traverse.shortest_path(entities(spark, names), edges(spark, pairs), "source", "target").collect()
    assert [r.path[2:] for r in rows] == brute_smallest_path([p for p in pairs if p[0] != p[1]], keys[:2], keys[-5:])
    assert [r.idx for r in rows] == list(range(len(rows)))


def test_a_hub_on_one_side_is_not_opened(spark, monkeypatch):
    """A source next to a hub of many nodes: the search grows from the target's side."""
    grown = []
    real = traverse._grown
    monkeypatch.setattr(traverse, "_grown", lambda steps, frontier, size, seen: grown.append(size) or real(steps, frontier, size, seen))
    pairs = [("s", "hub")] + [("hub", f"n{i}") for i in range(300)] + [(f"n{i}", f"m{i}") for i in range(300)] + [("n7", "x"), ("x", "y"), ("y", "t")]
    names = {k: k for p in pairs for k in p}
    rows = traverse.shortest_path(entities(spark, names), edges(spark, pairs), "s", "t").collect()
    assert [r.name for r in rows] == ["s", "hub", "n7", "x", "y", "t"] and max(grown) < 10
    assert traverse.shortest_path(entities(spark, names), edges(spark, pairs), "s", "t", max_hops=4).count() == 0
    assert traverse.shortest_path(entities(spark, names), edges(spark, pairs), "s", "t", max_hops=5).count() == 6


def test_the_side_of_fewer_steps_grows(spark, monkeypatch):
    """One hub near the target has more steps than many leaves near the source."""
    levels = []
    real = traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: levels.append(real(df)) or levels[-1])
    pairs = [("s", f"a{i}") for i in range(6)] + [("a3", "b"), ("b", "c"), ("c", "hub"), ("hub", "t")] + [("hub", f"n{i}") for i in range(300)]
    names = {k: k for p in pairs for k in p}
    rows = traverse.shortest_path(entities(spark, names), edges(spark, pairs), "s", "t").collect()
    assert [r.name for r in rows] == ["s", "a3", "b", "c", "hub", "t"]
    assert max(level.count() for level in levels) < 10


def test_a_level_meets_the_frontier_before_the_seen_nodes(spark):
    """Seen nodes meet the few steps of a frontier, not all edges."""
    steps = traverse._undirected(edges(spark, [("a", "b"), ("a", "c"), ("x", "y")]))
    nodes = lambda *keys: spark.createDataFrame([(k,) for k in keys], "node_key string")
    found = traverse._grown(steps, nodes("a"), 1, nodes("a", "b", "b"))
    assert [(r.node_key, r.a) for r in found.collect()] == [("c", "a")]
    joins = re.findall(r"Join (\w+)", found._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 2 and joins[-1] == "Inner"


def test_start_on_a_cycle_is_listed_with_its_length(spark):
    ents = entities(spark, {"a": "a", "b": "b", "c": "c"})
    got = {r.name: r.distance for r in traverse.blast_radius(ents, edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), "a").collect()}
    assert got == {"b": 1, "c": 2, "a": 3}


def test_connected_pair_among_ambiguous_names(spark):
    ents = entities(spark, {"s1": "Src", "s2": "Src", "t1": "Dst", "t2": "Dst", "m": "Mid"}, {"s1": "x", "t2": "x"})
    links = edges(spark, [("s2", "m"), ("t1", "m")])
    rows = traverse.shortest_path(ents, links, "src", "Dst()").collect()
    assert [r.name for r in rows] == ["Src", "Mid", "Dst"]
    assert [r.relationship for r in rows] == ["", "CALLS", "CALLS"]
    assert traverse.shortest_path(ents, links, "src", "dst", ["x"]).count() == 0


def test_same_symbol_is_one_node(spark):
    ents = entities(spark, {"a": "Run()", "b": "Run()"})
    rows = traverse.shortest_path(ents, edges(spark, [("a", "b")]), "run", " RUN(x) ").collect()
    assert [(r.name, r.idx) for r in rows] == [("Run()", 0)]


def test_spellings_find_functions_and_receivers(spark):
    ents = entities(spark, {"a": "Load()", "b": ".load()", "c": "Load", "d": "Loader"})
    assert {r.node_key for r in lookup.find_symbol(ents, "load").collect()} == {"a", "b", "c"}
    assert lookup.find_symbol(ents, "").count() == 0


def test_topic_variants_merge_and_missing_topic_is_no_row(spark):
    df = spark.createDataFrame(
        [("t1", "topic::Orders", "Orders", "KafkaTopic"), ("t2", "topic::ORDERS", "ORDERS", "KafkaTopic"),
         ("h1", "repo::a", "a", "Package"), ("h2", "repo::b", "b", "Package"), ("f", "f", "fn", "Function")],
        "node_key string, node_id string, name string, label string",
    ).withColumn("name_lower", F.lower("name"))
    ents = schemas.conform(df, schemas.ENTITY_FIELDS)
    links = edges(spark, [("h1", "t1"), ("f", "t1")], "PRODUCES").unionByName(edges(spark, [("h2", "t2")], "CONSUMES"))
    row = lookup.find_kafka_topic(ents, links, " orders ").first()
    assert (row.topic, row.producers, row.consumers) == ("ORDERS", ["a"], ["b"])
    assert lookup.find_kafka_topic(ents, links, "nope").count() == 0


def test_search_tiers(spark):
    ents = entities(spark, {"a": "OrderService", "b": "PreOrderServiceX", "c": "order-service", "d": "Other"})
    assert [r.node_key for r in search.substring_search(ents, "orderservice").collect()] == ["a", "b"]
    found = search.search(ents, "OrderService").collect()
    assert [r.node_key for r in found] == ["a", "b"] and [r.tier for r in found] == [0, 1]
    assert {r.node_key for r in search.relevance_search(ents, "service").collect()} == {"c"}


def test_hotspots_ignore_self_edges_and_structure(spark):
    ents = entities(spark, {"a": "A", "b": "B"})
    links = edges(spark, [("a", "b"), ("b", "b")]).unionByName(edges(spark, [("b", "a")], "CONTAINS"))
    assert [(r.name, r.fan_in) for r in hotspots.hotspots(ents, links).collect()] == [("B", 1)]
