"""Graph maintenance: upsert, mark-and-sweep, retirement (group D).

All functions take and return plain tables, for any number of repositories at
once.  ``runs(repo, commit, run)`` names the import run of each repository; it is
counted and broadcast.

Keys of nodes that are not shared contain their repository, so an import can
only meet rows of its own repositories and shared ones: other rows pass by
without a shuffle.  A sweep marks once, and edges meet the few removed keys and the
shared nodes as counted broadcasts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import rules
from loomgraph.functions.columns import blank
from loomgraph.session import cut_lineage, sized

_STAMPS = ("last_commit", "last_run")

#: What a sweep is marked by: keys, repository and stamps.
MARK_ENTITY_FIELDS = {f: schemas.ENTITY_FIELDS[f] for f in ("node_key", "repo", "shared", *_STAMPS)}
MARK_EDGE_FIELDS = {f: schemas.EDGE_FIELDS[f] for f in ("src", "dst", "type", "repo", *_STAMPS)}


@dataclass
class Graph:
    """The three tables that change together."""

    entities: DataFrame
    edges: DataFrame
    ownership: DataFrame


def shared_key(key: Column) -> Column:
    """Whether a node key belongs to a shared node; the key itself tells."""
    return key.rlike("^platform::(" + "|".join(rules.SHARED_PREFIXES) + ")")


def _stamped(rows: DataFrame, runs: DataFrame, repo: str) -> DataFrame:
    stamps = runs.select(
        F.col("repo").alias(repo), F.col("commit").alias("last_commit"), F.col("run").alias("last_run")
    )
    # Counted: a shuffle would deal all rows by the few names of their repositories.
    return rows.drop(*_STAMPS).join(_counted(stamps), repo)


def _counted(keys: DataFrame) -> DataFrame:
    """A table written once, marked for broadcast when its size allows."""
    keys = cut_lineage(keys)
    return sized(keys, keys.count())


def _fields(rows: DataFrame, fields: dict) -> DataFrame:
    """Rows with those of the fields that they have."""
    return rows.select(*[c for c in fields if c in rows.columns])


def _parted(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows an import of these repositories can meet (theirs and those of no repository), and all others."""
    names = _counted(runs.select(F.col("repo").alias("_name")).distinct())
    flagged = rows.join(names, F.col("repo") == F.col("_name"), "left")
    theirs = F.col("repo").isNull() | F.col("_name").isNotNull()
    return flagged.where(theirs).drop("_name"), flagged.where(~theirs).drop("_name")


def unmet(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that an import of these repositories cannot meet."""
    return _parted(rows, runs)[1]


def _last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    payload = [c for c in rows.columns if c not in keys]
    # Few rows of a key share a task before the shuffle, so nothing is sorted and combined there.
    picked = rows.repartition(*keys).groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("row")
    )
    return picked.select(*keys, "row.*")


def _merge(current: DataFrame, incoming: DataFrame, on, fields, always, rewrite_all: bool) -> DataFrame:
    """Full outer join of store and import; properties change only with their hash."""
    n = "n_"
    new = incoming.select(*[F.col(c).alias(n + c) for c in incoming.columns])
    joined = current.join(new, on(current, new), "full_outer")
    arrives = F.col(n + "node_key" if n + "node_key" in joined.columns else n + "src").isNotNull()
    exists = F.col("node_key" if "node_key" in current.columns else "src").isNotNull()
    unstamped = blank(F.col(n + "last_commit"))
    rewrite, out = arrives, []
    if not rewrite_all and not {*_STAMPS, *always}.issuperset(fields):
        changed = F.coalesce(F.col("content_hash"), F.lit("")) != F.coalesce(F.col(n + "content_hash"), F.lit(""))
        rewrite = arrives & (~exists | unstamped | changed)
    for c in fields:
        if c in _STAMPS:
            take = arrives & ~unstamped
        elif c in always:
            take = arrives
        else:
            take = rewrite
        out.append(F.when(take, F.col(n + c)).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def _with(others: DataFrame, merged: DataFrame, fields: dict, met_only: bool) -> DataFrame:
    return merged if met_only else merged.unionByName(schemas.conform(others, fields))


def upsert_nodes(
    current: DataFrame, incoming: DataFrame, runs: DataFrame, rewrite_all: bool = False, fields: dict = schemas.ENTITY_FIELDS, met_only: bool = False
) -> DataFrame:
    """Merge entities by key: stamps always, properties when their hash differs.

    ``incoming`` comes from ``build.to_entities``; of several rows with one key
    the one with the highest repository and order wins.  ``fields`` names the columns
    to carry, among them the hash unless ``rewrite_all``; with ``met_only`` the rows that
    the import cannot meet are left to the store they are in.
    """
    rows = _stamped(incoming, runs, "import_repo")
    rows = rows.select("import_repo", "ord", *[c for c in rows.columns if c in fields])
    rows = _last(rows, ["node_key"], ["import_repo", "ord"]).drop("import_repo", "ord")
    rows = schemas.conform(rows, fields)
    mine, others = _parted(current, runs)
    merged = _merge(mine, rows, lambda a, b: a.node_key == b.n_node_key, fields, ("node_key",), rewrite_all)
    return _with(others, merged, fields, met_only)


def upsert_ownership(current: DataFrame, incoming: DataFrame, runs: DataFrame, met_only: bool = False) -> DataFrame:
    """Ownership of every imported node, stamps refreshed (D1); ``met_only`` as in ``upsert_nodes``."""
    rows = incoming.select(F.col("import_repo").alias("repo"), "node_key").distinct()
    rows = _stamped(rows, runs, "repo")
    mine, others = _parted(current, runs)
    new = rows.select("repo", "node_key", *[F.col(c).alias(f"n_{c}") for c in _STAMPS])
    stamped = ~blank(F.col("n_last_commit"))
    merged = mine.join(new, ["repo", "node_key"], "full_outer").select(
        "repo", "node_key", *[F.when(stamped, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in _STAMPS]
    )
    return _with(others, merged, schemas.OWNERSHIP_FIELDS, met_only)


def _edge_scope(src: Column, dst: Column, repo: Column) -> Column:
    """Part of the key that keeps shared-to-shared edges apart per repository; never null, so that one shuffle serves fold and join."""
    name = F.when(shared_key(src) & shared_key(dst) & repo.isNotNull(), F.concat(F.lit("/"), repo))
    return F.coalesce(name, F.lit(""))


def upsert_edges(
    current: DataFrame, incoming: DataFrame, runs: DataFrame, rewrite_all: bool = False, fields: dict = schemas.EDGE_FIELDS, met_only: bool = False
) -> DataFrame:
    """Merge edges by (source, type, target), per repository between shared ends (D2); ``fields`` and ``met_only`` as in ``upsert_nodes``."""
    rows = _stamped(incoming, runs, "repo")
    rows = rows.withColumn("scope", _edge_scope(F.col("src"), F.col("dst"), F.col("repo")))
    rows = rows.select("scope", F.col("repo").alias("import_repo"), "ord", *[c for c in rows.columns if c in fields])
    rows = _last(rows, ["src", "dst", "type", "scope"], ["import_repo", "ord"]).drop("import_repo", "ord")
    rows = schemas.conform(rows, fields, keep=("scope",))
    mine, others = _parted(current, runs)
    have = mine.withColumn("scope", _edge_scope(F.col("src"), F.col("dst"), F.col("repo")))

    def same(a, b):
        return (
            (a["src"] == b["n_src"]) & (a["dst"] == b["n_dst"]) & (a["type"] == b["n_type"])
            & (a["scope"] == b["n_scope"])
        )

    merged = _merge(have, rows, same, fields, ("src", "dst", "type", "repo"), rewrite_all)
    return _with(others, merged, fields, met_only)


# --- sweep -----------------------------------------------------------------


def check_runs(runs: DataFrame) -> None:
    """Refuse a sweep without commit or run: it would delete everything."""
    bad = runs.where(blank(F.col("repo")) | blank(F.col("commit")) | blank(F.col("run")))
    if not bad.isEmpty():
        raise ValueError("sweep refused: a repository has no name, commit or run")


def _mark(rows: DataFrame, runs: DataFrame, repo: Column) -> DataFrame:
    """Adds ``stale``: stamped by a swept repository, but not by its run."""
    swept = runs.select(F.col("repo").alias("_r"), F.col("run").alias("_run"))
    joined = rows.withColumn("_repo", repo).join(swept, F.col("_repo") == F.col("_r"), "left")
    stale = F.col("_r").isNotNull() & ~F.col("last_run").eqNullSafe(F.col("_run"))
    return joined.withColumn("stale", stale).drop("_repo", "_r", "_run")


def _marked(graph: Graph, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = _counted(runs.select("repo", "run"))
    entities = _mark(graph.entities, runs, F.col("repo")).withColumn(
        "stale", F.col("stale") & ~F.coalesce("shared", F.lit(False))
    )
    # Edges without a stamp belong to the repository of their source.
    unstamped = graph.edges.where(F.col("repo").isNull())
    edges = _mark(graph.edges.where(F.col("repo").isNotNull()), runs, F.col("repo"))
    if not unstamped.isEmpty():
        owner = graph.entities.select(F.col("node_key").alias("src"), F.col("repo").alias("_owner"))
        edges = edges.unionByName(_mark(unstamped.join(owner, "src", "left"), runs, F.col("_owner")).drop("_owner"))
    ownership = _mark(graph.ownership, runs, F.col("repo"))
    return entities, edges, ownership


def sweep_counts(graph: Graph, runs: DataFrame) -> DataFrame:
    """What a sweep removes, per kind; all zero after one."""
    entities, edges, ownership = _marked(graph, runs)
    kinds = [
        df.where("stale").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind, df in (("nodes", entities), ("edges", edges), ("ownership", ownership))
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def residue(graph: Graph, runs: DataFrame) -> DataFrame:
    """Stale nodes and relations left per swept repository."""
    entities, edges, ownership = _marked(graph, runs)
    nodes = entities.where("stale").groupBy("repo").agg(F.count(F.lit(1)).alias("residue_nodes"))
    rels = (
        edges.where("stale").select("repo").unionByName(ownership.where("stale").select("repo"))
        .groupBy("repo").agg(F.count(F.lit(1)).alias("residue_rels"))
    )
    zero = F.lit(0)
    return runs.select("repo").join(nodes, "repo", "left").join(rels, "repo", "left").select(
        "repo", F.coalesce("residue_nodes", zero).alias("residue_nodes"),
        F.coalesce("residue_rels", zero).alias("residue_rels"),
    )


def _without_ends(rows: DataFrame, end: str, keys: DataFrame, own: bool) -> DataFrame:
    """Rows whose ``end`` is not among ``keys``; with ``own``, no key is a shared node's.

    Shared ends then pass by: hubs have most of the edges, and a shuffle would bring all of a hub to one task.
    """
    meets = keys.withColumnRenamed("node_key", end)
    if not own:
        return rows.join(meets, end, "left_anti")
    shared = F.coalesce(shared_key(F.col(end)), F.lit(False))
    return rows.where(shared).unionByName(rows.where(~shared).join(meets, end, "left_anti"))


def _detach(graph: Graph, removed: DataFrame) -> Graph:
    """Remove nodes with all their edges; ``removed(node_key)`` is counted and broadcast where few."""
    keys = removed.select("node_key")
    own = keys.where(shared_key(F.col("node_key"))).isEmpty()
    edges = _without_ends(_without_ends(graph.edges, "src", keys, own), "dst", keys, own)
    return Graph(
        _fields(_without_ends(graph.entities, "node_key", keys, own), schemas.ENTITY_FIELDS),
        _fields(edges, schemas.EDGE_FIELDS),
        _fields(_without_ends(graph.ownership, "node_key", keys, own), schemas.OWNERSHIP_FIELDS),
    )


def touched_shared(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Shared nodes (node_key) that are an end of some edge; each end is taken once, so a hub's edges meet in no task."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_key")).distinct()
    return ends.join(shared.select("node_key"), "node_key", "left_semi")


def orphans(graph: Graph) -> DataFrame:
    """Shared nodes without an edge; ownership does not count."""
    shared = _counted(graph.entities.where(F.coalesce("shared", F.lit(False))).select("node_key"))
    return shared.join(touched_shared(graph.edges, shared), "node_key", "left_anti")


def reap_orphans(graph: Graph, held: DataFrame | None = None) -> Graph:
    """Remove orphaned shared nodes but those ``held`` (node_key) by edges that are not in ``graph``."""
    lone = orphans(graph) if held is None else orphans(graph).join(held.select("node_key"), "node_key", "left_anti")
    gone = _counted(lone)
    # No edge has such an end.
    return Graph(
        _fields(graph.entities.join(gone, "node_key", "left_anti"), schemas.ENTITY_FIELDS),
        graph.edges,
        _fields(graph.ownership.join(gone, "node_key", "left_anti"), schemas.OWNERSHIP_FIELDS),
    )


def sweep(graph: Graph, runs: DataFrame, held: DataFrame | None = None) -> Graph:
    """Remove what the runs did not write, then orphans if anything went (D3).

    ``graph`` may be a part of a store: the swept repositories' rows and all
    shared ones.  ``held`` names shared nodes that the edges of the other part touch.
    Of its columns, those that tell what is stale are enough.
    """
    check_runs(runs)
    entities, edges, ownership = _marked(graph, runs)
    kept = Graph(
        _fields(entities, schemas.ENTITY_FIELDS),
        _fields(edges.where("NOT stale"), schemas.EDGE_FIELDS),
        _fields(ownership.where("NOT stale"), schemas.OWNERSHIP_FIELDS),
    )
    # The removed keys are few next to the graph; written once, they feed every anti-join.
    gone = _counted(entities.where("stale").select("node_key"))
    swept = _detach(kept, gone)
    untouched = (
        gone.isEmpty() and edges.where("stale").isEmpty() and ownership.where("stale").isEmpty()
    )
    return swept if untouched else reap_orphans(swept, held)


def owned_counts(graph: Graph) -> DataFrame:
    """Distinct owned entities per repository."""
    return graph.ownership.groupBy("repo").agg(F.count_distinct("node_key").alias("nodes_in_graph"))


def mismatches(summary: DataFrame, graph: Graph) -> DataFrame:
    """Import size against the store."""
    return summary.select("repo", "nodes_total").join(owned_counts(graph), "repo", "left").withColumn(
        "nodes_in_graph", F.coalesce("nodes_in_graph", F.lit(0))
    ).withColumn("mismatch", F.col("nodes_total") != F.col("nodes_in_graph"))


def delete_repositories(graph: Graph, repositories: DataFrame, names: list[str]) -> tuple[Graph, DataFrame]:
    """Remove repositories with all they own, then orphans."""
    if not names or any(not n for n in names):
        raise ValueError("delete refused: empty repository name")
    gone = F.col("repo").isin(*names)
    kept = Graph(
        graph.entities,
        graph.edges.where(F.col("repo").isNull() | ~gone),
        graph.ownership.where(~gone),
    )
    kept = _detach(kept, _counted(graph.entities.where(gone).select("node_key")))
    return reap_orphans(kept), repositories.where(~F.col("name").isin(*names))
