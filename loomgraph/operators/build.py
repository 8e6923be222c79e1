"""Graph construction: merge fragments, infer labels and keys, resolve links (group B).

Inputs are ``raw_nodes(repo, ord, <node fields>)`` and ``raw_links(repo, ord,
<link fields>)``; ``ord`` is any orderable column.  Groups are folded with
ordered aggregates (``min_by`` / ``max_by``), which combine before the shuffle;
no group is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schemas
from loomgraph.functions import columns as C
from loomgraph.functions import rules
from loomgraph.session import cut_lineage

_TOP_FIELDS = [f for f in schemas.NODE_FIELDS if f not in ("id", "metadata")]
_META_FIELDS = [f.name for f in schemas.METADATA.fields]


def _meaningful(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return col.isNotNull() & (col != "")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.DoubleType)):
        return col.isNotNull() & (col != 0)
    if isinstance(dtype, T.ArrayType):
        return F.size(col) > 0
    if isinstance(dtype, T.StructType):
        return reduce(lambda a, b: a | b, [col[f.name].isNotNull() for f in dtype.fields])
    return col.isNotNull()


def _first(col: Column, dtype: T.DataType, order: Column) -> Column:
    """First meaningful value of a group by ``order``."""
    return F.min_by(col, F.when(_meaningful(col, dtype), order))


# --- fragments -------------------------------------------------------------


def node_defaults(nodes: DataFrame) -> DataFrame:
    """Defaults of a node an extractor emits."""
    return nodes.withColumn(
        "origin", F.when(C.blank(F.col("origin")), F.lit("platform")).otherwise(F.col("origin"))
    ).withColumn(
        "norm_label",
        F.when(C.blank(F.col("norm_label")), F.col("label")).otherwise(F.col("norm_label")),
    )


def dedup_fragment_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id and extractor: earlier values win, gaps fill, metadata per key."""
    rows = node_defaults(nodes)
    order = F.col("ord")
    fields = [
        _first(F.col(f), schemas.NODE_FIELDS[f], order).alias(f) for f in _TOP_FIELDS
    ] + [
        F.min_by(F.col("metadata")[m], F.when(F.col("metadata")[m].isNotNull(), order)).alias(f"m_{m}")
        for m in _META_FIELDS
    ]
    merged = rows.groupBy("repo", "extractor", "id").agg(F.min("ord").alias("ord"), *fields)
    return merged.withColumn(
        "metadata", F.struct(*[F.col(f"m_{m}").alias(m) for m in _META_FIELDS])
    ).select("repo", "extractor", "ord", *schemas.NODE_FIELDS)


def edge_defaults(edges: DataFrame) -> DataFrame:
    """Confidence, score and weight of an edge that omits them."""
    return (
        edges.withColumn("confidence_score", C.default_score(F.col("confidence_score"), F.col("confidence")))
        .withColumn("weight", C.default_weight(F.col("weight")))
        .withColumn("confidence", C.default_confidence(F.col("confidence")))
    )


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that break the fragment schema, with the rule they break."""
    bad_nodes = nodes.select(
        "repo", "extractor",
        F.when(C.blank(F.col("id")), "node: missing id")
        .when(C.blank(F.col("label")), "node: missing label")
        .alias("problem"),
    )
    bad_edges = edges.select(
        "repo", "extractor",
        F.when(C.blank(F.col("source")) | C.blank(F.col("target")), "edge: missing endpoint")
        .when(C.blank(F.col("relation")), "edge: missing relation")
        .when(~C.or_empty(F.col("confidence")).isin(*rules.CONFIDENCE_SCORES), "edge: invalid confidence")
        .alias("problem"),
    )
    return bad_nodes.unionByName(bad_edges).where(F.col("problem").isNotNull())


def without_failed(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """Drop everything an extractor emitted for a repository where it failed."""
    return rows.join(broken.select("repo", "extractor").distinct(), ["repo", "extractor"], "left_anti")


def run_summary(nodes, edges, warnings, broken) -> DataFrame:
    """Per repository and extractor: nodes, edges, warnings, failed (C20)."""
    parts = [
        df.groupBy("repo", "extractor").agg(F.count(F.lit(1)).alias(name))
        for df, name in ((nodes, "nodes"), (edges, "edges"), (warnings, "warnings"), (broken, "errors"))
    ]
    rows = reduce(lambda a, b: a.join(b, ["repo", "extractor"], "full_outer"), parts)
    zero = F.lit(0)
    return rows.select(
        "repo", "extractor",
        *[F.coalesce(n, zero).alias(n) for n in ("nodes", "edges", "warnings", "errors")],
    ).withColumn("failed", F.col("errors") > 0)


def repositories_to_import(nodes: DataFrame, broken: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Fail closed: a repository with a failed extractor is left out (C20)."""
    repos = nodes.select("repo").distinct()
    return repos if allow_partial else repos.join(broken.select("repo").distinct(), "repo", "left_anti")


def _position(rows: DataFrame, tier: int, extractor: Column) -> Column:
    """Place of a row in a merged graph: the graph first, then extractors by name; numbers sort as numbers."""
    number = isinstance(rows.schema["ord"].dataType, T.NumericType)
    return F.struct(
        F.lit(tier).alias("tier"),
        extractor.alias("extractor"),
        (F.col("ord").cast("long") if number else F.lit(None).cast("long")).alias("number"),
        (F.lit(None).cast("string") if number else F.col("ord").cast("string")).alias("key"),
    )


def merge_nodes(graph_nodes: DataFrame, frag_nodes: DataFrame) -> DataFrame:
    """Graph nodes with fragments filling their gaps, new ids appended.

    The graph comes first, then fragments by extractor name and order; metadata
    counts as one field.  Graph rows of one id all stay, and fragments fill the
    last of them.  ``ord`` becomes the struct of ``_position``.
    """
    fields = [f for f in schemas.NODE_FIELDS if f != "id"]
    base = graph_nodes.select("repo", *schemas.NODE_FIELDS, _position(graph_nodes, 0, F.lit("")).alias("ord"))
    rows = frag_nodes.select("repo", *schemas.NODE_FIELDS, _position(frag_nodes, 1, F.col("extractor")).alias("ord"))
    fills = rows.groupBy("repo", "id").agg(
        F.min("ord").alias("ord"),
        *[_first(F.col(f), schemas.NODE_FIELDS[f], F.col("ord")).alias(f) for f in fields],
    )
    last = base.groupBy("repo", "id").agg(F.max("ord").alias("last"))
    gaps = last.join(fills.select("repo", "id", *[F.col(f).alias(f"f_{f}") for f in fields]), ["repo", "id"], "left")

    def filled(f: str) -> Column:
        keep = _meaningful(F.col(f), schemas.NODE_FIELDS[f]) | (F.col("ord") != F.col("last"))
        return F.when(F.coalesce(keep, F.lit(False)), F.col(f)).otherwise(F.coalesce(F.col(f"f_{f}"), F.col(f))).alias(f)

    kept = base.join(gaps, ["repo", "id"]).select("repo", "ord", "id", *[filled(f) for f in fields])
    new = fills.join(last, ["repo", "id"], "left_anti").select("repo", "ord", "id", *fields)
    return kept.unionByName(new).select("repo", "ord", *schemas.NODE_FIELDS)


def merge_links(graph_links: DataFrame, frag_edges: DataFrame) -> DataFrame:
    """Graph links followed by fragment edges, duplicates kept (B5); ``ord`` as in ``merge_nodes``."""
    fields = ["repo", *schemas.LINK_FIELDS]
    return graph_links.select(*fields, _position(graph_links, 0, F.lit("")).alias("ord")).unionByName(
        frag_edges.select(*fields, _position(frag_edges, 1, F.col("extractor")).alias("ord"))
    )


# --- nodes to entities -----------------------------------------------------


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their store key and shared flag."""
    return nodes.withColumn(
        "node_key",
        C.stable_key(
            F.col("repo"), F.col("origin"), F.col("source_file"), F.col("label"), F.col("id")
        ),
    ).withColumn("shared", C.is_shared(F.col("origin"), F.col("id")))


def to_entities(nodes: DataFrame) -> DataFrame:
    """Entity rows of raw nodes (B1, B3, B4, B9–B11); keeps ``import_repo`` and ``ord``."""
    meta = F.col("metadata")
    rows = keyed_nodes(nodes)
    entities = rows.select(
        F.col("repo").alias("import_repo"),
        "ord",
        "node_key",
        F.col("id").alias("node_id"),
        C.or_empty(F.col("label")).alias("name"),
        C.or_empty(F.col("norm_label")).alias("norm_name"),
        C.none_if_empty(F.lower("label")).alias("name_lower"),
        C.none_if_empty(F.lower("norm_label")).alias("norm_name_lower"),
        C.or_empty(F.col("source_file")).alias("path"),
        C.or_empty(F.col("source_location")).alias("line"),
        C.infer_language(meta["language"], F.col("source_file")).alias("language"),
        C.or_empty(F.col("file_type")).alias("file_type"),
        F.coalesce("community", F.lit(0)).alias("community"),
        C.or_empty(F.col("community_name")).alias("community_name"),
        C.none_if_empty(F.col("ecosystem")).alias("ecosystem"),
        F.when(~F.col("shared"), F.col("repo")).alias("repo"),
        F.when(F.col("shared"), True).alias("shared"),
        C.infer_label(F.col("type"), meta["kind"], F.col("source_file"), F.col("label")).alias("label"),
        *[meta[m].alias(m) for m in schemas.PROMOTED_METADATA],
    )
    hashed = [c for c in entities.columns if c not in ("import_repo", "ord", "node_key")]
    return entities.withColumn("content_hash", C.content_hash({c: F.col(c) for c in hashed}))


# --- links to edges --------------------------------------------------------


#: Links that share an end from which on they meet it by broadcast.
HOT_ROWS = 100_000


def _last_keys(named: DataFrame) -> DataFrame:
    """The last node of an id gives the key, as ids are looked up in a map."""
    return named.groupBy("repo", "id").agg(F.max_by("node_key", "ord").alias("node_key"))


def _ended(rows: DataFrame, links: DataFrame, named: DataFrame, keys: DataFrame, end: str, name: str) -> DataFrame:
    """Rows with the key of one end as ``name``, null where unknown.

    A shuffle would bring all links of an end to one task, and a repository's own
    node is an end of most of its links.  Ends that ``HOT_ROWS`` links share are
    few, so their keys are broadcast.
    """
    def known(keys: DataFrame) -> DataFrame:
        return keys.select("repo", F.col("id").alias(end), F.col("node_key").alias(name))

    hot = links.groupBy("repo", end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS)
    hot = cut_lineage(hot.where(F.col("repo").isNotNull() & F.col(end).isNotNull()).select("repo", end))
    if hot.isEmpty():
        return rows.join(known(keys), ["repo", end], "left")
    # The nodes of hot ends are picked before they are folded: the others are not shuffled for them.
    few = named.join(F.broadcast(hot.withColumnRenamed(end, "id")), ["repo", "id"], "left_semi")
    hot = cut_lineage(hot.join(known(_last_keys(few)), ["repo", end], "left").withColumn("_hot", F.lit(True)))
    met = rows.join(F.broadcast(hot), ["repo", end], "left")
    others = met.where(F.col("_hot").isNull()).drop("_hot", name)
    return met.where("_hot").drop("_hot").unionByName(others.join(known(keys), ["repo", end], "left"))


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every link with its edge type and endpoint keys, null where unknown.

    ``status`` is ``unknown``, ``dangling`` or ``ok``; the relation is judged first.
    """
    named = keyed_nodes(nodes).select("repo", "id", "node_key", "ord")
    keys = _last_keys(named.repartition("repo", "id"))
    typed = links.withColumn("edge_type", C.map_relation(F.col("relation")))
    status = (
        F.when(F.col("edge_type").isNull(), "unknown")
        .when(F.col("src").isNull() | F.col("dst").isNull(), "dangling")
        .otherwise("ok")
    )
    sources = _ended(typed, links, named, keys, "source", "src")
    return _ended(sources, links, named, keys, "target", "dst").withColumn("status", status)


def to_edges(resolved: DataFrame) -> DataFrame:
    """Edge rows of resolved links (B11, B12); keeps ``ord``."""
    capped = C.cap_context(F.col("context"))
    # The status said by column, so that links of no type do not meet the keys and the others by inner joins.
    rows = resolved.where("status = 'ok' AND edge_type IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL").select(
        "ord", "src", "dst", F.col("edge_type").alias("type"), "repo", "weight", "confidence",
        "confidence_score", capped.alias("context"),
    )
    values = {c: F.col(c) for c in ("weight", "confidence", "confidence_score", "context")}
    return rows.withColumn("content_hash", C.content_hash(values))


def import_summary(nodes: DataFrame, resolved: DataFrame, hyperedges: DataFrame | None = None) -> DataFrame:
    """Counts of one import per repository."""
    entities = to_entities(nodes)
    totals = entities.groupBy(F.col("import_repo").alias("repo")).agg(F.count(F.lit(1)).alias("nodes_total"))
    labels = (
        entities.groupBy(F.col("import_repo").alias("repo"), "label").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("repo")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    )
    of = lambda s: F.count(F.when(F.col("status") == s, True))
    links = resolved.groupBy("repo").agg(
        F.count(F.lit(1)).alias("links_total"),
        of("ok").alias("links_imported"),
        of("unknown").alias("skipped_unknown"),
        of("dangling").alias("skipped_dangling"),
    )
    relations = (
        resolved.where("status = 'ok'").groupBy("repo", "edge_type").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("repo")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("relation_counts"))
    )
    rows = totals.join(labels, "repo", "left").join(links, "repo", "left").join(relations, "repo", "left")
    if hyperedges is not None:
        rows = rows.join(hyperedges.groupBy("repo").agg(F.count(F.lit(1)).alias("skipped_hyperedges")), "repo", "left")
    else:
        rows = rows.withColumn("skipped_hyperedges", F.lit(0))
    counts = ("links_total", "links_imported", "skipped_unknown", "skipped_dangling", "skipped_hyperedges")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
