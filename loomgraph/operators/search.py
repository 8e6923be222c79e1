"""Entity search: a substring tier (E6), a relevance tier (E7), and both merged.

These functions scan a table of entities; ``search_index`` has the same searches over stored lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import entity_labels, in_scope, normalize_symbol, or_empty

# Free parameters of the BM25 score.
_K1, _B = 1.2, 0.75
_TOKEN = r"([\p{L}\p{N}_.]+)"


def shown(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "node_key", "node_id", "name", entity_labels(F.col("label")).alias("labels"),
        "repo", "path", "line", *extra,
    )


def substring_search(entities: DataFrame, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
    """Case-insensitive substring match, best kind of match first."""
    q = normalize_symbol(text)
    name, norm = F.col("name_lower"), F.col("norm_name_lower")
    rank = (
        F.when(name == q, 0)
        .when(name.startswith(q), 1)
        .when(norm == q, 2)
        .when(norm.startswith(q), 3)
        .otherwise(4)
    )
    hits = entities.where((name.contains(q) | norm.contains(q)) & in_scope(F.col("repo"), repos))
    ranked = hits.withColumn("rank", rank).withColumn("name_length", F.length("name"))
    ordered = ranked.orderBy("rank", "name_length", "name", "node_key")
    return shown(ordered if limit is None else ordered.limit(limit), "rank", "name_length")


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def query_tokens(text: str) -> list[str]:
    """Plain lower-case terms of a search text."""
    import re

    return list(dict.fromkeys(t.lower() for t in re.findall(r"[\w.]+", text)))


def tokens_of() -> Column:
    """Tokens of name, normalised name and path."""
    body = F.concat_ws(
        " ", or_empty(F.col("name")), or_empty(F.col("norm_name")), or_empty(F.col("path"))
    )
    return F.regexp_extract_all(F.lower(body), F.lit(_TOKEN), 1)


def score(text: str, n: Column, avg_len: Column, counts: list[Column]) -> Column:
    """BM25 of the columns tf_0, tf_1 ... (one a query token) and doc_len; an exact name stands before all others."""
    total = F.lit(0.0)
    for i, df in enumerate(counts):
        f = F.col(f"tf_{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = 1 - _B + _B * F.col("doc_len") / avg_len
        total = total + idf * f * (_K1 + 1) / (f + _K1 * norm)
    exact = F.col("name_lower") == normalize_symbol(text)
    return F.round(total + F.when(exact, 1000.0).otherwise(0.0), 6)


def relevance_search(entities: DataFrame, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
    """Any-term token match over name, normalised name and path, BM25 order.

    Document and term statistics are one aggregation over the entity table; only
    entities holding a query term are scored.  The term counts are taken with
    array functions inside the row, so no token table is shuffled.
    """
    terms = query_tokens(text)
    if not terms:
        return shown(entities.where(F.lit(False)).withColumn("score", F.lit(0.0)), "score")
    docs = entities.withColumn("tokens", tokens_of()).withColumn("doc_len", F.size("tokens"))
    tf = [_occurrences(F.col("tokens"), w) for w in terms]
    counted = docs.select("*", *[c.alias(f"tf_{i}") for i, c in enumerate(tf)]).drop("tokens")
    stats = counted.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("doc_len").alias("avg_len"),
            *[F.count(F.when(F.col(f"tf_{i}") > 0, True)).alias(f"df_{i}") for i in range(len(terms))],
        )
    )
    any_term = F.lit(False)
    for i in range(len(terms)):
        any_term = any_term | (F.col(f"tf_{i}") > 0)
    hits = counted.where(any_term & in_scope(F.col("repo"), repos)).withColumn("s", stats.scalar())
    value = score(text, F.col("s.n"), F.col("s.avg_len"), [F.col(f"s.df_{i}") for i in range(len(terms))])
    scored = hits.withColumn("score", value).orderBy(F.desc("score"), "node_key")
    return shown(scored if limit is None else scored.limit(limit), "score")


def search(entities: DataFrame, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
    """Relevance hits first, then substring hits not already listed."""
    return merged(relevance_search(entities, text, repos, limit), substring_search(entities, text, repos, limit), limit)


def merged(relevant: DataFrame, containing: DataFrame, limit: int | None) -> DataFrame:
    """Hits of both tiers, each entity once."""
    first = relevant.select("*", F.lit(0).alias("tier"), (-F.col("score")).alias("k1"), F.lit(0).alias("k2"))
    second = containing.select(
        "*", F.lit(1).alias("tier"), F.col("rank").cast("double").alias("k1"), F.col("name_length").alias("k2")
    )
    both = first.unionByName(second, allowMissingColumns=True)
    once = Window.partitionBy("node_key").orderBy("tier")
    ordered = both.withColumn("_first", F.row_number().over(once)).where("_first = 1").orderBy("tier", "k1", "k2", "name", "node_key")
    return (ordered if limit is None else ordered.limit(limit)).select("node_key", "node_id", "name", "labels", "repo", "path", "line", "tier")
