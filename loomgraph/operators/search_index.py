"""An index for entity search: token and trigram lists, made with the graph.

Tables below one folder, each partitioned by a hash bucket of its key and sorted by
key inside, so that a lookup reads few folders and few row groups of them:

* ``tokens`` (token, node_key, tf, doc_len, repo, name_lower): where each token of
  name, normalised name and path stands.
* ``grams`` (gram, node_key): the three-character pieces of both lower-case names.
* ``token_terms``, ``gram_terms`` (term, n): the length of every list.
* ``docs``: what a result shows, by node key.
* ``totals`` (n, avg_len, buckets): one row.

A relevance search reads the lists of its tokens; a substring search intersects
the shortest lists of the trigrams of its text and checks the names that remain.
Neither scans the entities: ``docs`` is read for the buckets of the final hits.  A
text of one or two characters has no trigram and scans the names.

Names have many more trigrams than tokens, and a relevance search needs none, so the
lists of either kind can be added when a search first asks for them.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.columns import in_scope, normalize_symbol
from loomgraph.operators import search

#: Entities a bucket, from which the number of buckets follows.
BUCKET_ROWS = 50_000
#: Keys up to which a lookup names its buckets; more are joined.
MOST_KEYS = 1_000
#: Trigram lists that are intersected before names are compared.
MOST_LISTS = 3
GRAM = 3
_TABLES = {
    "tokens": "token string, node_key string, tf int, doc_len int, repo string, name_lower string, bucket int",
    "grams": "gram string, node_key string, bucket int",
    "token_terms": "term string, n long, bucket int",
    "gram_terms": "term string, n long, bucket int",
    "docs": "node_key string, node_id string, name string, label string, repo string, path string, line string, name_lower string, norm_name_lower string, bucket int",
    "totals": "n long, avg_len double, buckets int",
}
_SHOWN = ("node_id", "name", "label", "repo", "path", "line", "name_lower", "norm_name_lower")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key), F.lit(buckets)).cast("int")


def _bucket_of(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode()) % buckets


def _grams(name: Column) -> Column:
    last = F.length(name) - (GRAM - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(name, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _token_rows(entities: DataFrame) -> DataFrame:
    docs = entities.withColumn("all_tokens", search.tokens_of())
    return docs.select(
        "node_key", "repo", "name_lower", F.size("all_tokens").alias("doc_len"),
        F.explode(
            F.transform(F.array_distinct("all_tokens"), lambda t: F.struct(t.alias("token"), F.size(F.filter("all_tokens", lambda x: x == t)).alias("tf")))
        ).alias("t"),
    ).select("t.token", "node_key", "t.tf", "doc_len", "repo", "name_lower")


def _gram_rows(entities: DataFrame) -> DataFrame:
    names = F.array_union(_grams(F.coalesce("name_lower", F.lit(""))), _grams(F.coalesce("norm_name_lower", F.lit(""))))
    return entities.select(F.explode(names).alias("gram"), "node_key")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, ask=None):
        """The index below ``path``; ``ask(kind)`` is called before lists of tokens or grams are read."""
        self.spark, self.path, self._ask = spark, path, ask
        self._totals = None

    # --- building ---

    @classmethod
    def build(cls, entities: DataFrame, path: str, kinds=("token", "gram")) -> SearchIndex:
        """Write the index of ``entities`` below ``path``, with the lists of the given kinds."""
        index = cls(entities.sparkSession, path)
        totals = entities.select(F.size(search.tokens_of()).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_len"))
        totals = totals.withColumn("buckets", F.least(F.greatest(F.floor(F.col("n") / BUCKET_ROWS), F.lit(8)), F.lit(4096)).cast("int"))
        totals.write.mode("overwrite").parquet(f"{path}/totals")
        index._write("docs", entities.select("node_key", *_SHOWN), "node_key")
        for kind in kinds:
            index.add_lists(entities, kind)
        return index

    def add_lists(self, entities: DataFrame, kind: str) -> None:
        """Write the lists of one kind, and their lengths."""
        self._write(f"{kind}s", _token_rows(entities) if kind == "token" else _gram_rows(entities), kind)
        lists = self._read(f"{kind}s").groupBy(F.col(kind).alias("term")).agg(F.count(F.lit(1)).alias("n"))
        self._write(f"{kind}_terms", lists, "term")

    def _write(self, name: str, rows: DataFrame, key: str) -> None:
        """Ranges of (bucket, key, node) split long lists among tasks and leave few files a bucket."""
        order = ["bucket", *dict.fromkeys((key, *(c for c in ("node_key", "kind") if c in rows.columns)))]
        rows = rows.withColumn("bucket", _bucket(F.col(key), self.buckets))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    # --- reading ---

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    @property
    def totals(self):
        if self._totals is None:
            self._totals = self._read("totals").first()
        return self._totals

    @property
    def buckets(self) -> int:
        return self.totals.buckets

    def _lists(self, name: str, key: str, keys: list[str]) -> DataFrame:
        """Rows of a table whose key is one of ``keys``; only their buckets are read."""
        buckets = sorted({_bucket_of(k, self.buckets) for k in keys})
        return self._read(name).where(F.col("bucket").isin(buckets) & F.col(key).isin(keys)).drop("bucket")

    def sizes(self, kind: str, terms: list[str]) -> dict[str, int]:
        """How many entities hold each of the terms."""
        if self._ask is not None:
            self._ask(kind)
        found = self._lists(f"{kind}_terms", "term", terms).select("term", "n").collect()
        return {t: 0 for t in terms} | {r.term: r.n for r in found}

    def _shown(self, hits: DataFrame) -> DataFrame:
        """Hits (node_key and further columns) with what ``docs`` shows of them."""
        few = hits.limit(MOST_KEYS + 1).toArrow()  # one pass over all partitions
        if not few.num_rows:
            return hits.limit(0).join(self._read("docs").drop("bucket"), "node_key")
        if few.num_rows > MOST_KEYS:
            return hits.join(self._read("docs").drop("bucket"), "node_key")
        rows = self.spark.createDataFrame(few, schema=hits.schema)
        return self._lists("docs", "node_key", few.column("node_key").to_pylist()).join(F.broadcast(rows), "node_key")

    # --- searches ---

    def relevance_search(self, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
        """As ``search.relevance_search`` over the indexed entities; no limit with None."""
        terms = search.query_tokens(text) or [""]
        sizes = self.sizes("token", terms)
        found = self._lists("tokens", "token", terms).where(in_scope(F.col("repo"), repos))
        rows = found.groupBy("node_key", "doc_len", "name_lower").agg(*[F.coalesce(F.max(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i, t in enumerate(terms)])
        counts = [F.lit(sizes[t]) for t in terms]
        hits = rows.withColumn("score", search.score(text, F.lit(self.totals.n), F.lit(self.totals.avg_len), counts)).select("node_key", "score")
        best = [F.desc("score"), F.asc("node_key")]
        if limit is not None:
            hits = hits.orderBy(*best).limit(limit)
        return search.shown(self._shown(hits).orderBy(*best), "score")

    def substring_search(self, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
        """As ``search.substring_search`` over the indexed entities; no limit with None."""
        q = normalize_symbol(text)
        grams = list(dict.fromkeys(q[i : i + GRAM] for i in range(len(q) - GRAM + 1)))
        if not grams:
            return search.substring_search(self._read("docs"), text, repos, limit)
        sizes = self.sizes("gram", grams)
        rarest = sorted(grams, key=lambda g: (sizes[g], g))[:MOST_LISTS]
        if sizes[rarest[0]] <= MOST_KEYS:  # few enough to look at by name
            rarest = rarest[:1]
        lists = [self._lists("grams", "gram", [g]).select("node_key") for g in rarest]
        both = reduce(lambda a, b: a.join(b, "node_key", "left_semi"), lists)
        return search.substring_search(self._shown(both), text, repos, limit)

    def search(self, text: str, repos=(), limit: int | None = rules.SEARCH_LIMIT) -> DataFrame:
        """As ``search.search`` over the indexed entities."""
        return search.merged(self.relevance_search(text, repos, limit), self.substring_search(text, repos, limit), limit)
