"""Mixing sources to target weights by hierarchical budgets.

A token budget flows from the root of a tree (here domain, language, source) to
its leaves.  Siblings share their parent's budget by weight; one that cannot use
its share keeps what it can, and its siblings take the shortage by weight until
it is placed or all are full.  Only what a whole family cannot use goes back to
the family's own siblings, which is why children are filled with the subtree's
capacity known.  A leaf's capacity is its tokens times ``max_epochs``.

A leaf with budget b and T tokens takes ``b // T`` whole epochs, then a prefix of
the next one: rows in the order of a seeded hash of that epoch, as long as their
running token sum stays within the rest.  Rows of equal hash (equal id and text)
are taken together or not at all.

Shares are closed-form water-filling over windows of leaf rows.  Running sums are
taken over hash ranges first and only inside the one range where a leaf's budget
ends row by row, so a leaf with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.rows import packed, unpacked
from loomgraph.session import sized, work_folder

RANGE_BITS = 12
UNKNOWN = "unknown"


def word_count(text: str = "text") -> Column:
    """Words of a text, the tokens of the registered query."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (parent columns, name, capacity, weight, budget of the parent) with their own budget.

    The level L solves sum(min(capacity, L * weight)) = budget; children below
    it are full.
    """
    family = Window.partitionBy(*parent)
    by_level = family.orderBy("level", name)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = children.withColumn("level", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")))
    df = df.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("w0"),
        F.sum("weight").over(whole).alias("w1"),
    )
    full = (F.col("weight") > 0) & (F.col("c0") + F.col("level") * (F.col("w1") - F.col("w0")) <= F.col("budget"))
    df = df.withColumn("full", full)
    df = df.select(
        "*",
        F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole).alias("cf"),
        F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(whole).alias("wf"),
    )
    share = F.col("weight") * (F.col("budget") - F.col("cf")) / (F.col("w1") - F.col("wf"))
    own = F.when(F.col("full"), F.col("capacity").cast("double")).when(F.col("weight") > 0, share).otherwise(0.0)
    return df.select(*parent, name, own.alias("budget"))


def _weight(weights: dict[tuple[str, ...], float], path: list[str]) -> Column:
    """Weight of the node at ``path``: its own entry, else that of its name at this depth, else 1."""
    exact = {k: w for k, w in weights.items() if len(k) == len(path)}
    named = {k[-1]: w for k, w in weights.items() if len(k) == len(path) and all(p == "*" for p in k[:-1])}
    value = F.lit(1.0)
    if named:
        table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        value = F.coalesce(F.element_at(table, F.col(path[-1])).cast("double"), value)
    for key, w in exact.items():
        if "*" not in key:
            value = F.when(F.array(*path) == F.array(*[F.lit(k) for k in key]), F.lit(float(w))).otherwise(value)
    return value


def leaf_budgets(leaves: DataFrame, path: list[str], weights: dict[tuple[str, ...], float], share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (path, tokens) with their ``budget``: ``share`` of all tokens, spread down the tree."""
    capacity = leaves.select(*path, (F.col("tokens") * max_epochs).alias("capacity"))
    total = leaves.agg((F.floor(F.sum("tokens") * F.lit(float(share)))).cast("double").alias("budget"))
    budgets, parents = None, []
    for depth, name in enumerate(path):
        nodes = capacity.groupBy(*path[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(weights, path[: depth + 1]))
        if budgets is None:
            bound = nodes.agg(F.sum("capacity").alias("all")).first()["all"] or 0
            wanted = total.first()["budget"] or 0.0
            nodes = nodes.withColumn("budget", F.lit(float(min(wanted, bound))))
        else:
            nodes = nodes.join(budgets, parents)
        budgets = _filled(nodes, parents, name)
        parents = path[: depth + 1]
    return leaves.join(budgets, path).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    tokens: Column,
    identity: list[str],
    weights: dict[tuple[str, ...], float] | None = None,
    share: float = 0.5,
    max_epochs: int = 1,
    seed: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result`` (levels, tokens, epoch), one row per epoch taken.

    ``levels`` names the tree's levels from the top; a null reads ``unknown``.
    ``weights`` maps a path, or a name under ``*`` for every parent, to its
    weight among its siblings (1 otherwise).  ``share`` of all tokens is the
    budget.  A row of no tokens goes with any prefix that reaches its hash.
    """
    path = list(levels)
    parts = [F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(n) for n, c in levels.items()]
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in identity]).alias("mark")
    folder = work_folder(docs.sparkSession)
    docs.select(*parts, tokens.alias("tokens"), mark).write.parquet(f"{folder}/narrow")
    narrow = docs.sparkSession.read.parquet(f"{folder}/narrow")
    leaves = narrow.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
    leaf_budgets(leaves, path, weights or {}, share, max_epochs).write.parquet(f"{folder}/budgets")
    plan = docs.sparkSession.read.parquet(f"{folder}/budgets")
    plan = plan.select(
        *path,
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    n_leaves = plan.count()

    def order(mark: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epochs", mark), 1)

    keyed = narrow.join(sized(plan, n_leaves), path).withColumn("place", order(F.col("mark")))
    keyed = keyed.withColumn("range", F.shiftright("place", 63 - RANGE_BITS))
    ranges = keyed.groupBy(*path, "range", "rest").agg(F.sum("tokens").alias("t"))
    running = Window.partitionBy(*path).orderBy("range")
    ranges = ranges.withColumn("reach", F.sum("t").over(running))
    edge = ranges.where("reach > rest").groupBy(*path).agg(F.min(F.struct("range", (F.col("reach") - F.col("t")).alias("before"))).alias("edge"))
    inside = keyed.join(sized(edge, n_leaves), path).where("range = edge.range")
    inside = inside.groupBy(*path, "place", "rest", F.col("edge.before").alias("before")).agg(F.sum("tokens").alias("t"))
    inside = inside.withColumn("reach", F.col("before") + F.sum("t").over(Window.partitionBy(*path).orderBy("place")))
    last = inside.where("reach <= rest").groupBy(*path).agg(F.max("place").alias("place"))
    ends = plan.join(edge, path, "left").join(last, path, "left").select(
        *path,
        "epochs",
        F.when(F.col("rest") == 0, -1)
        .otherwise(F.coalesce("place", F.shiftleft(F.col("edge.range").cast("long"), 63 - RANGE_BITS) - 1))
        .alias("last"),
    )
    ends.write.parquet(f"{folder}/ends")
    ends = docs.sparkSession.read.parquet(f"{folder}/ends")

    rows = docs.select(packed(docs, keep), *parts, tokens.alias("tokens"), mark)
    chosen = rows.join(sized(ends, n_leaves), path)
    copies = F.col("epochs") + (order(F.col("mark")) <= F.col("last")).cast("int")
    chosen = chosen.select("row", *path, "tokens", copies.alias("copies")).where("copies > 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return chosen.select("row", F.struct(*path, "tokens", "epoch").alias("result"))


#: Domains stand in for a catalogue of sources: by the number in a source's name.
DOMAINS = ("web", "books", "news", "forum")
WEIGHTS = {
    ("web",): 4.0, ("books",): 3.0, ("news",): 2.0, ("forum",): 1.0,
    ("*", "en"): 4.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 1.0,
}


def document_levels() -> dict[str, Column]:
    """Domain, language and source of a row of ``documents``."""
    number = F.try_to_number(F.nullif(F.regexp_extract("source", r"(\d{1,9})$", 1), F.lit("")), F.lit("999999999"))
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return {"mix_domain": F.get(names, F.pmod(number.cast("int"), F.lit(len(DOMAINS)))), "mix_lang": F.col("lang"), "mix_source": F.col("source")}


def mixed_documents(docs: DataFrame, share: float = 0.5, max_epochs: int = 1, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` chosen by ``WEIGHTS``, one per epoch taken, with the columns of ``docs``."""
    return unpacked(mixed(docs, document_levels(), word_count(), ["doc_id", "text"], WEIGHTS, share, max_epochs, seed))
