"""Exact top-k search by inner product: the three-phase uniform threshold method.

The components of all vectors are dealt to ``sites``; a site knows its own
components only, so its local score of a query and a vector is a part of the inner
product, and the score is the sum of the sites' parts.

1.  **Gather.**  Each site lists its best ``depth`` local scores of every query.  The
    vectors listed anywhere are scored exactly, and the k-th best score of a query
    is its first bound: at least k vectors reach it.
2.  **Broadcast a safe cutoff, collect.**  A vector that reaches the bound has at one site
    at least a ``1 / sites`` part of it, and at that site also no less than the bound
    minus the best local scores of the other sites.  This cutoff goes to every
    site with the query; each sends all entries that reach it.  Entries of a vector are
    summed.  A site that did not send it adds less than its cutoff, which bounds the score
    from above; those that all sites sent are exact, and the k-th best of these may
    raise the bound.
3.  **Resolve.**  Vectors whose upper bound reaches the bound are scored exactly; the
    best k of a query are the result.

Queries and vectors are dealt to blocks of bounded size by their row numbers, never
by content, and a block of queries meets a block of vectors in one task as a matrix
product.  Nothing passes through the driver but three counts; the cutoffs travel with
their queries through the shuffle.  Entry lists are packed, one row a query, site and block.

A vector is null, or holds null or non-finite components: the row takes no part.
Shorter vectors count as padded with zeros.  Rows that repeat an id stand for
themselves: each query row has its own result, without itself but with its twins.  Ties go to
the smaller id, null ids as the largest.  With k vectors or fewer besides the query, all
are returned.  Scores have to fit 64 bits.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

SITES = 2
QUERY_BLOCK = 1024
ROW_BLOCK = 2048
#: Groups of row blocks: in the first phase a query and site have at most so many lists.
MOST_LISTS = 32
#: Pairs that a task scores at once.
PAIRS = 1 << 15
LOWEST = -(1 << 62)
_LAST_ID = (1 << 63) - 1


def scaled(vector: str, factor: int = 64) -> Column:
    """Components times ``factor``, rounded down; null unless all are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


def _block(number: Column, blocks: int) -> Column:
    """Row numbers dealt in turn: the number within the partition plus the partition's."""
    return F.pmod(number.bitwiseAND((1 << 33) - 1) + F.shiftright(number, 33) * 7919, F.lit(blocks)).cast("int")


def _blocks_of(numbers: np.ndarray, blocks: int) -> np.ndarray:
    """The same for an array."""
    return ((numbers & (1 << 33) - 1) + (numbers >> 33) * 7919) % blocks


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows, exactly: through floating point where every partial sum fits it."""
    most = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` highest scores of each group, ties to the smaller ``tie``, ordered by group and place."""
    order = np.lexsort((tie, -score, group))
    ordered = group[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
    return order[place < n]


def _lists(values: np.ndarray, owner: np.ndarray, owners: int) -> pa.ListArray:
    """One list for each of ``owners``; ``owner`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(owners + 1)), pa.int32()), pa.array(values, pa.int64()))


def _spread(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and which list each is of."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut wherever one of the first ``keys`` columns changes."""
    for batch in batches:
        changed = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ordered by their first column, cut anew so that rows of one value are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        head = int(np.searchsorted(values, values[-1]))  # where the last value begins
        if held and (head or held[0].column(0)[0].as_py() != values[0]):
            yield pa.concat_batches([*held, batch.slice(0, head)])
            held = []
        elif head:
            yield batch.slice(0, head)
        held.append(batch.slice(head))
    if held:
        yield pa.concat_batches(held)


class _Search:
    """The tables of one search, and the passes over their blocks."""

    def __init__(self, rows: DataFrame, k: int, sites: int, depth: int):
        """``rows``: id, query (boolean), vector (array of long, null where the row takes no part)."""
        usable = cut_lineage(rows.where("vector IS NOT NULL"))
        n, queries, width = usable.agg(F.count(F.lit(1)), F.count_if("query"), F.max(F.size("vector"))).first()
        self.k, self.depth, self.width = k, depth, width or 0
        self.sites = max(1, min(sites, self.width))
        self.query_blocks, self.row_blocks = -(-queries // QUERY_BLOCK) or 1, -(-n // ROW_BLOCK) or 1
        self.lists = min(self.row_blocks, MOST_LISTS)
        padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("vector")))
        rows = usable.select(F.monotonically_increasing_id().alias("no"), "id", "query", padded.alias("vector"))
        self.rows = rows.select("no", F.coalesce("id", F.lit(_LAST_ID)).alias("id"), "vector", _block(F.col("no"), self.row_blocks).alias("rb"))
        self.queries = rows.where("query").select("no", "id", "vector", F.pmod(F.xxhash64("no"), F.lit(self.query_blocks)).cast("int").alias("qb"))

    def _site(self, site: int) -> tuple[int, int]:
        return site * self.width // self.sites, (site + 1) * self.width // self.sites

    def _dealt(self, frames: list[DataFrame], cells: int, order: list[str]) -> DataFrame:
        """The union of frames with a column cell, those of one cell in one task and in order."""
        spark = self.rows.sparkSession
        tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return reduce(DataFrame.unionByName, frames).repartition(min(cells, tasks), "cell").sortWithinPartitions("cell", *order)

    def _local(self, queries: DataFrame) -> DataFrame:
        """Queries and vectors of every cell (site, block of queries, group of row blocks): its components, queries first.

        ``queries`` has a column cutoffs, a cutoff for each site, or null.
        """
        frames, width = [], self.lists
        for site in range(self.sites):
            lo, hi = self._site(site)
            part = F.slice("vector", lo + 1, hi - lo).alias("vector")
            cell = F.lit(site) * self.query_blocks
            group = F.explode(F.expr(f"sequence(0, {width - 1})")).alias("group")
            each = queries.select("no", "qb", part, F.get("cutoffs", F.lit(site)).alias("cutoff"), group)
            frames.append(each.select(((cell + F.col("qb")) * width + F.col("group")).cast("long").alias("cell"), F.lit(0).alias("rb"), "no", "vector", "cutoff"))
            each = self.rows.select("no", "rb", part, F.explode(F.expr(f"sequence(0, {self.query_blocks - 1})")).alias("qb"))
            place = F.pmod("rb", F.lit(width))
            frames.append(
                each.select(((cell + F.col("qb")) * width + place).cast("long").alias("cell"), (F.col("rb") + 1).alias("rb"), "no", "vector", F.lit(None).cast("long").alias("cutoff"))
            )
        return self._dealt(frames, self.sites * self.query_blocks * width, ["rb", "no"]).select("cell", "rb", "no", "vector", "cutoff")

    def listed(self) -> DataFrame:
        """Phase 1: (query, site, numbers, scores), the best local scores of each cell."""
        depth, cells = self.depth, self.query_blocks * self.lists

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def closed() -> Iterator[pa.RecordBatch]:
                if cell is not None and queries and len(best[0]):
                    names = np.concatenate(numbers)
                    sites = np.full(len(names), cell // cells)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names), pa.array(sites, pa.int32()), _lists(best[1], best[0], len(names)), _lists(best[2], best[0], len(names))], ["query", "site", "numbers", "scores"]
                    )

            cell, queries, numbers, best = None, [], [], [np.zeros(0, dtype=np.int64)] * 3
            for part in _runs(batches, 2):
                at = part.column(0)[0].as_py()
                if at != cell:
                    yield from closed()
                    cell, queries, numbers, best = at, [], [], [np.zeros(0, dtype=np.int64)] * 3
                number, vectors = part.column(2).to_numpy(), _matrix(part.column(3))
                if part.column(1)[0].as_py() == 0:
                    queries.append(vectors)
                    numbers.append(number)
                elif queries:
                    scores = _product(np.concatenate(queries), vectors)
                    own = np.concatenate(numbers)[:, None] == number[None, :]
                    if len(best[0]):  # only what is better than a full list's last can come in
                        last = np.full(len(scores), LOWEST)
                        full = np.bincount(best[0], minlength=len(scores)) >= depth
                        np.minimum.at(low := np.full(len(scores), _LAST_ID), best[0], best[2])
                        last[full] = low[full]
                        q, r = np.nonzero((scores > last[:, None]) & ~own)
                    elif len(number) > depth + 1:
                        scores[own] = LOWEST
                        r = np.argpartition(scores, -depth, axis=1)[:, -depth:].ravel()
                        q = np.repeat(np.arange(len(scores)), depth)
                    else:
                        q, r = np.nonzero(~own)
                    joined = [np.concatenate(x) for x in zip(best, (q, number[r], scores[q, r]))]
                    top = _best(joined[0], joined[2], joined[1], depth)
                    best = [x[top] for x in joined]
            yield from closed()

        queries = self.queries.withColumn("cutoffs", F.lit(None).cast("array<long>"))
        return self._local(queries).mapInArrow(run, "query long, site int, numbers array<long>, scores array<long>")

    def gathered(self, lists: DataFrame) -> DataFrame:
        """(query, rb, numbers, tops): the vectors that sites list for a query, by row block, and the sites' best scores."""
        depth, sites, blocks = self.depth, self.sites, self.row_blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _whole(batches):
                names, query = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                number, row = _spread(batch.column(2))
                score, _ = _spread(batch.column(3))
                group = query[row] * sites + batch.column(1).to_numpy()[row]
                top = _best(group, score, number, depth)
                heads = top[np.append(True, group[top][1:] != group[top][:-1])] if len(top) else top
                tops = np.full(len(names) * sites, LOWEST, dtype=np.int64)
                tops[group[heads]] = score[heads]
                tops = tops.reshape(len(names), sites)
                wanted = np.unique(np.stack([query[row[top]], _blocks_of(number[top], blocks), number[top]], axis=1), axis=0)
                cells, cell = np.unique(wanted[:, :2], axis=0, return_inverse=True)
                cell = cell.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[cells[:, 0]]), pa.array(cells[:, 1], pa.int32()), _lists(wanted[:, 2], cell, len(cells)), _lists(tops[cells[:, 0]].ravel(), np.repeat(np.arange(len(cells)), sites), len(cells))],
                    ["query", "rb", "numbers", "tops"],
                )

        return lists.repartition("query").sortWithinPartitions("query").mapInArrow(run, "query long, rb int, numbers array<long>, tops array<long>")

    def resolved(self, wanted: DataFrame) -> DataFrame:
        """(query, id, score): exact scores of (query, rb, numbers), the best k of each query and row block."""
        k, blocks = self.k, self.row_blocks
        cell = (F.col("qb") * blocks + F.col("rb")).cast("long").alias("cell")
        nothing, none = F.lit(None).cast("array<long>"), F.lit(None).cast("long")
        wanted = wanted.join(self.queries.select(F.col("no").alias("query"), "qb"), "query").select(cell, "query", "numbers")
        asked = wanted.select(F.col("cell"), F.lit(2).alias("side"), F.col("query").alias("no"), none.alias("id"), F.col("numbers").alias("vector"))
        rows = self.rows.withColumn("qb", F.explode(F.expr(f"sequence(0, {self.query_blocks - 1})"))).select(cell, F.lit(0).alias("side"), "no", "id", "vector")
        queries = self.queries.withColumn("rb", F.explode(F.expr(f"sequence(0, {blocks - 1})"))).select(cell, F.lit(1).alias("side"), "no", none.alias("id"), "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, sides = None, [[], []]
            for part in _runs(batches, 2):
                if part.column(0)[0].as_py() != at:
                    at, sides = part.column(0)[0].as_py(), [[], []]
                side = part.column(1)[0].as_py()
                if side < 2:
                    sides[side].append((part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4))))
                    continue
                (numbers, ids, vectors), (names, _, queries) = ([np.concatenate(x) for x in zip(*s)] for s in sides)
                number, row = _spread(part.column(4))
                query = part.column(2).to_numpy()[row]
                r, q = np.searchsorted(numbers, number), np.searchsorted(names, query)
                score = np.empty(len(r), dtype=np.int64)
                for lo in range(0, len(r), PAIRS):
                    hi = lo + PAIRS
                    score[lo:hi] = np.einsum("ij,ij->i", queries[q[lo:hi]], vectors[r[lo:hi]])
                top = _best(row, score, ids[r], k)
                yield pa.RecordBatch.from_arrays([pa.array(query[top]), pa.array(ids[r][top].astype(np.int64)), pa.array(score[top])], ["query", "id", "score"])

        dealt = self._dealt([asked, rows, queries], self.query_blocks * blocks, ["side", "no"]).select("cell", "side", "no", "id", "vector")
        return dealt.mapInArrow(run, "query long, id long, score long")

    def bounds(self, scores: DataFrame, least: Column) -> DataFrame:
        """(query, bound): the k-th best score, ``least`` where there are fewer."""
        top = Window.partitionBy("query").orderBy(F.desc("score"))
        ranked = scores.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= self.k)
        return ranked.groupBy("query").agg(F.coalesce(F.max(F.when(F.col("rank") == self.k, F.col("score"))), least).alias("bound"))

    def collected(self, cutoffs: DataFrame) -> DataFrame:
        """Phase 2: (query, rb, site, numbers, scores, unseen), all entries that reach the cutoff of (no, cutoffs, unseen)."""
        cells = self.query_blocks * self.lists

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held = None, []
            for part in _runs(batches, 2):
                if part.column(0)[0].as_py() != cell:
                    cell, held = part.column(0)[0].as_py(), []
                number, vectors = part.column(2).to_numpy(), _matrix(part.column(3))
                if part.column(1)[0].as_py() == 0:
                    held.append((number, vectors, part.column(4).to_numpy()))
                elif held:
                    names, queries, cutoff = (np.concatenate(x) for x in zip(*held))
                    scores = _product(queries, vectors)
                    q, r = np.nonzero((scores >= cutoff[:, None]) & (names[:, None] != number[None, :]))
                    some, owner = np.unique(q, return_inverse=True)
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[some]), pa.array(np.full(n, part.column(1)[0].as_py() - 1), pa.int32()), pa.array(np.full(n, cell // cells), pa.int32()), _lists(number[r], owner, n), _lists(scores[q, r], owner, n)],
                        ["query", "rb", "site", "numbers", "scores"],
                    )

        queries = self.queries.join(cutoffs.select("no", "cutoffs"), "no")
        return self._local(queries).mapInArrow(run, "query long, rb int, site int, numbers array<long>, scores array<long>")

    def summed(self, entries: DataFrame, cutoffs: DataFrame) -> DataFrame:
        """(query, rb, numbers, upper, exact): entries of a vector summed, with what unseen sites add at most; ``exact`` lists full sums."""
        sites, k = self.sites, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _whole(batches):
                pairs, pair = np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), axis=0, return_inverse=True)
                pair, site, unseen = pair.ravel(), batch.column(2).to_numpy(), _matrix(batch.column(5))
                number, row = _spread(batch.column(3))
                score, _ = _spread(batch.column(4))
                order = np.lexsort((number, pair[row]))
                number, score, row = number[order], score[order], row[order]
                owner = pair[row]
                new = np.append(True, (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])) if len(row) else np.zeros(0, dtype=bool)
                heads = np.flatnonzero(new)
                bound = unseen[row[heads]].sum(axis=1)
                upper = bound + np.add.reduceat(score - unseen[row, site[row]], heads) if len(heads) else bound
                full = np.diff(heads, append=len(row)) == sites
                top = np.flatnonzero(full)[_best(owner[heads][full], upper[full], number[heads][full], k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1], pa.int32()), *(_lists(x[i], owner[heads][i], len(pairs)) for x, i in ((number[heads], slice(None)), (upper, slice(None)), (upper, top)))],
                    ["query", "rb", "numbers", "upper", "exact"],
                )

        rows = entries.join(cutoffs.select(F.col("no").alias("query"), "unseen"), "query")
        return rows.repartition("query").sortWithinPartitions("query", "rb").mapInArrow(run, "query long, rb int, numbers array<long>, upper array<long>, exact array<long>")


def top_k(vectors: DataFrame, k: int, query: Column, vec_id: str = "vec_id", vector: Column | None = None, sites: int = SITES, depth: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for every row where ``query`` holds.

    ``vector`` is an array of whole numbers, by default 64 times the column embedding, rounded down.
    ``depth`` is the length of the lists of the first phase, 4k by default; it changes the cost, never the result.
    """
    vector = scaled("embedding") if vector is None else vector
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), vector.alias("vector"))
    s = _Search(rows, k, sites, depth or 4 * k)
    listed = cut_lineage(s.gathered(s.listed()))
    bounds = s.bounds(s.resolved(listed.select("query", "rb", "numbers")), F.lit(LOWEST))
    tops = listed.groupBy("query").agg(F.first("tops").alias("tops"))
    share = F.expr(f"bound DIV {s.sites} + IF(bound % {s.sites} > 0, 1, 0)")
    rest = F.expr("transform(tops, x -> bound - aggregate(tops, 0L, (a, y) -> a + y) + x)")
    cutoffs = bounds.join(tops, "query").withColumn("share", share).withColumn("rest", rest)
    cutoff = F.expr(f"IF(bound = {LOWEST}, transform(tops, x -> {LOWEST}L), transform(rest, x -> greatest(x, share)))")
    cutoffs = cutoffs.withColumn("cutoffs", cutoff)
    unseen = F.expr("zip_with(cutoffs, tops, (c, t) -> least(c - 1, t))")
    cutoffs = cut_lineage(cutoffs.select(F.col("query").alias("no"), "bound", "cutoffs", unseen.alias("unseen")))
    sums = cut_lineage(s.summed(s.collected(cutoffs), cutoffs))
    exact = sums.select("query", F.explode("exact").alias("score"))
    raised = s.bounds(exact, F.lit(LOWEST))
    raised = cutoffs.select(F.col("no").alias("query"), "bound").join(raised.withColumnRenamed("bound", "other"), "query", "left")
    raised = raised.select("query", F.greatest("bound", F.coalesce("other", F.lit(LOWEST))).alias("bound"))
    near = F.expr("transform(filter(arrays_zip(numbers, upper), x -> x.upper >= bound), x -> x.numbers)")
    left = sums.join(raised, "query").select("query", "rb", near.alias("numbers")).where(F.size("numbers") > 0)
    found = s.resolved(left).join(s.queries.select(F.col("no").alias("query"), F.col("id").alias("query_id")), "query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") != _LAST_ID, F.col("id")).alias("vec_id"), "score")
