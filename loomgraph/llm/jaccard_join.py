"""N-gram Jaccard join: grouped prefix join of documents on their word shingles.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
distinct word shingles.  The steps, all exact:

1. Shingles are ordered by one global order: the counted part of the hash range
   first, frequent shingles of it last, then by hash.  Linked sets share one of
   their first ``n - ceil(percent * n / 100) + 1`` shingles (the prefix).
2. Documents of the same set are one class.  Classes with identical prefixes and
   size collapse into one group; only groups are posted under prefix shingles,
   and shingles with a single posting are dropped before members are attached.
3. Each posting list is compared in blocks inside a task: group pairs are
   filtered by size and position, their members by the parity of 512 bits
   (set differences bound it from above, so no link is lost).  Only a spanning
   forest of the passing pairs leaves the task, never all pairs of a group.
   Parity over more bits then sorts out pairs of long sets.
4. The forest is verified on the full sets.  A second round over the lists
   emits every passing pair whose ends are still in different components, and
   verifies these too; after it no unverified pair between components is left,
   hence the components are exact.

A text without words (or null) has the empty set and links with nothing.  Rows
with a null id count; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.components import components
from loomgraph.llm.rows import packed, small_batches, unpacked
from loomgraph.llm.wordhash import SPACES, Splitter, grams, mixed, shingle_sets
from loomgraph.session import cut_lineage, work_folder

SIGNATURE_WORDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
PARITY_BITS = 512
BLOCK = 1024
SHORT_LIST = 64
HEAD = 6
HOT_BITS = 24
NEED_BITS = 24


def _signature(ordered: np.ndarray) -> bytes:
    """128 bits that name a set (or a sequence, as its order is global)."""
    parts = [np.bitwise_xor.reduce(mixed(ordered ^ w)) ^ np.add.reduce(mixed(ordered + w)) for w in SIGNATURE_WORDS]
    return np.array(parts, dtype=">u8").tobytes()


def _parity(ordered: np.ndarray, bits: int = PARITY_BITS) -> bytes:
    """Whether each of ``bits`` buckets of a set's shingles holds an odd number of them."""
    odd = np.bincount((ordered >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _wide_bits(n: int) -> int:
    """Bits enough that the parity of two unlike sets of ``n`` shingles differs widely."""
    return 1 << max(PARITY_BITS.bit_length() - 1, (n - 1).bit_length())


def _counted(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """(token, n): how often the shingles of the counted range occur, by 32 bits of their hash."""

    def run(batches):
        splitter = Splitter(SPACES)
        for batch in batches:
            for t in splitter.tokens(batch.column(0)):
                h = grams(t.hashes, k)
                inside = np.zeros(len(t.hashes) + 1, dtype=bool)
                inside[: len(h)] = h >> np.uint64(64 - bits) == 0
                for back in range(1, k):
                    inside[np.maximum(t.bounds - back, 0)] = False
                token, n = np.unique(h[inside[: len(h)]].astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int32)), pa.array(n.astype(np.int32))], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token int, n int")


def frequent_bits(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Which of 2**HOT_BITS shingle buckets hold a frequent shingle: one that occurs more than h times.

    Counts cover all texts.  h is the smallest power of two under which at most a
    quarter of the buckets are taken: 1 on small inputs, more on large ones.  The
    table has a fixed size, and a bucket taken by chance only moves a shingle in
    the order, so results are the same for every h.
    """
    counts = _counted(docs, k, bits).groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    counts = cut_lineage(counts.select("token", F.floor(F.log2(F.col("n") - 1)).cast("int").alias("level")))
    levels = dict(counts.groupBy("level").count().collect())
    h = max(levels, default=0)
    while h and sum(n for level, n in levels.items() if level >= h - 1) <= 1 << (HOT_BITS - 2):
        h -= 1
    often = counts.where(F.col("level") >= h)
    buckets = often.select(F.col("token").bitwiseAND((1 << HOT_BITS) - 1).alias("bucket")).distinct().toArrow()
    table = np.zeros(1 << HOT_BITS, dtype=bool)
    table[buckets.column("bucket").to_numpy()] = True
    return table


def _prefixes(docs: DataFrame, k: int, percent: int, hot: np.ndarray, bits: int) -> DataFrame:
    """One row per row of ``docs`` (at, text): at, size, set signature, parity bits, prefix signature, prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(hot))
    low = np.uint64(64 - bits)

    def run(batches):
        splitter = Splitter(SPACES)
        table = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            n, sig, parity, wide, prefix_sig, prefix, lead, head = [], [], [], [], [], [], [], []
            for t in splitter.tokens(batch.column(1)):
                for s in shingle_sets(t, k):
                    n.append(len(s))
                    if not len(s):
                        sig.append(None), parity.append(None), wide.append(None), prefix_sig.append(None), prefix.append(None), lead.append(None), head.append(None)
                        continue
                    keep = len(s) - -(-percent * len(s) // 100) + 1
                    counted = int(np.searchsorted(s, np.uint64(1) << low))
                    late = table[(s[:counted] & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)]
                    order = np.concatenate([s[:counted][~late], s[:counted][late], s[counted:]])[:keep]
                    sig.append(_signature(s))
                    parity.append(_parity(s))
                    wide.append(_parity(s, _wide_bits(len(s))) if len(s) > PARITY_BITS else parity[-1])
                    prefix_sig.append(_signature(order))
                    prefix.append(order.view(np.int64))
                    lead.append(min(int((~late).sum()), len(order)))
                    head.append(order[np.minimum(lead[-1] + np.arange(HEAD), len(order) - 1)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), *[pa.array(x, pa.binary()) for x in (sig, parity, wide, prefix_sig)], pa.array(prefix, pa.list_(pa.int64())), pa.array(lead, pa.int32()), pa.array(head, pa.binary())],
                ["at", "n", "sig", "parity", "wide", "prefix_sig", "prefix", "lead", "head"],
            )

    rest = docs.sparkSession.createDataFrame([], "n int, sig binary, parity binary, wide binary, prefix_sig binary, prefix array<long>, lead int, head binary").schema
    return docs.mapInArrow(run, T.StructType([docs.schema["at"], *rest.fields]))


def _members(classes: DataFrame) -> DataFrame:
    """Posting lists worth comparing: (token, k, n, pos, sig, parity, lead, head), k members under the token."""
    groups = classes.groupBy("prefix_sig", "n").agg(F.count(F.lit(1)).alias("m"), F.first("prefix").alias("prefix"))
    # A short name of the group is enough here: groups that share one by chance only attach more members.
    name = F.xxhash64("prefix_sig").alias("name")
    postings = groups.select(name, "n", "m", F.posexplode("prefix").alias("pos", "token"))
    lists = postings.groupBy("token").agg(F.sum("m").alias("k")).where("k > 1")
    wanted = postings.select("token", "name", "n", "pos").join(lists, "token")
    return wanted.join(classes.select(name, "n", "sig", "parity", "lead", "head"), ["name", "n"]).drop("name")


class _Lists:
    """Rows of several posting lists, one after the other, and the filters between members of a list."""

    def __init__(self, table: pa.Table, percent: int):
        table = table.combine_chunks()
        self.percent = percent
        self.keys = np.stack([table.column(c).to_numpy() for c in ("token", "b1", "b2")])
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.rest = self.n - table.column("pos").to_numpy()
        self.side = table.column("side").to_numpy()
        self.split = self.keys[1] != self.keys[2]
        self.behind = table.column("pos").to_numpy() - table.column("lead").to_numpy()
        self.sigs, self.parity, self.labels, self.heads = (_fixed(table.column(c)) for c in ("sig", "parity", "label", "head"))

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) may link, and not from an earlier list: block, size, position, parity, head.

        A pair that shares a shingle before this list's one meets in that list
        too.  A head, the first frequent shingles of a prefix, tells most of these;
        the list of the first common shingle never lets its pair go.
        """
        total = self.n[i] + self.n[j]
        overlap = -(-self.percent * total // (100 + self.percent))
        ok = np.minimum(self.rest[i], self.rest[j]) >= overlap
        ok &= 100 * np.minimum(self.n[i], self.n[j]) >= self.percent * np.maximum(self.n[i], self.n[j])
        ok &= ~self.split[i] | (self.side[i] != self.side[j])
        at = np.flatnonzero(ok)
        odd = np.bitwise_count(self.parity[i[at]] ^ self.parity[j[at]]).sum(axis=1, dtype=np.int64)
        ok[at] = odd <= (total - 2 * overlap)[at]
        for q in range(HEAD):
            at = np.flatnonzero(ok)
            at = at[self.behind[i[at]] > q]
            ok[at] = (self.heads[j[at]] != self.heads[i[at], q : q + 1]).all(axis=1)
        return ok

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.labels[i] != self.labels[j]).any(axis=1)

    def short(self, starts: np.ndarray, sizes: np.ndarray, all_between: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of short lists, all lists at once: a spanning forest of each, or all between labels."""
        rows = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(s, s + m) for s, m in zip(starts, sizes)]])
        rank = rows - np.repeat(starts, sizes)
        j = np.repeat(rows, rank)
        i = np.repeat(rows - rank, rank) + np.arange(len(j)) - np.repeat(np.cumsum(rank) - rank, rank)
        if all_between:
            keep = self.apart(i, j)
            i, j = i[keep], j[keep]
        keep = self.passing(i, j)
        i, j = i[keep], j[keep]
        return (i, j) if all_between else _spanning(i, j)

    def long(self, start: int, size: int, all_between: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long list, row by row: breadth first from its first member."""
        left, found = np.arange(start, start + size), []
        if all_between:
            for v in range(start, start + size):
                others = np.arange(v + 1, start + size)
                others = others[self.apart(np.full(len(others), v), others)]
                others = others[self.passing(np.full(len(others), v), others)]
                found.append((np.full(len(others), v), others))
        while len(left) and not all_between:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                v = queue.pop(0)
                ok = self.passing(np.full(len(left), v), left)
                new, left = left[ok], left[~ok]
                found.append((np.full(len(new), v), new))
                queue.extend(new)
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *[f[s] for f in found]]) for s in (0, 1))

    def pairs(self, all_between: bool) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero((self.keys[:, 1:] != self.keys[:, :-1]).any(axis=0)) + 1, [len(self.n)]])
        starts, sizes = cuts[:-1], np.diff(cuts)
        small = (sizes > 1) & (sizes <= SHORT_LIST)
        found = [self.short(starts[small], sizes[small], all_between)]
        found += [self.long(s, m, all_between) for s, m in zip(starts.tolist(), sizes.tolist()) if m > SHORT_LIST]
        i, j = (np.concatenate([f[s] for f in found]) for s in (0, 1))
        a, b = self.sigs[i], self.sigs[j]
        swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
        a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        both = (np.unique(np.hstack([a, b]), axis=0) if len(a) else np.zeros((0, 4))).astype(">u8")
        return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in both[:, c : c + 2]], pa.binary()) for c in (0, 2)], ["a", "b"])


def _fixed(column: pa.ChunkedArray) -> np.ndarray:
    """A column of byte strings of one length as rows of big-endian words."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=">u8").reshape(len(values), -1)


def _spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of which no two ends are joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for at, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            keep.append(at)
    return i[keep], j[keep]


def _pairs(members: DataFrame, percent: int, labels: DataFrame | None) -> DataFrame:
    """Distinct candidate pairs (a, b) of signatures, a < b: a forest per block, or all between labels."""
    first_round, keys = labels is None, ["token", "b1", "b2"]
    if not first_round:
        members = members.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left")
    else:
        members = members.withColumn("label", F.lit(None).cast("binary"))
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    dealt = members.withColumn("side", F.pmod(F.xxhash64("sig"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    dealt = dealt.select(
        "token", F.least("side", "other").alias("b1"), F.greatest("side", "other").alias("b2"),
        "side", "n", "pos", "sig", "parity", "lead", "head", F.coalesce("label", "sig").alias("label"),
    )

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = [table.column(c)[-1].as_py() for c in keys]
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(keys, last)])
            cut = int(np.argmax(same))
            held = table.slice(cut)
            if cut:
                yield _Lists(table.slice(0, cut), percent).pairs(not first_round)
        if held is not None:
            yield _Lists(held, percent).pairs(not first_round)

    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys, "n", "sig")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their wide parity, which tells long sets apart without fetching them."""
    one = classes.select(F.col("sig").alias("a"), F.col("n").alias("n1"), F.col("wide").alias("w1"))
    two = classes.select(F.col("sig").alias("b"), F.col("n").alias("n2"), F.col("wide").alias("w2"))

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            slack = n + m - 2 * -(-percent * (n + m) // (100 + percent))
            keep = []
            for x, y, most in zip(batch.column(4), batch.column(5), slack.tolist()):
                x, y = sorted((np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y)), key=len)
                folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep.append(int(np.bitwise_count(folded ^ x).sum(dtype=np.int64)) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "w1", "w2")
    return both.mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, k: int, needed: DataFrame) -> DataFrame:
    """(sig, items) for the needed signatures.  A fixed bit table spares most other texts the way."""
    bucket = F.conv(F.hex(F.substring("sig", 1, 3)), 16, 10).cast("int").alias("bucket")
    table = np.zeros(1 << NEED_BITS, dtype=bool)
    table[needed.select(bucket).distinct().toArrow().column("bucket").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        splitter = Splitter(SPACES)
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            sigs, items, size = [], [], 0
            for t in splitter.tokens(batch.column(0)):
                for s in shingle_sets(t, k):
                    sig = _signature(s) if len(s) else None
                    if sig and wanted[int.from_bytes(sig[:3], "big")]:
                        sigs.append(sig)
                        items.append(s.tobytes())
                        size += s.nbytes
                if sigs and size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(items, pa.binary())], ["sig", "items"])
                    sigs, items, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(items, pa.binary())], ["sig", "items"])

    found = docs.select("text").mapInArrow(run, "sig binary, items binary")
    return found.groupBy("sig").agg(F.first("items").alias("items")).join(needed, "sig", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets link."""
    one = sets.select(F.col("sig").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("sig").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def classes_of(docs: DataFrame, at: Column, text: Column, k: int, percent: int) -> DataFrame:
    """(at, n, sig, label) for every row of ``docs``: size and name of its set, and its component.

    ``at`` is carried along; ``sig`` and ``label`` are null for an empty set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_folder(spark)
    bits = 2 if percent >= 85 else 1
    docs = docs.select(at.alias("at"), text.alias("text"))
    table = frequent_bits(docs, k, bits)
    _prefixes(docs, k, percent, table, bits).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    whole = F.first(F.struct("n", "parity", "wide", "prefix_sig", "prefix", "lead", "head")).alias("c")
    rows.where("n > 0").groupBy("sig").agg(whole).select("sig", "c.*").write.parquet(f"{folder}/classes")
    _members(spark.read.parquet(f"{folder}/classes")).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    classes = spark.read.parquet(f"{folder}/classes")

    def links(labels: DataFrame | None) -> DataFrame:
        pairs = cut_lineage(_close(_pairs(members, percent, labels), classes, percent))
        if pairs.isEmpty():
            return pairs
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        path = f"{folder}/sets{0 if labels is None else 1}"
        _sets(docs, k, ends).write.parquet(path)
        return cut_lineage(_verified(pairs, spark.read.parquet(path), percent))

    labels = components(links(None))
    more = links(labels)
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    labels = labels.select(F.col("node").alias("sig"), "label")
    return rows.select("at", "n", "sig").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; repeated ids keep their rows."""
    rows = classes_of(docs, F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"), k, percent)
    lowest = rows.where("n > 0").groupBy("label").agg(F.min("at").alias("least"))
    return rows.join(lowest, "label", "left").select(
        F.col("at").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("at")).otherwise(F.col("least")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, then of the smallest row hash.

    Rows without words are all kept, equal ones too.  A null id comes after all
    others.  Columns are those of ``docs``; whole rows are shuffled once.
    """
    worded = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    full, empty = docs.where(worded), docs.where(~worded)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"))
    number = F.col(f"`{doc_id}`")
    at = F.struct(number.isNull().alias("unnamed"), number.alias("doc_id"), key.alias("key"))
    classes = classes_of(full, at, F.col(f"`{text}`").cast("string"), k, percent)
    kept = classes.groupBy("label").agg(F.min("at").alias("at")).select("at.key")
    rows = full.select(packed(full), key.alias("key")).groupBy("key").agg(F.first("row").alias("row"))
    return unpacked(rows.join(kept, "key", "left_semi")).unionByName(empty) if docs.columns else docs
