"""Graph files: node-link documents in, line records in and out (A1, A2)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schemas
from loomgraph.session import cut_lineage, stored


def write_graph_documents(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Write a node-link document per repository (A2): a folder each, its lines one JSON value together.

    A document is one file and so one task's work; records (below) have no such bound.
    """

    def lines(rows: DataFrame, place: int, fields: dict) -> DataFrame:
        value = F.to_json(F.struct(*[F.col(f).alias("_origin" if f == "origin" else f) for f in fields]))
        return rows.select("repo", F.lit(place).alias("place"), "ord", value.alias("value"))

    repos = nodes.select("repo").distinct()
    ends = [(0, '{"directed":false,"graph":{},"nodes":['), (2, '],"links":['), (4, '],"hyperedges":[]}')]
    parts = [repos.select("repo", F.lit(place).alias("place"), F.lit(0).cast("long").alias("ord"), F.lit(text).alias("value")) for place, text in ends]
    parts += [lines(nodes, 1, schemas.NODE_FIELDS), lines(links, 3, schemas.LINK_FIELDS)]
    # One window deals and sorts the rows of all parts; a repartition of parts that are dealt by
    # repository already is left out by Spark, and their rows then end in a file for each part.
    document = Window.partitionBy("repo").orderBy("place", "ord")
    rows = reduce(DataFrame.unionByName, parts).withColumn("follows", F.lag("place").over(document) == F.col("place"))
    text = F.concat(F.when(F.col("follows"), ",").otherwise(""), F.col("value"))
    rows.select("repo", text.alias("value")).write.partitionBy("repo").mode("overwrite").text(path)


#: Rows of a file of graph records.
FILE_ROWS = 1_000_000


def load_graph_documents(spark: SparkSession, paths, repo: Column | None = None):
    """Nodes, links and hyperedges of node-link documents, one document per repository (A1).

    A document is read in ranges of bytes, as many tasks as its size asks for: the
    text source cuts it at closing braces, wherever a range begins.  Whether a cut
    lies in a string follows from the quotes before it, its depth from the braces
    outside strings; both are running sums inside a range plus the sums of earlier
    ranges.  So the text is read twice, first for the sums of each range, then for
    the objects right below the document, which are put together where they are read;
    only those that lie in two ranges or more meet in another task.  Objects are
    parsed one by one.  ``repo`` is an expression of the column file, by default
    the name of the document's folder.
    """
    repo = F.element_at(F.split("file", "/"), -2) if repo is None else repo
    cuts = _cuts(spark, paths)
    objects = _objects(_pieces(cuts, _starts(cuts)))
    objects = objects.withColumn("repo", repo)
    schemas_of = {f.name: f.dataType.elementType for f in schemas.GRAPH_DOCUMENT.fields}

    def section(name: str) -> DataFrame:
        rows = objects.where(F.col("section") == name)
        return rows.select("repo", (F.col("g") - F.col("first")).cast("int").alias("ord"), F.from_json("object", schemas_of[name]).alias("x"))

    nodes = section("nodes").select("repo", "ord", "x.*").withColumnRenamed("_origin", "origin")
    links = section("links").select("repo", "ord", "x.*")
    # Hyperedges are objects, or plain values that stand in the text between objects.
    plain = F.from_json(F.regexp_extract("outside", r'"hyperedges"\s*:\s*(\[[^\[\]{}]*\])', 1), "array<string>")
    hyperedges = objects.where(F.col("section") == "hyperedges").select("repo", F.col("object").alias("hyperedge")).unionByName(
        objects.where(F.col("outside").contains('"hyperedges"')).select("repo", F.explode(plain).alias("hyperedge"))
    )
    return nodes, links, hyperedges


def _cuts(spark: SparkSession, paths) -> DataFrame:
    """(file, block, value, q, out, within): the text between closing braces, in its order inside a range.

    ``q`` counts its quotes; ``out`` and ``within`` its opening braces outside strings, if it begins outside one or in one.
    """
    rows = spark.read.option("lineSep", "}").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def count(text: str, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    rows = rows.withColumn("bare", F.regexp_replace("value", r"\\.", ""))  # without escaped characters
    rows = rows.withColumn("open", F.regexp_replace("bare", r'"[^"]*+"?', ""))  # without strings, if it begins outside one
    return rows.select("file", "block", "value", count("bare", '"').alias("q"), count("open", "{").alias("out"), (count("bare", "{") - count("open", "{")).alias("within"))


def _ranges(batches):
    """(file, block, rows of one batch) of each range in the order read."""
    for batch in batches:
        file, block = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
        new = block[1:] != block[:-1]
        if batch.num_rows > 1:
            new |= pc.not_equal(file.slice(1), file.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield file[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _numbers(rows, *names: str) -> list:
    return [rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def _steps(q, out, within, inside):
    """Change of depth at each cut; ``inside`` is 1 where it begins in a string."""
    closes = (inside + q) % 2 == 0
    return np.where(inside == 0, out, within) - closes, closes


def _range_sums(batches):
    """Quotes and change of depth of each range, the latter if it begins outside a string and if it begins in one."""
    at, sums = None, [0, 0, 0]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(_SUMS.names, (*at, *sums)))], schema=_SUMS)

    for file, block, rows in _ranges(batches):
        if at != (file, block):
            if at:
                yield row()
            at, sums = (file, block), [0, 0, 0]
        q, out, within = _numbers(rows, "q", "out", "within")
        before = (sums[0] + np.cumsum(q) - q) % 2
        sums = [sums[0] + int(q.sum()), *(sums[1 + h] + int(_steps(q, out, within, before ^ h)[0].sum()) for h in (0, 1))]
    if at:
        yield row()


def _starts(cuts: DataFrame) -> DataFrame:
    """(file, block, inside, depth): whether a range begins in a string, and at which depth."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(cuts.drop("value").mapInArrow(_range_sums, "file string, block long, q long, d0 long, d1 long"))  # one row a range
    inside = F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2
    sums = sums.withColumn("inside", inside).withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    return sums.select("file", "block", "inside", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth"))


def _joined(batches):
    """(file, block, k, ended, text): the cuts of each object right below the document; ``k`` counts those that ended before it in the range.

    The last of a range may go on in the next one, the first began in an earlier one.
    """
    at, quotes, depth, k, open_ = None, 0, 0, 0, []

    def rest():
        return pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, (*at, k, False, "}".join(open_))))], schema=_PIECES)

    for file, block, rows in _ranges(batches):
        if at != (file, block):
            if open_:
                yield rest()
            at, k, open_ = (file, block), 0, []
            quotes, depth = (int(rows.column(name)[0].as_py()) for name in ("inside", "depth"))
        q, out, within = _numbers(rows, "q", "out", "within")
        inside = (quotes + np.cumsum(q) - q) % 2
        delta, closes = _steps(q, out, within, inside)
        after = depth + np.cumsum(delta)
        ends = np.flatnonzero(closes & (after == 1))
        quotes, depth = (quotes + int(q.sum())) % 2, int(after[-1])
        value = rows.column("value")
        if len(ends):
            first = "}".join([*open_, *value.slice(0, int(ends[0]) + 1).to_pylist()])
            others = value.slice(int(ends[0]) + 1, int(ends[-1] - ends[0]))
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.concat_arrays([others]))
            text = pa.concat_arrays([pa.array([first], pa.string()), pc.binary_join(lists, "}")])
            n, open_ = len(ends), []
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(np.arange(k, k + n)), pa.array([True] * n), text], schema=_PIECES
            )
            k += n
        open_ += value.slice(int(ends[-1]) + 1 if len(ends) else 0).to_pylist()
    if open_:
        yield rest()


_SUMS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("q", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64())])
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("ended", pa.bool_()), ("text", pa.string())])


def _pieces(cuts: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, k, ended, whole, text, object, outside): objects, split where they lie in one range, their text where they may not."""
    rows = cuts.join(F.broadcast(starts), ["file", "block"])
    rows = rows.mapInArrow(_joined, "file string, block long, k long, ended boolean, text string")
    whole = F.col("ended") & (F.col("k") > 0)
    rows = _split(rows.withColumn("whole", whole), F.when(F.col("whole"), F.concat("text", F.lit("}"))))
    return stored(rows.withColumn("text", F.when(~F.col("whole"), F.col("text"))))


def _split(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the object that ``text`` ends with, null if there is none, and the text before it."""
    # Only the text before the object is matched; a pattern over whole objects costs many times the rest of the read.
    before = r'^(?:[^"{]++|"(?:[^"\\]++|\\[\s\S])*+")*+'
    held = rows.withColumn("_text", text).withColumn("_before", F.regexp_extract("_text", before, 0))
    held = held.withColumn("_object", F.substr("_text", F.length("_before") + 1))
    some = F.startswith("_object", F.lit("{"))
    return held.withColumns({"object": F.when(some, F.col("_object")), "outside": F.when(some, F.col("_before")).otherwise(F.col("_text"))}).drop("_text", "_before", "_object")


def _objects(pieces: DataFrame) -> DataFrame:
    """(file, g, section, first, object, outside): each object, the key of its array, and the text before it; g numbers the objects of a document."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.groupBy("file", "block").agg(F.sum(F.col("ended").cast("long")).alias("n"))  # one row a range
    ends = cut_lineage(ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    numbered = pieces.join(F.broadcast(ends), ["file", "block"]).withColumn("g", F.col("offset") + F.col("k"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    cut = numbered.where("NOT whole").groupBy("file", "g").agg(F.concat(F.array_join(texts, "}"), F.lit("}")).alias("text"))  # two a range
    text = F.when(F.col("g") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    columns = ["file", "g", "object", "outside"]
    held = numbered.where("whole").select(*columns).unionByName(cut_lineage(_split(cut, text).select(*columns)))
    key = F.regexp_extract("outside", r'"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*$', 1)
    marks = held.where((key != "") & F.col("object").isNotNull()).select("file", F.struct("g", key.alias("key")).alias("m"))
    marks = cut_lineage(marks.groupBy("file").agg(F.array_sort(F.collect_list("m")).alias("marks")))  # a few keys a document
    last = F.element_at(F.filter("marks", lambda m: m["g"] <= F.col("g")), -1)
    return held.join(F.broadcast(marks), "file", "left").withColumn("last", last).select(
        "file", "g", F.when(F.col("object").isNotNull(), F.col("last.key")).alias("section"), F.col("last.g").alias("first"), "object", "outside"
    )


def write_graph_records(nodes: DataFrame, links: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write a graph as JSON lines, a folder per repository for nodes and links (A2).

    Rows are gathered by repository, so a small one is one file; large ones are
    divided among tasks and files of ``file_rows`` rows, so none has to fit in one task.
    Files are compressed, as field names repeat in each line; none is too large for the one task that reads it.
    """
    fields = ["repo", "ord"]
    for name, rows in (("nodes", nodes.select(*fields, *schemas.NODE_FIELDS)), ("links", links.select(*fields, *schemas.LINK_FIELDS))):
        writer = rows.hint("rebalance", "repo").write.partitionBy("repo").option("maxRecordsPerFile", file_rows).option("compression", "gzip")
        writer.mode("overwrite").json(f"{path}/{name}")


def load_graph_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links written by ``write_graph_records`` (A1)."""

    def read(name, fields):
        schema = T.StructType(
            [T.StructField("ord", T.LongType())]
            + [T.StructField(n, t) for n, t in fields.items()]
            + [T.StructField("repo", T.StringType())]
        )
        return spark.read.schema(schema).json(f"{path}/{name}")

    return read("nodes", schemas.NODE_FIELDS), read("links", schemas.LINK_FIELDS)
