"""Shared pieces of the extraction jobs.

A job maps ``files(repo, path, content)`` to fragment tables.  Text work stays in
built-in expressions: a pattern's matches come from ``regexp_extract_all`` and
their lines from a marker put before each match, so no pass over a file leaves
the JVM and nothing is shuffled until hits meet other files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import rules
from loomgraph.functions.columns import base_name, extension, lit_array, walk_key

_MARK = "\u0001"
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


# A boundary before a word character, and one after a word character, need one look only.
_OPENING = re.compile(r"\\b(?=[A-Za-z]|\(\?:[A-Za-z]|\\w|\(\[A-Za-z)")
_CLOSING = re.compile(r"(?:(?<=[^\\][A-Za-z])|(?<=[A-Za-z]\)))\\b")


def pattern(text: str) -> str:
    """A pattern with word boundaries that see ASCII words only, on every JVM."""
    text = _OPENING.sub(lambda _: r"(?<!\w)", text)
    text = _CLOSING.sub(lambda _: r"(?!\w)", text)
    return text.replace(r"\b", _ASCII_BOUNDARY)


@dataclass
class Fragments:
    """What extractors emit: nodes, edges and warnings, each with repo and extractor."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame | None = None

    def __add__(self, other: Fragments) -> Fragments:
        both = [w for w in (self.warnings, other.warnings) if w is not None]
        return Fragments(
            self.nodes.unionByName(other.nodes),
            self.edges.unionByName(other.edges),
            reduce(DataFrame.unionByName, both) if both else None,
        )


# --- file selection ----------------------------------------------------------

# File names that are tests by convention.
TEST_FILE_RE = (
    r"(_test\.go|\.(test|spec)\.(js|jsx|ts|tsx|mjs)|_test\.py|tests?\.java|test\.kt|tests?\.cs)$"
    r"|^test_.*\.py$"
)


def select_files(
    files: DataFrame, max_bytes: int | None, extensions=None, skip_dirs=rules.SKIP_DIRS, skip_tests: bool = False
) -> DataFrame:
    """Files an extractor reads, with ``ext``, ``name`` and the walk-order key (A3).

    ``max_bytes`` leaves out longer files; None, which every extractor passes, reads all.
    """
    dirs = F.split(F.col("path"), "/")
    dirs = F.slice(dirs, 1, F.size(dirs) - 1)
    name = F.lower(base_name(F.col("path")))
    rows = files.withColumn("ext", extension(F.col("path"))).withColumn("name", name)
    if extensions is not None:
        rows = rows.where(F.col("ext").isin(*extensions))
    if skip_tests:
        rows = rows.where(~F.col("name").rlike(TEST_FILE_RE))
    if max_bytes is not None:
        rows = rows.where(F.octet_length("content") <= max_bytes)
    return rows.where(~F.arrays_overlap(dirs, lit_array(skip_dirs))).withColumn("walk", walk_key(F.col("path")))


# --- matches -----------------------------------------------------------------


def _regex(regex: str | Column) -> Column:
    return F.lit(regex) if isinstance(regex, str) else regex


def _marked(text: Column, regex: str | Column) -> Column:
    return F.regexp_replace(F.translate(text, _MARK, " "), _regex(regex), F.lit(_MARK + "$0"))


def _mark_lines(marked: Column) -> Column:
    def repeat(line: Column, i: Column) -> Column:
        marks = F.length(line) - F.length(F.translate(line, _MARK, ""))
        return F.array_repeat(i + 1, marks)

    return F.flatten(F.transform(F.split(marked, "\n"), repeat))


def match_lines(text: Column, regex: str | Column) -> Column:
    """1-based line of the start of each match, in order."""
    return _mark_lines(_marked(text, regex))


def matches(text: Column, regex: str | Column, *groups: int) -> Column:
    """All matches as structs of the given groups (``g0``, ``g1``, …) in order."""
    columns = [F.regexp_extract_all(text, _regex(regex), F.lit(g)) for g in groups]
    zipped = F.arrays_zip(*[c.alias(f"g{g}") for g, c in zip(groups, columns)])
    return zipped.cast("array<struct<" + ",".join(f"g{g}:string" for g in groups) + ">>")


def matches_with_lines(text: Column, regex: str | Column, group: int) -> Column:
    """All matches as ``(value, line)`` structs; one pass for texts without any."""
    found = F.zip_with(
        F.regexp_extract_all(text, _regex(regex), F.lit(group)),
        match_lines(text, regex),
        lambda v, line: F.struct(v.alias("value"), line.alias("line")),
    )
    none = F.array().cast("array<struct<value:string,line:int>>")
    return F.when(F.rlike(text, _regex(regex)), found).otherwise(none)


def extract_group(text: Column, regex: Column, group: int) -> Column:
    """``regexp_extract`` with a pattern that is itself a column."""
    return F.call_function("regexp_extract", text, regex, F.lit(group))


def rule_rows(names: str, rows) -> Column:
    """A literal array of rule structs; ``names`` are the field names."""
    fields = names.split()
    return F.array(
        *[
            F.struct(
                *[
                    (F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)).alias(n)
                    for n, v in zip(fields, row)
                ]
            )
            for row in rows
        ]
    )


def segments(text: Column, starts: str) -> Column:
    """Pieces of a text that begin where ``starts`` matches, as ``(text, line)`` structs."""
    marked = F.regexp_replace(F.translate(text, _MARK, " "), f"(?={starts})", _MARK)
    pieces = F.split(marked, _MARK)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    cut = F.zip_with(
        pieces, _mark_lines(marked), lambda t, line: F.struct(t.alias("text"), line.alias("line"))
    )
    none = F.array().cast("array<struct<text:string,line:int>>")
    return F.when(text.rlike(starts), cut).otherwise(none)


def order_key(walk: Column, *numbers: Column) -> Column:
    """Sort key: walk order of the file, then positions inside it, at the full width of a long."""
    parts = [F.lpad(n.cast("long").cast("string"), 19, "0") for n in numbers]
    return F.concat_ws("\u0000", walk, *parts)


def location(line: Column) -> Column:
    return F.concat(F.lit("L"), line.cast("string"))


# --- emission ----------------------------------------------------------------


def emit_nodes(rows: DataFrame, extractor: str) -> DataFrame:
    """Shape rows as fragment nodes; absent fields are null."""
    return schemas.conform(
        rows.withColumn("extractor", F.lit(extractor)), schemas.NODE_FIELDS, keep=("repo", "extractor", "ord")
    )


def emit_edges(rows: DataFrame, extractor: str) -> DataFrame:
    """Shape rows as fragment edges with default score and weight."""
    from loomgraph.operators.build import edge_defaults

    shaped = schemas.conform(
        rows.withColumn("extractor", F.lit(extractor)), schemas.LINK_FIELDS, keep=("repo", "extractor", "ord")
    )
    return edge_defaults(shaped)


def hub_id(repo: Column) -> Column:
    return F.concat(F.lit("repo::"), repo)


def hub_nodes(repos: DataFrame) -> DataFrame:
    """The hub node of each repository that emitted something."""
    return repos.select("repo").distinct().select(
        "repo",
        F.lit("").alias("ord"),
        hub_id(F.col("repo")).alias("id"),
        F.col("repo").alias("label"),
        F.lit("package").alias("type"),
        schemas.metadata_struct(is_repository=F.lit(True)).alias("metadata"),
    )


def warn(rows: DataFrame, extractor: str, message: Column) -> DataFrame:
    return rows.select("repo", F.lit(extractor).alias("extractor"), message.alias("message"))
