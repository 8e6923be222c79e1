"""T-SQL objects and their dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.extract import sqlcommon as S
from loomgraph.operators.extract.common import (
    Fragments,
    emit_edges,
    emit_nodes,
    extract_group,
    location,
    matches,
    order_key,
    pattern,
    rule_rows,
    segments,
    select_files,
)
from loomgraph.operators.extract.dialect import owner
from loomgraph.session import cut_lineage

EXTRACTOR = "mssql"
DEFAULT_SCHEMA = "dbo"

# --- Fixed values: an optionally qualified, optionally bracketed name ---
NAME = r"(?:\[?([A-Za-z0-9_]+)\]?\.)?\[?([A-Za-z0-9_]+)\]?"

# --- Fixed values: statement headers; groups 1 and 2 are schema and name ---
HEADERS = {
    "sql_schema": r"CREATE\s+SCHEMA\s+\[?()([A-Za-z0-9_]+)\]?",
    "sql_table": r"CREATE\s+TABLE\s+" + NAME,
    "sql_view": r"CREATE\s+(?:OR\s+ALTER\s+)?VIEW\s+" + NAME,
    "sql_procedure": r"CREATE\s+(?:OR\s+ALTER\s+)?PROC(?:EDURE)?\s+" + NAME,
    "sql_function": r"CREATE\s+(?:OR\s+ALTER\s+)?FUNCTION\s+" + NAME,
    "sql_trigger": r"CREATE\s+(?:OR\s+ALTER\s+)?TRIGGER\s+" + NAME + r"[\s\S]+?ON\s+" + NAME,
}

# --- Fixed values: references inside a body; groups 1 and 2 are schema and name ---
FROM = r"(?i)\bFROM\s+" + NAME
JOIN = r"(?i)\bJOIN\s+" + NAME
INSERT = r"(?i)\bINSERT\s+INTO\s+" + NAME
UPDATE = r"(?i)\bUPDATE\s+" + NAME
DELETE = r"(?i)\bDELETE\s+(?:FROM\s+)?" + NAME
EXEC = r"(?i)\bEXEC(?:UTE)?\s+" + NAME
REFERENCES = r"(?i)\bREFERENCES\s+" + NAME + r"\s*\("
DELETE_FROM = r"(?i)\bDELETE\s+FROM\b"

# --- Fixed values: words that are never objects ---
SKIP_NAMES = (
    "as", "set", "where", "select", "from", "into", "values", "join", "on",
    "inserted", "deleted", "sp_executesql",
)

# --- Fixed values: what each kind's body is scanned for: (pattern, relation, target kind) ---
BODY_RULES = {
    "sql_table": ((REFERENCES, "depends_on_object", "sql_table"),),
    "sql_view": ((FROM, "depends_on_object", "sql_table"), (JOIN, "depends_on_object", "sql_table")),
    "sql_procedure": (
        (FROM, "reads_table", "sql_table"),
        (JOIN, "reads_table", "sql_table"),
        (INSERT, "writes_table", "sql_table"),
        (UPDATE, "writes_table", "sql_table"),
        (DELETE, "writes_table", "sql_table"),
        (EXEC, "depends_on_object", "sql_procedure"),
    ),
    "sql_trigger": (
        (INSERT, "writes_table", "sql_table"),
        (UPDATE, "writes_table", "sql_table"),
        (DELETE, "writes_table", "sql_table"),
        (FROM, "reads_table", "sql_table"),
    ),
}
BODY_RULES["sql_function"] = BODY_RULES["sql_procedure"]

_ANY_HEADER = "(?i)(?:" + "|".join(HEADERS.values()) + ")"


def _headers() -> Column:
    return rule_rows("kind regex", [(kind, "(?i)^" + regex) for kind, regex in HEADERS.items()])


def objects(files: DataFrame, default_dialect: str = "mssql") -> DataFrame:
    """CREATE statements with their body, which runs to the next header."""
    rows = select_files(files, None, (".sql",)).where(
        owner(F.col("content"), default_dialect) == EXTRACTOR
    )
    cut = rows.select(
        "repo", "path", "walk", F.posexplode(segments(F.col("content"), _ANY_HEADER)).alias("i", "s")
    ).select("repo", "path", "walk", "i", F.col("s.text").alias("text"), F.col("s.line").alias("line"))
    text, regex = F.col("text"), F.col("header.regex")
    header = F.get(F.filter(_headers(), lambda h: F.rlike(text, h["regex"])), F.lit(0))
    found = cut.withColumn("header", header).where(F.col("header").isNotNull())

    def trigger(group: int) -> Column:
        # Only the trigger header has groups 3 and 4.
        return F.when(F.col("header.kind") == "sql_trigger", extract_group(text, regex, group))

    def or_default(col: Column) -> Column:
        return F.when(col == "", F.lit(DEFAULT_SCHEMA)).otherwise(col)

    return S.with_ids(
        found.select(
            "repo", "path", "walk", "i", F.col("header.kind").alias("kind"), "line",
            or_default(extract_group(text, regex, 1)).alias("schema"),
            extract_group(text, regex, 2).alias("name"),
            F.substring(text, F.length(extract_group(text, regex, 0)) + 1, F.length(text)).alias("body"),
            or_default(trigger(3)).alias("on_schema"), trigger(4).alias("on_table"),
            F.lit(False).alias("materialized"),
            order_key(F.col("walk"), F.col("i")).alias("ord"),
        )
    )


_REF = "array<struct<relation:string,t_kind:string,t_schema:string,t_name:string>>"


def _body_rules() -> Column:
    rows = [
        (kind, pattern(regex), regex == FROM, relation, target)
        for kind, scans in BODY_RULES.items()
        for regex, relation, target in scans
    ]
    return rule_rows("kind regex reads relation target", rows)


def _references() -> Column:
    """All references in the body, each rule's repeats dropped."""
    # The FROM of DELETE FROM is a write, not a read.
    reads = F.regexp_replace("body", pattern(DELETE_FROM), "DELETE")
    mine = F.filter(_body_rules(), lambda r: r["kind"] == F.col("kind"))

    def apply(rule: Column) -> Column:
        text = F.when(rule["reads"], reads).otherwise(F.col("body"))
        usable = F.filter(
            matches(text, rule["regex"], 1, 2),
            lambda m: (m["g2"] != "") & ~F.lower(m["g2"]).isin(*SKIP_NAMES),
        )
        refs = F.transform(
            usable,
            lambda m: F.struct(
                rule["relation"].alias("relation"),
                rule["target"].alias("t_kind"),
                F.when(m["g1"] == "", F.lit(DEFAULT_SCHEMA)).otherwise(m["g1"]).alias("t_schema"),
                m["g2"].alias("t_name"),
            ),
        ).cast(_REF)
        return F.array_distinct(refs)

    return F.flatten(F.transform(mine, apply))


def references(found: DataFrame) -> DataFrame:
    """Dependency edges of the statements."""
    refs = found.select(
        "repo", "path", "ord", "source", F.posexplode(_references()).alias("r", "ref")
    ).select(
        "repo", "path", F.concat("ord", F.lit("\u0000"), F.lpad(F.col("r").cast("string"), 9, "0")).alias("ord"),
        "source", "ref.*",
    ).withColumns(
        {
            "confidence": F.lit("INFERRED"),
            "source_location": F.lit(None).cast("string"),
            "context": F.lit(None).cast("string"),
        }
    )
    fired = found.where("kind = 'sql_trigger'").select(
        "repo", "path", "ord", "source", F.lit("triggers_on").alias("relation"),
        F.lit("sql_table").alias("t_kind"), F.col("on_schema").alias("t_schema"),
        F.col("on_table").alias("t_name"), F.lit("EXTRACTED").alias("confidence"),
        location(F.col("line")).alias("source_location"), F.lit(None).cast("string").alias("context"),
    )
    return refs.unionByName(fired).withColumn(
        "target", S.object_id(F.col("t_kind"), F.col("t_schema"), F.col("t_name"))
    )


def extract(files: DataFrame, default_dialect: str = "mssql") -> Fragments:
    # Statements are cut once; references, nodes and edges come from the written rows.
    found = cut_lineage(objects(files, default_dialect))
    refs = cut_lineage(references(found))
    nodes = S.object_nodes(found).unionByName(S.target_nodes(refs), allowMissingColumns=True)
    edges = S.schema_edges(found).unionByName(S.reference_edges(refs), allowMissingColumns=True)
    return Fragments(emit_nodes(nodes, EXTRACTOR), emit_edges(edges, EXTRACTOR))
