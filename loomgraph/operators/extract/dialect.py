"""SQL dialect of a file from weighted markers (C4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.operators.extract.common import pattern, rule_rows

# --- Fixed values: (marker, weight) of each dialect; each counts once per file ---
POSTGRES_MARKERS = (
    (r"\$\$|\$[A-Za-z_][A-Za-z0-9_]*\$", 3),
    (r"(?i)\bLANGUAGE\s+(?:plpgsql|sql|plpython3u|plperl|c)\b", 3),
    (r"(?i)\bCREATE\s+MATERIALIZED\s+VIEW\b", 3),
    (r"(?i)\bEXECUTE\s+(?:FUNCTION|PROCEDURE)\b", 3),
    (r"(?i)\bCREATE\s+EXTENSION\b", 3),
    (r"(?i)\bSET\s+search_path\b", 3),
    (r"(?i)\bON\s+CONFLICT\b", 3),
    (r"(?i)\bRETURNS\s+(?:TABLE|SETOF|trigger)\b", 2),
    (r"(?i)\b(?:big|small)?serial\b", 2),
    (r"(?i)\bCREATE\s+OR\s+REPLACE\b", 2),
    (r"(?i)\b(?:jsonb|tsvector|bytea|int4range|citext)\b", 2),
    (r"[A-Za-z0-9_)]::[A-Za-z_]", 2),
    (r"(?i)\bCOMMENT\s+ON\s+(?:TABLE|COLUMN|FUNCTION|SCHEMA)\b", 2),
    (r"(?i)\bALTER\s+TABLE\s+ONLY\b", 2),
    (r"(?i)\b(?:TEXT|VARCHAR)\s*\[\s*\]", 2),
    (r"(?i)\bOWNER\s+TO\b", 1),
    (r"(?i)\bCREATE\s+SEQUENCE\b", 1),
    (r"(?i)\bIF\s+NOT\s+EXISTS\b", 1),
    (r"(?i)\bnow\(\)|\bgen_random_uuid\(\)", 1),
)
TSQL_MARKERS = (
    (r"(?im)^\s*GO\s*;?\s*$", 3),
    (r"(?i)\bCREATE\s+OR\s+ALTER\b", 3),
    (r"(?i)\bsp_executesql\b", 3),
    (r"(?i)\bSET\s+NOCOUNT\s+ON\b", 3),
    (r"(?i)\bIDENTITY\s*\(\s*\d+\s*,\s*\d+\s*\)", 3),
    (r"(?i)\b(?:NVARCHAR|UNIQUEIDENTIFIER|DATETIME2|NCHAR|SMALLDATETIME|MONEY)\b", 3),
    (r"\[[A-Za-z_][A-Za-z0-9_ ]*\]", 3),
    (r"(?i)\bVARCHAR\s*\(\s*MAX\s*\)", 3),
    (r"@[A-Za-z_][A-Za-z0-9_]*", 2),
    (r"(?i)\bBEGIN\s+TRAN(?:SACTION)?\b", 2),
    (r"(?i)\bEXEC(?:UTE)?\s+[A-Za-z_\[]", 2),
    (r"(?i)\bdbo\s*\.", 2),
    (r"(?i)\bWITH\s*\(\s*NOLOCK\s*\)", 2),
    (r"(?i)\bTOP\s+\(?\d+\)?\b", 1),
    (r"(?i)\bISNULL\s*\(|\bGETDATE\s*\(\)|\bSCOPE_IDENTITY\s*\(\)", 1),
    (r"(?i)\bCLUSTERED\b", 1),
)


def score(text: Column, markers) -> Column:
    """Sum of the weights of the markers found at least once."""
    rules = rule_rows("regex weight", [(pattern(regex), weight) for regex, weight in markers])
    return F.aggregate(
        rules,
        F.lit(0),
        lambda total, m: total + F.when(F.rlike(text, m["regex"]), m["weight"]).otherwise(F.lit(0)),
    )


def dialect(text: Column) -> Column:
    """``postgres``, ``mssql`` or ``unknown`` (a tie)."""
    lead = F.signum(score(text, POSTGRES_MARKERS) - score(text, TSQL_MARKERS)).cast("int")
    return F.element_at(F.array(F.lit("mssql"), F.lit("unknown"), F.lit("postgres")), lead + 2)


def owner(text: Column, default: str = "mssql") -> Column:
    """The extractor that reads a file; undecided files go to the default."""
    lead = F.signum(score(text, POSTGRES_MARKERS) - score(text, TSQL_MARKERS)).cast("int")
    names = F.array(F.lit("mssql"), F.lit(default or "mssql"), F.lit("postgres"))
    return F.element_at(names, lead + 2)
