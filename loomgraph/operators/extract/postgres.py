"""PostgreSQL objects and their dependencies.

A file is cut into tokens by one pattern (comments, literals, dollar bodies,
quoted names, the rest).  Comments and literals become blanks; the letters of
dollar bodies are moved to private code points, so no header can match inside a
body, and moved back once the statements are cut.
"""

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

EXTRACTOR = "postgres"
DEFAULT_SCHEMA = "public"

# --- Fixed values: an optionally qualified, optionally quoted name ---
IDENT = r"[A-Za-z_][A-Za-z0-9_$]*"
NAME = rf'(?:"?({IDENT})"?\s*\.\s*)?"?({IDENT})"?'

# --- Fixed values: statement headers; groups 1 and 2 are schema and name ---
HEADERS = {
    "sql_schema": rf'CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?"?()({IDENT})"?',
    "materialized": r"CREATE\s+MATERIALIZED\s+VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?" + NAME,
    "sql_table": r"CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:(?:TEMP|TEMPORARY|UNLOGGED)\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    + NAME,
    "sql_view": r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|RECURSIVE)\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    + NAME,
    "sql_function": r"CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+" + NAME,
    "sql_procedure": r"CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+" + NAME,
    "sql_trigger": rf'CREATE\s+(?:OR\s+REPLACE\s+)?(?:CONSTRAINT\s+)?TRIGGER\s+"?({IDENT})"?[\s\S]{{0,400}}?\bON\s+'
    + NAME,
    "alter": r"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?" + NAME,
    "boundary": r"\b(?:CREATE\s+(?:UNIQUE\s+)?INDEX|CREATE\s+SEQUENCE|CREATE\s+EXTENSION|CREATE\s+TYPE"
    r"|CREATE\s+DOMAIN|CREATE\s+POLICY|COMMENT\s+ON|GRANT\s+|REVOKE\s+|DROP\s+)",
}

# --- Fixed values: references inside a body; groups 1 and 2 are schema and name ---
FROM = r"(?i)\bFROM\s+(?:ONLY\s+)?" + NAME
JOIN = r"(?i)\bJOIN\s+(?:ONLY\s+)?" + NAME
INSERT = r"(?i)\bINSERT\s+INTO\s+(?:ONLY\s+)?" + NAME
UPDATE = r"(?i)\bUPDATE\s+(?:ONLY\s+)?" + NAME
DELETE = r"(?i)\bDELETE\s+FROM\s+(?:ONLY\s+)?" + NAME
CALL = r"(?i)\bCALL\s+" + NAME
PERFORM = r"(?i)\bPERFORM\s+" + NAME
REFERENCES = r"(?i)\bREFERENCES\s+" + NAME
FOREIGN_KEY = r"(?i)\bFOREIGN\s+KEY\b[\s\S]{0,200}?\bREFERENCES\s+" + NAME
TRIGGER_EXEC = r"(?i)\bEXECUTE\s+(?:FUNCTION|PROCEDURE)\s+" + NAME
DELETE_FROM = r"(?i)\bDELETE\s+FROM\b"
CTE_NAME = (
    rf'(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)"?({IDENT})"?\s+AS\s*(?:(?:NOT\s+)?MATERIALIZED\s*)?\('
)

# --- Fixed values: words that are never objects ---
SKIP_NAMES = (
    "as", "set", "where", "select", "from", "into", "values", "join", "on", "only", "using",
    "returning", "and", "or", "not", "exists", "lateral", "when", "then", "else", "end", "if",
    "loop", "begin", "declare", "return", "table", "distinct", "all", "new", "old",
)

# --- Fixed values: body scans per kind: (pattern, relation, target kind, skip call forms) ---
_READS = (
    (FROM, "reads_table", "sql_table", True),
    (JOIN, "reads_table", "sql_table", True),
)
_WRITES = (
    (INSERT, "writes_table", "sql_table", False),
    (UPDATE, "writes_table", "sql_table", False),
    (DELETE, "writes_table", "sql_table", False),
)
_CALLS = (
    (CALL, "depends_on_object", "sql_procedure", False),
    (PERFORM, "depends_on_object", "sql_function", False),
)
BODY_RULES = {
    "sql_table": ((REFERENCES, "depends_on_object", "sql_table", False),),
    "sql_view": (
        (FROM, "depends_on_object", "sql_table", True),
        (JOIN, "depends_on_object", "sql_table", True),
    ),
    "sql_function": _READS + _WRITES + _CALLS,
    "sql_procedure": _READS + _WRITES + _CALLS,
    "sql_trigger": _READS + _WRITES,
}

# --- masking -----------------------------------------------------------------

#: Openings of block comments up to which one pattern masks a text; texts with more are walked with a running depth.
_NESTING = 6


def _block_comment() -> str:
    """A block comment with up to ``_NESTING`` comments nested in it."""
    inner = r"(?:[^*]|\*(?!/))*+"
    regex = rf"/\*{inner}(?:\*/|\z)"
    for _ in range(_NESTING):
        regex = rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{regex})*+(?:\*/|\z)"
    return regex


_LINE_COMMENT = r"--[^\n]*+"
_TOKEN = "|".join(
    (
        r"(\$[A-Za-z0-9_]*+\$)[\s\S]*?(?:\1|\z)",
        _LINE_COMMENT,
        _block_comment(),
        r"'[^']*+(?:''[^']*+)*+'?",
        r'"[^"]*+"?',
        r"""[^-/'"$]++|[-/'"$]""",
    )
)
_BODY_TOKEN = "|".join((_LINE_COMMENT, _block_comment(), r"[^-/]++|[-/]"))

_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$;()\"."
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _is_comment(token: Column) -> Column:
    return token.startswith("--") | token.startswith("/*")


def _mask_token(token: Column) -> Column:
    def body(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_BODY_TOKEN), F.lit(0))
        return F.translate(F.array_join(F.transform(pieces, lambda t: F.when(_is_comment(t), _blank(t)).otherwise(t)), ""), _PLAIN, _HIDDEN)

    # A comment of a dollar body ends with the body, before the closing tag.
    tag = F.regexp_extract(token, r"^\$[A-Za-z0-9_]*+\$", 0)
    closed = token.endswith(tag) & (F.length(token) >= 2 * F.length(tag))
    whole = F.concat(body(F.left(token, F.length(token) - F.length(tag))), F.translate(tag, _PLAIN, _HIDDEN))
    return (
        F.when(_is_comment(token) | token.startswith("'"), _blank(token))
        .when(token.startswith("$") & (F.length(token) > 1), F.when(closed, whole).otherwise(body(token)))
        .otherwise(token)
    )


def _mask_by_pattern(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, _mask_token), "")


# Modes of the walk; a dollar body has comments of its own, which its closing tag ends as well.
_CODE, _LINE, _BLOCK, _LITERAL, _QUOTED, _DOLLAR, _DOLLAR_LINE, _DOLLAR_BLOCK = range(8)
_KEEP, _BLANKED, _HIDE = range(3)
_LEXEME = r"""[-/*'"$\n]|[^-/*'"$\n]++"""
_WALK_BLOCK = 256
_STATE = "struct<mode:int,depth:int,tag:string,skip:int,as:int>"


def _state(mode, depth, tag, skip, mask_as) -> Column:
    values = [v if isinstance(v, Column) else F.lit(v) for v in (mode, depth, tag, skip, mask_as)]
    return F.struct(*[v.alias(n) for v, n in zip(values, ("mode", "depth", "tag", "skip", "as"))]).cast(_STATE)


def _step(s: Column, x: Column) -> Column:
    """State after a lexeme ``t`` that ``n1`` and ``n2`` follow; ``as`` tells how the lexeme itself is masked."""
    t, n1, n2 = x["t"], F.coalesce(x["n1"], F.lit("")), F.coalesce(x["n2"], F.lit(""))
    mode, depth, tag = s["mode"], s["depth"], s["tag"]
    opens, closes = (t == "/") & (n1 == "*"), (t == "*") & (n1 == "/")
    dashes = (t == "-") & (n1 == "-")
    tagged = (n2 == "$") & n1.rlike("^[A-Za-z0-9_]+$")
    starts = (t == "$") & ((n1 == "$") | tagged)
    ends = (t == "$") & F.when(tag == "$$", n1 == "$").otherwise(tagged & (F.concat(t, n1, n2) == tag))

    def comment(line: int, block: int, back: int) -> list[tuple[Column, Column]]:
        return [
            ((mode == line), F.when(t == "\n", _state(back, 0, tag, 0, _BLANKED)).otherwise(_state(line, 0, tag, 0, _BLANKED))),
            (
                (mode == block),
                F.when(opens, _state(block, depth + 1, tag, 1, _BLANKED))
                .when(closes & (depth == 1), _state(back, 0, tag, 1, _BLANKED))
                .when(closes, _state(block, depth - 1, tag, 1, _BLANKED))
                .otherwise(_state(block, depth, tag, 0, _BLANKED)),
            ),
        ]

    after_tag = F.when(n1 == "$", 1).otherwise(2)
    out = F.when(s["skip"] > 0, _state(mode, depth, tag, s["skip"] - 1, s["as"]))
    out = out.when((mode >= _DOLLAR) & ends, _state(_CODE, 0, "", after_tag, _HIDE))
    for condition, value in comment(_LINE, _BLOCK, _CODE) + comment(_DOLLAR_LINE, _DOLLAR_BLOCK, _DOLLAR):
        out = out.when(condition, value)
    out = out.when(mode == _LITERAL, F.when(t == "'", _state(_CODE, 0, "", 0, _BLANKED)).otherwise(_state(_LITERAL, 0, "", 0, _BLANKED)))
    out = out.when(mode == _QUOTED, F.when(t == '"', _state(_CODE, 0, "", 0, _KEEP)).otherwise(_state(_QUOTED, 0, "", 0, _KEEP)))
    out = out.when((mode == _DOLLAR) & dashes, _state(_DOLLAR_LINE, 0, tag, 1, _BLANKED))
    out = out.when((mode == _DOLLAR) & opens, _state(_DOLLAR_BLOCK, 1, tag, 1, _BLANKED))
    out = out.when(mode == _DOLLAR, _state(_DOLLAR, 0, tag, 0, _HIDE))
    out = out.when(dashes, _state(_LINE, 0, "", 1, _BLANKED)).when(opens, _state(_BLOCK, 1, "", 1, _BLANKED))
    out = out.when(t == "'", _state(_LITERAL, 0, "", 0, _BLANKED)).when(t == '"', _state(_QUOTED, 0, "", 0, _KEEP))
    tag_text = F.when(n1 == "$", "$$").otherwise(F.concat(F.lit("$"), n1, F.lit("$")))
    return out.when(starts, _state(_DOLLAR, 0, tag_text, after_tag, _HIDE)).otherwise(_state(_CODE, 0, "", 0, _KEEP))


def _mask_by_walk(text: Column) -> Column:
    """The same for comments of any depth: a walk over lexemes that carries its mode and the running depth.

    The walk first finds the state at the start of every block of lexemes, then
    masks each block from there, so a text costs as its length.
    """

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def masked(s: Column, x: Column) -> Column:
        return F.when(s["as"] == _BLANKED, _blank(x["t"])).when(s["as"] == _HIDE, F.translate(x["t"], _PLAIN, _HIDDEN)).otherwise(x["t"])

    def walked(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("s"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return let(_step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], masked(s, x)).alias("out")))

        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def joined(tokens: Column) -> Column:
        near = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(tokens, i + 1).alias("n1"), F.get(tokens, i + 2).alias("n2")))
        last = F.floor((F.size(tokens) - 1) / _WALK_BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(near, k * _WALK_BLOCK + 1, F.lit(_WALK_BLOCK)))
        first = F.array(_state(_CODE, 0, "", 0, _KEEP))

        def pieces(parts: Column) -> Column:
            states = F.aggregate(parts, first, lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), _step))))
            return let(states, lambda known: F.array_join(F.transform(parts, lambda block, k: walked(block, F.get(known, k))), ""))

        return let(blocks, pieces)

    return F.when(text == "", text).otherwise(let(F.regexp_extract_all(text, F.lit(_LEXEME), F.lit(0)), joined))


def mask(text: Column) -> Column:
    """The text, same length, without comments and literals, its dollar bodies hidden.

    Comments nest to any depth.
    """
    deep = F.size(F.split(text, r"/\*", _NESTING + 2)) > _NESTING + 1
    return F.when(deep, _mask_by_walk(text)).otherwise(_mask_by_pattern(text))


def unhide(text: Column) -> Column:
    return F.translate(text, _HIDDEN, _PLAIN)


def statement_length(text: Column) -> Column:
    """Length up to the first semicolon outside parentheses."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        ends = acc["done"] | ((token == ";") & (acc["depth"] == 0))
        depth = (
            F.when(token == "(", acc["depth"] + 1)
            .when(token == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        return F.struct(
            depth.alias("depth"),
            F.when(ends, acc["length"]).otherwise(acc["length"] + F.length(token)).alias("length"),
            ends.alias("done"),
        )

    tokens = F.regexp_extract_all(text, F.lit(r"[();]|[^();]++"), F.lit(0))
    return F.aggregate(tokens, start, step)["length"]


# --- objects -----------------------------------------------------------------

_ANY_HEADER = pattern("(?i)(?:" + "|".join(HEADERS.values()) + ")")


def _headers() -> Column:
    rows = [(kind, pattern("(?i)^" + regex)) for kind, regex in HEADERS.items()]
    return rule_rows("kind regex", rows)


def objects(files: DataFrame, default_dialect: str = "mssql") -> DataFrame:
    """Statements with their body up to their own semicolon."""
    rows = select_files(files, None, (".sql",)).where(
        owner(F.col("content"), default_dialect) == EXTRACTOR
    )
    masked = rows.select("repo", "path", "walk", mask(F.col("content")).alias("masked"))
    cut = masked.select(
        "repo", "path", "walk", F.posexplode(segments(F.col("masked"), _ANY_HEADER)).alias("i", "s")
    ).select("repo", "path", "walk", "i", F.col("s.text").alias("text"), F.col("s.line").alias("line"))
    text, regex = F.col("text"), F.col("header.regex")
    header = F.get(F.filter(_headers(), lambda h: F.rlike(text, h["regex"])), F.lit(0))
    found = cut.withColumn("header", header).where("header.kind <> 'boundary'")
    is_trigger = F.col("header.kind") == "sql_trigger"
    is_materialized = F.col("header.kind") == "materialized"

    def group(of_trigger: int, of_others: int) -> Column:
        return F.when(is_trigger, extract_group(text, regex, of_trigger)).otherwise(
            extract_group(text, regex, of_others)
        )

    # Of a trigger, group 1 is its own name and groups 2 and 3 are the table, whose schema it takes.
    schema = group(2, 1)
    parsed = found.select(
        "repo", "path", "walk", "i", "line",
        F.when(is_materialized, "sql_view").otherwise(F.col("header.kind")).alias("kind"),
        is_materialized.alias("materialized"),
        F.when(schema == "", F.lit(DEFAULT_SCHEMA)).otherwise(schema).alias("schema"),
        group(1, 2).alias("name"),
        F.when(is_trigger, extract_group(text, regex, 3)).alias("on_table"),
        F.substring(text, F.length(extract_group(text, regex, 0)) + 1, F.length(text)).alias("rest"),
    )
    rest = F.col("rest")
    return S.with_ids(
        parsed.withColumn("body", unhide(F.substring(rest, F.lit(1), statement_length(rest))))
        .withColumn("on_schema", F.when(F.col("kind") == "sql_trigger", F.col("schema")))
        .withColumn("ord", order_key(F.col("walk"), F.col("i")))
        .drop("rest")
    )


# --- references --------------------------------------------------------------

_REF = "array<struct<relation:string,confidence:string,context:string,t_kind:string,t_schema:string,t_name:string>>"


def _body_rules() -> Column:
    fk = (FOREIGN_KEY, "depends_on_object", "sql_table", False)
    fires = (TRIGGER_EXEC, "depends_on_object", "sql_function", False)
    scans = [("alter", *fk, "INFERRED", "foreign key"), ("sql_trigger", *fires, "EXTRACTED", "")]
    for kind, items in BODY_RULES.items():
        scans += [(kind, *item, "INFERRED", "") for item in items]
    rows = [
        # Group 3 sees whether the name is followed by an argument list.
        (kind, pattern(regex) + r"(?=([ \t\r\n]*\()?)", regex == FROM, regex == TRIGGER_EXEC, *rest)
        for kind, regex, *rest in scans
    ]
    return rule_rows("kind regex reads once relation target skip_calls confidence context", rows)


def _references() -> Column:
    """All references in a body, in rule order."""
    ctes = F.transform(
        F.regexp_extract_all(F.col("body"), F.lit(pattern(CTE_NAME)), F.lit(1)), lambda n: F.lower(n)
    )
    # The FROM of DELETE FROM is a write, not a read.
    reads = F.regexp_replace("body", pattern(DELETE_FROM), "DELETE")
    mine = F.filter(_body_rules(), lambda r: r["kind"] == F.col("kind"))

    def apply(rule: Column) -> Column:
        found = matches(F.when(rule["reads"], reads).otherwise(F.col("body")), rule["regex"], 1, 2, 3)
        found = F.when(rule["once"], F.slice(found, 1, 1)).otherwise(found)
        is_scan = (rule["context"] == "") & ~rule["once"]
        usable = F.filter(
            found,
            lambda m: (m["g2"] != "")
            & ~F.lower(m["g2"]).isin(*SKIP_NAMES)
            & ~(rule["skip_calls"] & (m["g3"] != ""))
            & ~(is_scan & (m["g1"] == "") & F.array_contains(ctes, F.lower(m["g2"]))),
        )
        return F.transform(
            usable,
            lambda m: F.struct(
                rule["relation"].alias("relation"),
                rule["confidence"].alias("confidence"),
                F.when(rule["context"] != "", rule["context"]).alias("context"),
                rule["target"].alias("t_kind"),
                F.when(m["g1"] == "", F.lit(DEFAULT_SCHEMA)).otherwise(m["g1"]).alias("t_schema"),
                m["g2"].alias("t_name"),
            ),
        ).cast(_REF)

    return F.flatten(F.transform(mine, apply))


def references(found: DataFrame) -> DataFrame:
    """Dependency edges, the same edge once per repository."""
    kinds = ("alter", *BODY_RULES)
    source = F.when(
        F.col("kind") == "alter", S.object_id("sql_table", F.col("schema"), F.col("name"))
    ).otherwise(F.col("source"))
    refs = (
        found.where(F.col("kind").isin(*kinds))
        .withColumn("source", source)
        .select(
            "repo", "path", "ord", "source",
            F.posexplode(_references()).alias("r", "ref"),
        )
        .select(
            "repo", "path",
            F.concat("ord", F.lit("\u0000"), F.lpad((F.col("r") + 1).cast("string"), 19, "0")).alias("ord"),
            "source", "ref.*", F.lit(None).cast("string").alias("source_location"),
        )
    )
    fired = found.where("kind = 'sql_trigger'").select(
        "repo", "path", F.concat("ord", F.lit("\u0000"), F.lpad(F.lit("0"), 19, "0")).alias("ord"), "source",
        F.lit("triggers_on").alias("relation"), F.lit("EXTRACTED").alias("confidence"),
        F.lit(None).cast("string").alias("context"), F.lit("sql_table").alias("t_kind"),
        F.col("on_schema").alias("t_schema"), F.col("on_table").alias("t_name"),
        location(F.col("line")).alias("source_location"),
    )
    return (
        refs.unionByName(fired)
        .withColumn("target", S.object_id(F.col("t_kind"), F.col("t_schema"), F.col("t_name")))
        .where(F.col("source") != F.col("target"))
    )


def _once(edges: DataFrame) -> DataFrame:
    """The first of identical edges in a repository."""
    keys = ["repo", "relation", "source", "target"]
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("e")).select(*keys, "e.*")


def extract(files: DataFrame, default_dialect: str = "mssql") -> Fragments:
    # Statements are cut once; references, nodes and edges come from the written rows.
    found = cut_lineage(objects(files, default_dialect))
    made = found.where("kind <> 'alter'")
    refs = cut_lineage(references(found))
    nodes = S.object_nodes(made).unionByName(S.target_nodes(refs), allowMissingColumns=True)
    # An altered table is declared only when it gained a foreign key.
    altered = refs.where("context = 'foreign key'").select(
        "repo", "ord", F.col("source").alias("target"), F.lit("sql_table").alias("t_kind"),
        F.regexp_extract("source", r"^sql::sql_table::([^.]*)\.", 1).alias("t_schema"),
        F.regexp_extract("source", r"^sql::sql_table::[^.]*\.([\s\S]*)$", 1).alias("t_name"),
    )
    nodes = nodes.unionByName(S.target_nodes(altered), allowMissingColumns=True)
    edges = S.schema_edges(made).unionByName(S.reference_edges(refs), allowMissingColumns=True)
    return Fragments(emit_nodes(nodes, EXTRACTOR), emit_edges(_once(edges), EXTRACTOR))
