"""HTTP routes from code: literal matchers, Go constants and groups, Spring prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.extract.common import matches, pattern, rule_rows, warn
from loomgraph.operators.extract.lexing import code_files, to_lines
from loomgraph.session import cut_lineage

EXTRACTOR = "httpapi"

# --- Fixed values: extensions per language family ---
GO = (".go",)
PYTHON = (".py",)
JS = (".js", ".jsx", ".ts", ".tsx", ".mjs")
JVM = (".java", ".kt", ".kts")
DOTNET = (".cs", ".fs", ".vb")
RUBY = (".rb",)
PHP = (".php",)

# --- Fixed values: framework patterns ---
CHI = r'\b\w+\.(Get|Post|Put|Delete|Patch|Options|Head|Connect|Trace)\s*\(\s*"([^"]+)"(?:\s*,\s*([A-Za-z0-9_.]+))?'
GORILLA = r'\.HandleFunc\s*\(\s*"([^"]+)"\s*,\s*([A-Za-z0-9_.]+)\)\s*\.Methods\s*\(\s*"([A-Z]+)"'
NET_HTTP = r'http\.HandleFunc\s*\(\s*"([^"]+)"\s*,\s*([A-Za-z0-9_.]+)'
FLASK = (
    r"""@\w+\.(?:route|get|post|put|delete|patch|head|options)\s*\(\s*["']([^"']+)["']"""
    r"""(?:\s*,\s*methods\s*=\s*\[([^\]]+)\])?"""
)
FASTAPI_METHOD = r"@\w+\.(get|post|put|delete|patch|head|options)\s*\("
DJANGO = r"""(?:^|\s)(?:re_)?path\s*\(\s*r?["']([^"']+)["']\s*,\s*([A-Za-z0-9_.]+)"""
EXPRESS = (
    r"""\b(?:app|router|api)\.(get|post|put|delete|patch|head|options|all|use)\s*\(\s*["'`]([^"'`]+)["'`]"""
)
SPRING = r'@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*\(\s*(?:value\s*=\s*)?"([^"]+)"'
ASPNET_VERB = r'\[(?:Http(Get|Post|Put|Delete|Patch|Head|Options))(?:\s*\(\s*"([^"]+)")?\s*\]'
ASPNET_ROUTE = r'\[Route\s*\(\s*"([^"]+)"'
RAILS = r"""^\s*(get|post|put|delete|patch|head|options|match)\s+["']([^"']+)["']"""
LARAVEL = r"""Route::(get|post|put|delete|patch|head|options|any)\s*\(\s*["']([^"']+)["']"""
REQUEST_MAPPING = (
    r'@RequestMapping\s*\(\s*(?:value\s*=\s*)?"([^"]+)"(?:[^)]*method\s*=\s*RequestMethod\.([A-Z]+))?'
)
CLASS_DECLARATION = r"\b(?:class|interface|record|object)\s+\w+"
GO_CONST = r"^\s*(?:var\s+|const\s+)?([A-Za-z_]\w*)(?:\s+[A-Za-z_][\w.\[\]]*)?\s*=\s*([^\n]+)$"
GO_LOCAL = r"^\s*([A-Za-z_]\w*)\s*:=\s*([^\n]+)$"
GO_GROUP = r'\b([A-Za-z_]\w*)\s*:?=\s*([A-Za-z_]\w*)\.Group\s*\(\s*([A-Za-z_][\w.]*|"[^"]*")'
GO_ROUTE = (
    r'\b([A-Za-z_]\w*)\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any)\s*\(\s*([A-Za-z_][\w.]*|"[^"]*")'
    r"\s*(?:,\s*([A-Za-z0-9_.]+))?"
)
GO_WRAPPED = (
    r"\.(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Get|Post|Put|Delete|Patch|Options|Head|Group|Handle"
    r"|HandleFunc)\s*\(\s*$"
)
# --- Fixed values: how far a wrapped call is followed unless told otherwise ---
WRAP_MAX_LINES = 10
WRAP_MAX_CHARS = 4096

_PART = r'"(?:\\.|[^"\\])*"|`[^`]*`|[A-Za-z_][\w.]*'
_CONCAT = rf"^\s*(?:{_PART})\s*(?:\+\s*(?:{_PART})\s*)*$"


def join_prefix(prefix: Column, path: Column) -> Column:
    """A group or class prefix followed by a path, one slash between."""
    joined = F.concat(
        F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(F.trim(path), "^/+", "")
    )
    return F.when(prefix == "", path).otherwise(joined)


# --- literal matchers (C9) ---------------------------------------------------

# (extensions, pattern, groups of method / path / handler, fixed method, every match of a line)
_LITERALS = (
    (GO, CHI, (1, 2, 3), "", True),
    (GO, GORILLA, (3, 1, 2), "", False),
    (GO, NET_HTTP, (0, 1, 2), "ANY", False),
    (PYTHON, DJANGO, (0, 1, 2), "ANY", False),
    (JS, EXPRESS, (1, 2, 0), "", False),
    (JVM, SPRING, (1, 2, 0), "", False),
    (RUBY, RAILS, (1, 2, 0), "", False),
    (PHP, LARAVEL, (1, 2, 0), "", False),
)
_ANY_ROUTE = "|".join(
    f"(?:{p})" for p in (CHI, GORILLA, NET_HTTP, FLASK, DJANGO, EXPRESS, SPRING, ASPNET_VERB, ASPNET_ROUTE, RAILS, LARAVEL)
)
_ROUTES = "array<struct<method:string,path:string,handler:string>>"
# --- Fixed values: verbs that stand for every method ---
_ANY_VERBS = ("ALL", "USE", "MATCH", "ANY")


def _pick(groups: Column, which: Column) -> Column:
    return F.when(which > 0, F.get(groups, which - 1)).otherwise("")


def literal_routes(lines: DataFrame) -> DataFrame:
    """Routes whose path is a literal on the line."""
    text = F.col("text")
    table = rule_rows(
        "extensions regex method path handler fixed every",
        [(e, pattern(r), *g, fixed, every) for e, r, g, fixed, every in _LITERALS],
    )
    mine = F.filter(table, lambda r: F.array_contains(r["extensions"], F.col("ext")))

    def apply(rule: Column) -> Column:
        # A pattern has two or three groups; asking for a third one it lacks is an error.
        wide = F.greatest(rule["method"], rule["path"], rule["handler"]) > 2
        two = matches(text, rule["regex"], 1, 2)
        third = F.when(wide, F.call_function("regexp_extract_all", text, rule["regex"], F.lit(3)))
        found = F.transform(
            two, lambda m, i: F.array(m["g1"], m["g2"], F.coalesce(F.get(third, i), F.lit("")))
        )
        found = F.when(rule["every"], found).otherwise(F.slice(found, 1, 1))

        def route(groups: Column) -> Column:
            verb = F.upper(
                F.when(rule["fixed"] != "", rule["fixed"]).otherwise(
                    F.regexp_replace(_pick(groups, rule["method"]), "Mapping$", "")
                )
            )
            return F.struct(
                F.when(verb.isin(*_ANY_VERBS), "ANY").otherwise(verb).alias("method"),
                _pick(groups, rule["path"]).alias("path"),
                _pick(groups, rule["handler"]).alias("handler"),
            )

        routes = F.transform(found, route).cast(_ROUTES)
        # Lower-case verbs are common in other Go code: there a route starts with a slash.
        return F.when(rule["every"], F.filter(routes, lambda r: r["path"].startswith("/"))).otherwise(routes)

    # Two frameworks need more than a pattern.
    flask_methods = F.regexp_extract(text, FLASK, 2)
    flask_verb = (
        F.when(flask_methods != "", F.upper(F.btrim(F.split_part(flask_methods, F.lit(","), F.lit(1)), F.lit("' \""))))
        .when(text.rlike(FASTAPI_METHOD), F.upper(F.regexp_extract(text, FASTAPI_METHOD, 1)))
        .otherwise("GET")
    )

    def one(test: Column, method: Column, path: Column) -> Column:
        row = F.struct(method.alias("method"), path.alias("path"), F.lit("").alias("handler"))
        return F.when(test, F.array(row)).otherwise(F.array().cast(_ROUTES)).cast(_ROUTES)

    verb_path = F.regexp_extract(text, ASPNET_VERB, 2)
    has_verb = text.rlike(ASPNET_VERB)
    dotnet = F.when(
        has_verb,
        one(F.lit(True), F.upper(F.regexp_extract(text, ASPNET_VERB, 1)), F.when(verb_path == "", "/").otherwise(verb_path)),
    ).otherwise(one(text.rlike(ASPNET_ROUTE), F.lit("ANY"), F.regexp_extract(text, ASPNET_ROUTE, 1)))
    empty = F.array().cast(_ROUTES)
    special = (
        F.when(F.col("ext").isin(*PYTHON), one(text.rlike(FLASK), flask_verb, F.regexp_extract(text, FLASK, 1)))
        .when(F.col("ext").isin(*DOTNET), dotnet)
        .otherwise(empty)
    )
    found = lines.where(text.rlike(pattern(_ANY_ROUTE))).select(
        *[c for c in lines.columns if c != "text"],
        F.explode(F.concat(F.flatten(F.transform(mine, apply)), special)).alias("r"),
    )
    return found.select(*[c for c in found.columns if c != "r"], "r.*")


# --- wrapped Go calls (C11) ---------------------------------------------------


def _paren_delta(text: Column) -> Column:
    code = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?|`[^`]*+`?', "")
    return F.length(F.regexp_replace(code, r"[^(]", "")) - F.length(F.regexp_replace(code, r"[^)]", ""))


def wrapped_calls(
    files_code: DataFrame, max_lines: int | None = WRAP_MAX_LINES, max_chars: int | None = WRAP_MAX_CHARS
) -> DataFrame:
    """Registrations spread over lines, joined into one: ``line`` is where they start.

    A call that is not closed is followed up to a number of lines and
    characters, to the end of the file with None.  A fold over the lines of a file that holds the open call; only files with a
    call opened at a line end are folded.
    """
    lines = F.transform(
        F.split("code", "\n"),
        lambda text, i: F.struct(
            text.alias("text"), (i + 1).alias("line"), _paren_delta(text).alias("delta"),
            text.rlike(GO_WRAPPED).alias("opens"),
        ),
    )
    out_type = "array<struct<line:int,text:string>>"
    state = f"struct<carry:string,start:int,depth:int,out:{out_type}>"
    start = F.struct(
        F.lit("").alias("carry"), F.lit(0).alias("start"), F.lit(0).alias("depth"),
        F.array().cast(out_type).alias("out"),
    ).cast(state)

    def step(acc: Column, row: Column) -> Column:
        carrying = acc["carry"] != ""
        joined = F.concat(acc["carry"], F.lit(" "), F.trim(row["text"]))
        depth = acc["depth"] + row["delta"]
        closes = carrying & (
            (depth <= 0)
            | (F.lit(False) if max_lines is None else row["line"] - acc["start"] >= max_lines)
            | (F.lit(False) if max_chars is None else F.length(joined) > max_chars)
        )
        done = F.struct(acc["start"].alias("line"), joined.alias("text"))
        opens = ~carrying & row["opens"]
        return F.struct(
            F.when(closes, "").when(carrying, joined).when(opens, row["text"]).otherwise("").alias("carry"),
            F.when(opens, row["line"]).otherwise(acc["start"]).alias("start"),
            F.when(opens, row["delta"]).when(carrying, depth).otherwise(0).alias("depth"),
            F.when(closes, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["start"].alias("line"), acc["carry"].alias("text"))
        return F.when(acc["carry"] != "", F.concat(acc["out"], F.array(rest))).otherwise(acc["out"])

    wrapped = files_code.where(F.col("ext").isin(*GO) & F.col("code").rlike("(?m)" + GO_WRAPPED))
    return wrapped.select(
        "repo", "path", "walk", "ext", F.explode(F.aggregate(lines, start, step, finish)).alias("w")
    ).select("repo", "path", "walk", "ext", "w.line", "w.text")


# --- Go constants, groups and identifier routes (C11) ---------------------------


def _string_expressions(lines: DataFrame, regex: str) -> DataFrame:
    """Declarations whose right side is built of string literals and names."""
    found = lines.where(F.col("text").rlike(regex)).select(
        "repo", "path", "walk", "line",
        F.regexp_extract("text", regex, 1).alias("name"),
        F.trim(F.regexp_extract("text", regex, 2)).alias("value"),
    )
    parts = F.regexp_extract_all(F.col("value"), F.lit(_PART), F.lit(0))
    return found.where(F.col("value").rlike(_CONCAT)).withColumn("parts", parts)


def _last_name(identifier: Column) -> Column:
    return F.substring_index(identifier, ".", -1)


def resolve_names(names: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """Values of (repo, path, name); null where a name does not become a string.

    Each round replaces the names still open by the parts of their declaration,
    the file's own first; literals stay put with their position, so the value is
    assembled once at the end.  Names resolve to any depth; one that leads back to
    itself does not become a string.
    """
    keys = ["repo", "path", "name"]
    first_local = local.groupBy(*keys).agg(F.min_by("parts", "line").alias("local_parts"))
    first_shared = shared.groupBy("repo", "name").agg(
        F.min_by("parts", F.struct("walk", "line")).alias("shared_parts")
    )
    scope = first_local.select("repo", "path", F.col("name").alias("open"), "local_parts")
    package = first_shared.select("repo", F.col("name").alias("open"), "shared_parts")
    open_names = cut_lineage(
        names.select(*keys).distinct().select(
            *keys, F.col("name").alias("open"), F.array().cast("array<int>").alias("pos"), F.array("name").alias("seen")
        )
    )
    pieces: list[DataFrame] = []
    while not open_names.isEmpty():
        expanded = (
            open_names.join(scope, ["repo", "path", "open"], "left")
            .join(package, ["repo", "open"], "left")
            .withColumn("parts", F.coalesce("local_parts", "shared_parts"))
        )
        expanded = cut_lineage(
            expanded.select(*keys, "pos", "seen", F.posexplode_outer("parts").alias("i", "part"))
        )
        literal = F.col("part").rlike('^["`]')
        # A name among those it came from is a cycle: its text is missing.
        again = ~literal & F.array_contains("seen", _last_name(F.col("part")))
        position = F.concat("pos", F.array("i"))
        pieces.append(
            expanded.where(F.col("part").isNull() | literal | again).select(
                *keys,
                F.when(F.col("part").isNull(), F.col("pos")).otherwise(position).alias("pos"),
                F.when(literal, F.expr("substring(part, 2, length(part) - 2)")).alias("text"),
            )
        )
        following = _last_name(F.col("part"))
        open_names = expanded.where(~literal & ~again).select(
            *keys, following.alias("open"), position.alias("pos"), F.concat("seen", F.array(following)).alias("seen")
        )
    # Without any name the table is empty.
    pieces.append(open_names.select(*keys, "pos", F.lit(None).cast("string").alias("text")))
    rows = reduce(DataFrame.unionByName, pieces)
    values = rows.groupBy(*keys).agg(
        F.count(F.when(F.col("text").isNull(), True)).alias("missing"),
        # The parts of one constant expression.
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"),
    )
    value = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    usable = (F.col("missing") == 0) & ~value.rlike(r"[ \t]") & ~value.contains("://")
    return values.select(*keys, F.when(usable, value).alias("value"))


def _argument(df: DataFrame, values: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the value of a call argument: a literal, or a resolved name."""
    literal = F.col(column).startswith('"')
    named = df.withColumn("name", F.when(~literal, _last_name(F.col(column))))
    joined = named.join(values.withColumnRenamed("value", "_value"), ["repo", "path", "name"], "left")
    return joined.withColumn(
        out, F.when(literal, F.btrim(F.col(column), F.lit('"'))).otherwise(F.col("_value"))
    ).drop("name", "_value")


def identifier_routes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upper-case-verb registrations with their group prefix, and warnings for the unresolved."""
    groups = lines.where(F.col("text").rlike(pattern(GO_GROUP))).groupBy(
        "repo", "path", F.regexp_extract("text", pattern(GO_GROUP), 1).alias("var")
    ).agg(
        F.max_by(
            F.struct(
                F.regexp_extract("text", pattern(GO_GROUP), 2).alias("recv"),
                F.regexp_extract("text", pattern(GO_GROUP), 3).alias("arg"),
            ),
            "line",
        ).alias("g")
    ).select("repo", "path", "var", "g.recv", "g.arg")
    calls = lines.where(F.col("text").rlike(pattern(GO_ROUTE))).select(
        "repo", "path", "walk", "line",
        F.posexplode(matches(F.col("text"), pattern(GO_ROUTE), 1, 2, 3, 4)).alias("n", "m"),
    ).select(
        "repo", "path", "walk", "line", "n", F.col("m.g1").alias("var"), F.col("m.g2").alias("method"),
        F.col("m.g3").alias("arg"), F.col("m.g4").alias("handler"),
    )
    calls, groups = cut_lineage(calls), cut_lineage(groups)

    def wanted(df):
        return df.where(~F.col("arg").startswith('"')).select(
            "repo", "path", _last_name(F.col("arg")).alias("name")
        )

    values = cut_lineage(
        resolve_names(
            wanted(calls).unionByName(wanted(groups)),
            _string_expressions(lines, GO_LOCAL),
            _string_expressions(lines, GO_CONST),
        )
    )
    prefixes = group_prefixes(_argument(groups, values, "arg", "value"))
    routed = _argument(calls, values, "arg", "value").join(
        prefixes, ["repo", "path", "var"], "left"
    ).withColumn("prefix", F.coalesce("prefix", F.lit("")))
    own_path = F.when(F.col("prefix") == "", "/").otherwise(F.col("prefix"))
    full = F.when(F.col("value") == "", own_path).otherwise(join_prefix(F.col("prefix"), F.col("value")))
    routes = routed.where(F.col("value").isNotNull()).select(
        "repo", "path", "walk", "line", F.upper("method").alias("method"), full.alias("route"), "handler"
    )
    dropped = routed.where(F.col("value").isNull())
    warnings = warn(
        dropped, EXTRACTOR,
        F.format_string(
            '%s:%d: %s route with path identifier "%s" dropped: does not resolve to a string constant',
            "path", "line", "method", "arg",
        ),
    )
    return routes, warnings


def group_prefixes(groups: DataFrame) -> DataFrame:
    """Full prefix of each group variable of a file, by following receivers upwards.

    Pointer doubling: every round a group takes over what its receiver has
    gathered, so a chain of n groups needs log2 n rounds.  A group that is its own
    ancestor takes each group of the cycle once.
    """
    keys = ["repo", "path", "var"]
    chains = cut_lineage(
        groups.select(
            *keys, "recv", F.array("var").alias("seen"), F.array(F.coalesce("value", F.lit(""))).alias("args")
        )
    )
    while True:
        up = chains.select(
            "repo", "path", F.col("var").alias("recv"), F.col("recv").alias("next"),
            F.col("seen").alias("up_seen"), F.col("args").alias("up_args"),
        )
        # The first group of the receiver's chain that this chain holds already, 0 if none.
        known = F.array_position(F.transform("up_seen", lambda v: F.array_contains("seen", v)), True)
        joined = chains.join(up, ["repo", "path", "recv"], "left").withColumn("known", known)
        joined = joined.withColumn("taken", F.when(F.col("known") == 0, F.size("up_seen")).otherwise(F.col("known") - 1).cast("int"))
        moved, taken = F.col("up_seen").isNotNull(), F.col("taken")
        chains = cut_lineage(
            joined.select(
                *keys,
                F.when(moved & (F.col("known") == 0), F.col("next")).alias("recv"),
                F.when(moved, F.concat("seen", F.slice("up_seen", 1, taken))).otherwise(F.col("seen")).alias("seen"),
                F.when(moved, F.concat("args", F.slice("up_args", 1, taken))).otherwise(F.col("args")).alias("args"),
            )
        )
        if chains.where("recv IS NOT NULL").isEmpty():
            break
    prefix = F.aggregate(F.reverse("args"), F.lit(""), lambda acc, arg: join_prefix(acc, arg))
    return chains.select(*keys, prefix.alias("prefix"))


# --- Spring (C12) --------------------------------------------------------------


def spring_routes(lines: DataFrame) -> DataFrame:
    """Routes of JVM files with their class prefix.

    A bare mapping annotation waits for the next declaration: a class makes it
    the prefix of what follows, anything else makes it a route.  Windows run
    over the lines of one file, which its size limit bounds.
    """
    text = F.col("text")
    trimmed = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    waits = (trimmed == "") | trimmed.rlike(r"^(//|\*|/\*|@)")
    mapping = text.rlike(REQUEST_MAPPING)
    is_class = text.rlike(pattern(CLASS_DECLARATION))
    marked = lines.where(trimmed != "").select(
        "repo", "path", "walk", "ext", "line", F.when(text.contains("Mapping"), text).otherwise("").alias("text"),
        (~waits).alias("declares"), is_class.alias("is_class"), mapping.alias("maps"),
        (mapping & ~is_class).alias("pends"),
        F.regexp_extract(text, REQUEST_MAPPING, 1).alias("m_path"),
        F.regexp_extract(text, REQUEST_MAPPING, 2).alias("m_method"),
    )
    relevant = marked.where("maps OR declares OR text <> ''")
    order = Window.partitionBy("repo", "path").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pend = F.when(F.col("pends"), F.struct("line", "m_path", "m_method"))
    stated = (
        relevant.withColumn("pending", F.last(pend, ignorenulls=True).over(before))
        .withColumn("previous", F.last(F.when(F.col("declares"), F.col("line")), ignorenulls=True).over(before))
    )
    resolved = F.col("declares") & F.col("pending").isNotNull() & (
        F.col("pending.line") >= F.coalesce("previous", F.lit(0))
    )
    stated = stated.withColumn("resolves", F.coalesce(resolved, F.lit(False)))
    event = (
        F.when(F.col("maps") & F.col("is_class"), F.col("m_path"))
        .when(F.col("resolves") & F.col("is_class"), F.col("pending.m_path"))
    )
    prefixed = stated.withColumn("prefix", F.coalesce(F.last(event, ignorenulls=True).over(order), F.lit("")))
    # The prefix a resolved method mapping sees is the one before its own line's event.
    held = prefixed.where(F.col("resolves") & ~F.col("is_class")).select(
        "repo", "path", "walk", F.col("pending.line").alias("line"),
        F.col("pending.m_path").alias("p"), F.col("pending.m_method").alias("m"), "prefix",
    )
    # A mapping still pending at the end of the file is a route.
    last_row = prefixed.withColumn(
        "is_last", F.lead("line").over(order).isNull()
    ).where("is_last").select(
        "repo", "path", "walk", "prefix",
        F.when(F.col("pends"), F.struct("line", "m_path", "m_method"))
        .when(F.col("resolves"), F.lit(None))
        .when(F.col("declares"), F.lit(None))
        .when(F.col("pending.line") >= F.coalesce("previous", F.lit(0)), F.col("pending"))
        .alias("tail"),
    ).where("tail IS NOT NULL").select(
        "repo", "path", "walk", F.col("tail.line").alias("line"), F.col("tail.m_path").alias("p"),
        F.col("tail.m_method").alias("m"), "prefix",
    )
    mapped = held.unionByName(last_row).select(
        "repo", "path", "walk", "line", F.when(F.col("m") == "", "ANY").otherwise(F.col("m")).alias("method"),
        join_prefix(F.col("prefix"), F.col("p")).alias("route"), F.lit("").alias("handler"),
    )
    verbs = literal_routes(
        prefixed.where(~F.col("maps"))
        .select("repo", F.col("path").alias("file"), "walk", "ext", "line", "text", "prefix")
    ).select(
        "repo", F.col("file").alias("path"), "walk", "line", "method",
        join_prefix(F.col("prefix"), F.col("path")).alias("route"), "handler",
    )
    return mapped.unionByName(verbs)


# --- all code routes -------------------------------------------------------------


def code_routes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every code route ``(repo, path, walk, line, method, route, handler)`` and warnings."""
    code = code_files(files)
    # Only files with a bare mapping annotation need the windows of the prefix rule.
    prefixed = F.col("ext").isin(*JVM) & F.col("code").contains("@RequestMapping")
    wrapped = wrapped_calls(code.where(F.col("ext").isin(*GO)))
    lines = to_lines(code.where(~prefixed))
    # The few lines that matter are written once; literals, constants, groups and
    # registrations are then read from them.
    kept = cut_lineage(lines.where(_matters()).unionByName(wrapped))
    literal = literal_routes(kept.withColumnRenamed("path", "file")).select(
        "repo", F.col("file").alias("path"), "walk", "line", "method", F.col("path").alias("route"), "handler"
    )
    named, warnings = identifier_routes(kept.where(F.col("ext").isin(*GO)))
    spring = spring_routes(to_lines(code.where(prefixed)))
    return literal.unionByName(spring).unionByName(named), warnings


# Literals that every pattern of a language needs, as alternatives that must all be met: plain
# substring tests, which spare most lines the patterns.
_NEEDED = (
    (GO, (("(", "="), ('"', "`", "=", "("))),
    (PYTHON, (("@", "path"), ("(",))),
    (JS, (("app.", "router.", "api."), ("(",))),
    (JVM, (("@",),)),
    (DOTNET, (("[Http", "[Route"),)),
    (RUBY, (('"', "'"),)),
    (PHP, (("Route::",),)),
)


def _candidate() -> Column:
    """Whether a line holds the literals that the patterns of its language need."""
    text, out = F.col("text"), F.lit(False)
    for extensions, needed in _NEEDED:
        held = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [text.contains(x) for x in some]) for some in needed])
        out = out | (F.col("ext").isin(*extensions) & held)
    return out


def _matters() -> Column:
    """Lines that routes are read from: the literals first, then one test of all literal patterns, names only in Go."""
    text, go = F.col("text"), F.col("ext").isin(*GO)
    declares = text.contains("=") & (text.rlike(GO_CONST) | text.rlike(GO_LOCAL))
    registers = text.contains("(") & (text.rlike(pattern(GO_ROUTE)) | text.rlike(pattern(GO_GROUP)))
    return _candidate() & (text.rlike(pattern(_ANY_ROUTE)) | (go & (declares | registers)))
