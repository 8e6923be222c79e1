"""Comment stripping per language, by one token pattern each.

A token is a comment, a string, or other text; comments shrink to their line
breaks, so the lines of a file keep their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators.extract.common import rule_rows, select_files

_DOUBLE = r'"[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+(?:"|\\(?=\n|\z))?'
_SINGLE = r"'[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+(?:'|\\(?=\n|\z))?"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
_RAW_LINE = r"`[^`\n]*+`?"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\z)"
_PAREN_BLOCK = r"\(\*[\s\S]*?(?:\*\)|\z)"
_SLASHES = r"//[^\n]*+"
_HASH = r"#[^\n]*+"
_QUOTE = r"'[^\n]*+"


def _tokens(comments, strings, special: str) -> tuple[str, str]:
    """(token pattern, comment pattern); ``special`` are the characters a token may start with."""
    parts = [*comments, *strings, f"[^{special}]++", f"[{special}]"]
    return "|".join(parts), "^(?:" + "|".join(comments) + ")$"


# --- Fixed values: comment and string forms per extension ---
SYNTAXES = (
    ((".go",), *_tokens((_BLOCK, _SLASHES), (_DOUBLE, _RAW_LINE), r"/\"`")),
    ((".java", ".kt", ".kts", ".cs"), *_tokens((_BLOCK, _SLASHES), (_DOUBLE, _SINGLE), r"/\"'")),
    ((".js", ".jsx", ".ts", ".tsx", ".mjs"), *_tokens((_BLOCK, _SLASHES), (_DOUBLE, _SINGLE, _TEMPLATE), r"/\"'`")),
    ((".py", ".rb"), *_tokens((_HASH,), (_DOUBLE, _SINGLE), r"#\"'")),
    ((".php",), *_tokens((_BLOCK, _SLASHES, _HASH), (_DOUBLE, _SINGLE), r"/#\"'")),
    ((".vb",), *_tokens((_QUOTE,), (_DOUBLE,), r"'\"")),
    ((".fs",), *_tokens((_PAREN_BLOCK, _SLASHES), (_DOUBLE,), r"(/\"")),
)

HTTP_EXTENSIONS = tuple(e for syntax in SYNTAXES for e in syntax[0])


def strip_comments(text: Column, ext: Column) -> Column:
    """Code of a text under the syntax of its extension."""
    mine = F.get(
        F.filter(rule_rows("extensions token comment", SYNTAXES), lambda s: F.array_contains(s["extensions"], ext)),
        F.lit(0),
    )

    def keep(token: Column) -> Column:
        breaks = F.regexp_replace(token, r"[^\n]", "")
        # Of a template literal only the part on its first line can hold a route.
        opening = F.concat(F.regexp_extract(token, r"^[^\n]*", 0), breaks)
        is_template = token.startswith("`") & token.contains("\n")
        return (
            F.when(F.rlike(token, mine["comment"]), breaks).when(is_template, opening).otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, mine["token"], F.lit(0)), keep), "")


def code_files(files: DataFrame) -> DataFrame:
    """Source files of the HTTP extractor with their comment-free code."""
    rows = select_files(
        files, None, HTTP_EXTENSIONS, rules.SKIP_DIRS + rules.HTTP_SKIP_DIRS, skip_tests=True
    )
    code = strip_comments(F.col("content"), F.col("ext"))
    return rows.select("repo", "path", "walk", "ext", F.regexp_replace(code, r"\r(?=\n|\z)", "").alias("code"))


def code_lines(files: DataFrame) -> DataFrame:
    """Comment-free lines: ``repo, path, walk, ext, line, text``."""
    return to_lines(code_files(files))


def to_lines(code: DataFrame) -> DataFrame:
    keep = [c for c in code.columns if c != "code"]
    return code.select(*keep, F.posexplode(F.split("code", "\n")).alias("i", "text")).select(
        *keep, (F.col("i") + 1).alias("line"), "text"
    )
