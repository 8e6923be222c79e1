"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything is counted inside the row, so the plan is a scan and a projection: no
shuffle, no user function.  A word is a run of characters other than
``\\x20 \\x09-\\x0D``.  A null text has no word and fails the base rules; so do
texts of under 50 words and texts of which more than half the words lie in
three-word windows that the text repeats.  Ratios are compared as whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import packed, unpacked

SPACE = r"[\x20\x09-\x0D]"
STOP_WORDS = (
    "the of and to in a is that for was with by on are this be as at or from "
    "der die und das den von zu ist mit für auf ein eine nicht sich dem des auch "
    "le la les de et des un une que en est qui dans du pour pas sur "
    "el los las y se del por con una para su lo como"
).split()


class Rule(NamedTuple):
    """``least <= 1000 * part / whole <= most``; an empty whole passes."""

    name: str
    part: str
    whole: str
    least: int
    most: int


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 20_000),
    Rule("symbols", "n_symbols", "n_words", 0, 200),
    Rule("stop_words", "n_stop_words", "n_words", 10, 1_000),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 400),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice among ``words``.

    Windows are sorted by hash, equal neighbours give the repeated positions, and
    the gaps between those give the words that they cover.
    """
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return _total(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))))

    return _let(_let(F.sort_array(windows), repeated), covered)


def _measures(text: Column) -> Column:
    """Struct of every count that the rules use."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    from_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    from_lines = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        from_words.alias("w"),
        from_lines.alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def _verdict(rules: tuple[Rule, ...], get: Callable[[str], Column]) -> Column:
    """Names of the rules that fail."""
    failed = [
        F.when(
            (get(r.whole) > 0) & ~(1000 * get(r.part)).between(r.least * get(r.whole), r.most * get(r.whole)),
            F.lit(r.name),
        )
        for r in rules
    ]
    return F.array_compact(F.array(*failed))


def judged(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: counts, base verdict, failed rules, verdict."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    parts = {"n_words": "w", "n_repeat_words": "w", "n_stop_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")

    def result(m: Column) -> Column:
        def get(name: str) -> Column:
            return m[parts[name]][name] if name in parts else m[name]

        base = (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))
        failed = _verdict(rules, get)
        return F.struct(
            *[get(n).alias(n) for n in names],
            base.alias("base_failed"),
            F.array_join(failed, ",").alias("failed_rules"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    # One expression, so that a filter on the verdict counts a text once, not once for each count it uses.
    return docs.select(packed(docs, keep), _let(_measures(value), result).alias("result"))


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the rows that the base rules or the table reject."""
    return unpacked(judged(docs, text, None, rules).where("result.kept"))
