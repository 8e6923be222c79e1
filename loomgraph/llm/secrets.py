"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

The base patterns find assignments, access keys and long hex strings.  The method
looks at every other run of ``[A-Za-z0-9+/_=-]`` of 16 characters or more: one
Markov model of character pairs is trained on labelled random strings (the values
the base patterns find in the corpus), one on ordinary identifiers (runs in a
bounded sample of texts without such values).  A run that the first model explains
``LEAST_RATIO`` nats better is a span of kind ``markov``.

Only built-in functions are used.  Matches and the pieces between them come from
the same regular expression, and their lengths give the positions, in code points.
A null text is empty and has no spans.  Spans that begin at one place are ordered by
kind; equal rows have equal spans.  The cost of a text grows as its length, however
many matches it holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.rows import packed

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO = 10.0
MOST_IDENTIFIER_TEXTS = 2_000
#: Matches whose positions are summed together.
BLOCK = 64
_SCALE = 1000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _span(at: Column, size: Column, kind: int, value: Column) -> Column:
    return F.struct(at.alias("start"), F.lit(kind).alias("rank"), (at + size).alias("end"), value.alias("value"))


def _prefixes(sizes: Column) -> Column:
    """Sum of the sizes before each, and of all; a fold that copies its sums, so for short arrays."""
    none = F.array(F.lit(0))
    return F.aggregate(sizes, none, lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _spans(text: Column, pattern: str, kind: int, value: Column | None = None) -> Column:
    """(start, rank of the kind, end, value) of every match; ``value`` lists the matches' values (whole matches by default).

    Positions are running sums over blocks of ``BLOCK`` matches, then over the blocks.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column, pieces: Column, values: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(F.get(pieces, i)) + F.length(x))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))

        def joined(sums: Column, heads: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                at = F.get(heads, block) + F.get(F.get(sums, block), i % BLOCK) + F.length(F.get(pieces, i))
                return _span(at, F.length(x), kind, F.get(values, i))

            return F.transform(m, one).cast(_SPANS)

        return _let(F.transform(blocks, _prefixes), lambda sums: _let(_prefixes(F.transform(sums, lambda s: F.element_at(s, -1))), lambda heads: joined(sums, heads)))

    def found(m: Column) -> Column:
        both = F.struct(F.split(text, pattern, -1).alias("pieces"), (m if value is None else value).alias("values"))
        return F.when(F.size(m) > 0, _let(both, lambda b: placed(m, b["pieces"], b["values"]))).otherwise(F.array().cast(_SPANS))

    return _let(matches, found)


def _apart(runs: Column, base: Column) -> Column:
    """The runs (ordered, disjoint) that no base span overlaps.

    A run overlaps as many base spans as begin before its end, less those that
    end by its start.  Both counts are places in sorted arrays of ends and starts.
    """

    def before(own: str, its: str, last: int) -> Column:
        places = F.sort_array(F.concat(F.transform(runs, lambda r: r[own] * 2 + last), F.transform(base, lambda b: b[its] * 2 + (1 - last))))
        mine = F.filter(F.transform(places, lambda x, i: F.when(x % 2 == last, i)), lambda i: i.isNotNull())
        return F.transform(mine, lambda i, j: i - j)

    counts = F.struct(before("end", "start", 0).alias("begun"), before("start", "end", 1).alias("ended"))
    return _let(counts, lambda c: F.filter(runs, lambda r, j: F.get(c["begun"], j) == F.get(c["ended"], j)))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, by start and then by kind."""
    assign = _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 8)
    return F.sort_array(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _pairs(df: DataFrame, value: str) -> DataFrame:
    """(pair, n): how often a character pair stands in the strings of an array column."""
    one = df.select(F.explode(value).alias("v"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, F.lit(2))))
    return one.where(F.length("v") > 1).select(pair.alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most_texts: int = MOST_IDENTIFIER_TEXTS) -> list[int]:
    """Log-likelihood ratio of every pair of ASCII characters, random over identifier, in thousandths.

    Random strings are all values of base spans.  Identifiers are the runs of
    the texts that have none, among the ``most_texts`` first ids by hash.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    spans = docs.select(F.transform(base_spans(value), lambda s: s["value"]).alias("v"))
    random = dict(_pairs(spans.where(F.size("v") > 0), "v").collect())
    place = F.xxhash64(F.col(f"`{doc_id}`").cast("string"))
    first = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(place.alias("place")).distinct().orderBy("place").limit(most_texts)
    last = first.agg(F.max("place")).first()[0]
    sample = docs.where(place <= last) if last is not None else docs.limit(0)
    sample = sample.where(F.size(base_spans(value)) == 0).select(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)).alias("v"))
    ordinary = dict(_pairs(sample, "v").collect())

    def logs(counts: dict[str, int]) -> dict[str, float]:
        out = {}
        for a in ALPHABET:
            total = sum(counts.get(a + b, 0) for b in ALPHABET) + len(ALPHABET)
            out.update({a + b: math.log((counts.get(a + b, 0) + 1) / total) for b in ALPHABET})
        return out

    p, q = logs(random), logs(ordinary)
    return [round(_SCALE * (p[x] - q[x])) if (x := chr(a) + chr(b)) in p else 0 for a in range(128) for b in range(128)]


def _ratio(value: Column, table: Column) -> Column:
    """Summed log-likelihood ratio of a string's character pairs, in thousandths."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))

    def total(c: Column) -> Column:
        each = F.transform(c, lambda x, i: F.coalesce(F.get(table, x * 128 + F.get(c, i + 1)), F.lit(0)))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    return _let(codes, total)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scanned(docs: DataFrame, model: list[int], text: str = "text", keep: list[str] | None = None, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``.

    ``result``: spans (start, rank of the kind, end, value), counts of the base
    kinds, digest of the base spans, all spans as text.
    """
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def judged(base: Column) -> Column:
        runs = F.filter(_spans(value, RUN, 3), lambda s: _ratio(s["value"], table) >= int(least_ratio * _SCALE))
        apart = _let(runs, lambda r: F.when(F.size(r) > 0, _apart(r, base)).otherwise(r))
        return F.struct(base.alias("base"), F.sort_array(F.concat(base, apart)).alias("spans"))

    found = docs.select(packed(docs, keep), _let(base_spans(value), judged).alias("f"))
    count = lambda kind: F.size(F.filter("f.base", lambda s: s["rank"] == kind)).cast("long")
    return found.select(
        "row",
        F.struct(
            *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
            F.sha2(_written(F.col("f.base")), 256).alias("base_sha256"),
            _written(F.col("f.spans")).alias("spans"),
            F.col("f.spans").alias("found"),
        ).alias("result"),
    )
