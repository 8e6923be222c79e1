"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of sample text.  A text is parsed greedily
into the longest pieces that the sample contains: the parse follows the automaton
from its start as long as there is a transition, and begins a new phrase where
there is none.  The fewer phrases, the closer the text is to the sample.  Phrases
times log2(sample length) over the text's length is the cross-parsing estimate of
bits per character, and the language with the smallest estimate wins.

Only the sample is bounded: ``SAMPLE_CHARS`` characters per language, of a labelled
text ``LONGEST_SAMPLE`` at most.  Every text is parsed in full.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.rows import map_texts
from loomgraph.session import cut_lineage

SAMPLE_CHARS = 40_000
SAMPLE_TEXTS = 60
LONGEST_SAMPLE = 8_000
UNKNOWN = "und"
_BREAK = "\n"
_OTHER = re.compile(r"[\W\d_]+")


def automaton(text: str) -> dict:
    """Suffix automaton of ``text`` as nested dictionaries: the start state, from which each substring is a path."""
    start: dict = {}
    states, links, lengths = [start], [-1], [0]
    last = 0
    for c in text:
        new = len(states)
        states.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in states[p]:
            states[p][c] = new
            p = links[p]
        if p >= 0:
            q = states[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(states)
                states.append(dict(states[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and states[p].get(c) == q:
                    states[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    for state in states:
        for c, target in state.items():
            state[c] = states[target]
    return start


def phrases(text: str, start: dict) -> int:
    """Pieces of the greedy parse of ``text``; a character that the sample lacks is a piece of its own."""
    count, state = 0, start
    for c in text:
        following = state.get(c)
        if following is None:
            if state is not start:
                count += 1
            following = start.get(c)
            if following is None:
                count += 1
                following = start
        state = following
    return count + (state is not start)


def _folded(text: str | None) -> str:
    """Lower-case letters, with one space for whatever stands between them."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def samples(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, str]:
    """Sample text of each language: labelled texts, the first by hash of id, up to ``SAMPLE_CHARS`` letters and spaces.

    A text gives its first ``LONGEST_SAMPLE`` characters from its first letter on.
    Where ``SAMPLE_TEXTS`` texts do not fill the sample of a language, more of its
    texts are taken.  Texts without a letter and null languages are not used to
    learn.  Languages come in the order of their labelled rows, the most first.
    """
    labelled = docs.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text")
    ).where("lang is not null and id is not null")
    usable = labelled.where(F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("lang").orderBy("place", "id")
    out: dict[str, str] = {}
    most, short = SAMPLE_TEXTS, None
    while short is None or short:
        wanted = usable if short is None else usable.where(F.col("lang").isin(short))
        ids = wanted.select("lang", "id", F.xxhash64("id").alias("place")).distinct()
        ids = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most)
        ids = cut_lineage(ids)
        piece = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, LONGEST_SAMPLE)
        texts = wanted.select("lang", "id", piece.alias("text")).join(F.broadcast(ids), ["lang", "id"])
        texts = texts.groupBy("lang", "n").agg(F.min("text").alias("text"))
        held: dict[str, str] = {}
        taken: dict[str, int] = {}
        for row in texts.orderBy("lang", "n").toLocalIterator():
            name = row["lang"]
            taken[name] = taken.get(name, 0) + 1
            if len(held.get(name, "")) < SAMPLE_CHARS:
                held[name] = held.get(name, "") + _folded(row["text"]) + _BREAK
        out.update(held)
        short = [name for name in held if len(held[name]) < SAMPLE_CHARS and taken[name] == most]
        most *= 4
    often = dict(labelled.where(F.col("lang").isin(list(out))).groupBy("lang").count().collect())
    return {name: out[name][:SAMPLE_CHARS] for name in sorted(out, key=lambda n: (-often[n], n))}


def identified(docs: DataFrame, learned: dict[str, str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the struct of ``keep``, all columns by default) and ``result``: lang_pred, score, bits per character.

    A null text, one without a letter, or no learned language gives ``und`` and
    score 0.  The score is how far the runner-up lies behind, 0 to 1; equal
    estimates go to the first language of ``learned``.  A single language scores 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    state = {}

    def parse(texts: pa.Array) -> dict[str, list]:
        if not state:
            state.update({name: (automaton(sample), math.log2(len(sample) + 1)) for name, sample in sent.value.items()})
        names, scores, bits = [], [], []
        for value in texts:
            value = value.as_py()
            best = None
            value = _folded(value) if state else ""
            if any(map(str.isalpha, value)):
                costs = sorted(((phrases(value, start) * size / len(value), name) for name, (start, size) in state.items()), key=lambda x: x[0])
                best = costs[0]
            names.append(best[1] if best else UNKNOWN)
            bits.append(best[0] if best else None)
            scores.append((1.0 if len(costs) == 1 else 1 - best[0] / costs[1][0] if costs[1][0] else 0.0) if best else 0.0)
        return {"lang_pred": names, "score": scores, "bits_per_char": bits}

    return map_texts(docs, text, parse, "lang_pred string, score double, bits_per_char double", keep)
