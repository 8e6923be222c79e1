"""Periodic runs against a plain search of every period."""

import random
import re
import zlib
from hashlib import sha256

import pyarrow as pa

from loomgraph.llm import periodic_runs, queries

ODD = [None, "", " \n\t", "one", "é", "a a a a a", "a a a a a a", " a  a\ta\na\x0ba a a ", "x" * 70_000, "long word " * 9_000]


def plain_runs(words):
    """{(start, length): smallest period} by comparing all words that are q apart, for every q."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return found


def plain(words):
    found = plain_runs(words)
    gone = {i for (start, length), q in found.items() for i in range(start + q, start + length)}
    runs = sorted((start, q, length) for (start, length), q in found.items())
    return [(start, length, q) for start, q, length in runs], " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def loops(rng, depth=0):
    """Random words, repeated words, loops of loops and Fibonacci words."""
    letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
    kind = rng.randrange(6 if depth < 3 else 2)
    some = [rng.choice(letters) for _ in range(rng.randrange(40))]
    if kind == 0:
        return some
    if kind == 1:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
        return some[:9] + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)] + some
    if kind == 2:
        return (["a"] * rng.randrange(1, 12) + ["b"] * rng.randrange(1, 4)) * rng.randrange(1, 12)
    if kind == 3:
        short, long = ["a"], ["a", "b"]
        for _ in range(rng.randrange(1, 9)):
            short, long = long, long + short
        return long
    if kind == 4:
        return ((["a", "b"] * rng.randrange(1, 8) + ["a"]) * rng.randrange(1, 6) + ["c"]) * rng.randrange(1, 10)
    return loops(rng, depth + 1) * 5 + some


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(3)
    finder = periodic_runs._Finder()
    seen = 0
    for _ in range(25):
        texts = [rng.choice([" ", "\n", " \t", "\r "]).join(loops(rng)[:400]) for _ in range(60)] + ODD
        rng.shuffle(texts)
        got = finder(pa.array(texts))
        for i, text in enumerate(texts):
            runs, collapsed = plain(words_of(text)) if len(text or "") < 10_000 else (None, None)
            if runs is not None:
                found = [tuple(r.values()) for r in got["runs"][i].as_py()]
                assert found == runs and got["text"][i].as_py() == collapsed, text
                assert got["n_words"][i].as_py() == len(words_of(text))
                seen += len(runs)
    assert seen > 1000


def test_one_very_long_text_is_one_run(spark):
    df = spark.createDataFrame([(1, "long word " * 200_000)], "id long, text string")
    r = periodic_runs.collapsed(df).first()
    assert [tuple(x) for x in r.result.runs] == [(0, 400_000, 2)] and r.result.text == "long word"


def test_rows_columns_and_empty_tables(spark):
    schema = "row long, result string, text string, runs long"
    rows = [(1, "x", "b b b b b b c", 7)] * 2 + [(None, None, None, None)]
    got = periodic_runs.collapsed(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.row.row), r.result.n_words, r.result.text) for r in got) == [("1", 7, "b c"), ("1", 7, "b c"), ("None", 0, "")]
    assert periodic_runs.collapsed(spark.createDataFrame([], schema)).count() == 0


def test_query_against_plain_loops_and_digests(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(loops(rng)[:300]) for _ in range(150)] + [t if t is None else t[:900] for t in ODD] * 3
    rows = [(None if i == 7 else rng.randrange(500) - 20, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += rows[:5]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())))
    want = []
    for doc_id, text, *_ in rows:
        words = words_of(text)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, collapsed = plain(words)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append(repr((doc_id, len(runs), *best, sha256(lines.encode()).hexdigest(), sha256(collapsed.encode()).hexdigest())))
    assert got == sorted(want)
