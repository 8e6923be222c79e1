"""Spelling variants against plain counting and the plain distance of all pairs."""

import random
import re
import zlib
from collections import Counter

from loomgraph.llm import queries, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """Whether one code point inserted, deleted or replaced makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """{word: (n, n_near, form, form_n, root)}"""
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(others), form[w], counts[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def family(rng, letters, n):
    """Random words and words a few edits from them."""
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(n // 4)}
    while len(words) < n:
        w = list(rng.choice(sorted(words)))
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.pop(at), lambda: w.insert(at, rng.choice(letters)), lambda: w.__setitem__(at, rng.choice(letters))])()
        words.add("".join(w))
    return words


def as_rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_variants_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    counts = {w: rng.choice([1, 1, 2, 3, 6, 12, 25, 50]) for w in family(rng, "abcé", 300)}
    counts |= {"x" * 5000: 3, "x" * 4999: 9, "a": 2, "é": 9, "ab": 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert as_rows(spelling.variants(df)) == want
    assert sum(bool(v[2]) for v in want.values()) > 50 and len({v[4] for v in want.values()}) < len(want)
    assert as_rows(spelling.variants(df, most_compared=6)) == want  # most groups are halved, down to single code points


def test_a_prefix_that_all_words_share_is_halved(spark):
    rng = random.Random(9)
    words = {"interchange" + w for w in family(rng, "abcdefgh", 400)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), most_compared=200)
    got = sorted((r.low, r.high) for r in pairs.collect())
    assert len(got) == len(set(got))
    want = sorted(tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a < b and near(a, b))
    assert got == want


def test_no_words(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None), (2, "1234 œµ", None, None, None)], SCHEMA)):
        assert spelling.variants(spelling.counted(df)).count() == 0


def test_counts_of_whole_texts(spark):
    rows = [("Straße straSSe", 1), ("x" * 70_000, 2), ("x" * 70_000 + " ×÷Àÿé", 3), (None, None)] * 3
    df = spark.createDataFrame(rows, "text string, n long").withColumnRenamed("n", "word")
    got = {r.word: r.n for r in spelling.counted(df, "word").collect()}
    assert got == {"straße": 3, "strasse": 3, "x" * 70_000: 6, "×÷Àÿé": 3}


def test_query_against_plain_words(spark, tmp_path):
    rng = random.Random(6)
    words = sorted(family(rng, "abcdeé", 250)) + ["AbcÉ", "WORD"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "-", "1", "œ", "µ", "\n"]) for _ in range(rng.randrange(120)))
    rows = [(None if i == 3 else rng.randrange(400) - 9, rng.choice([None, ""]) if i % 40 == 0 else text(), "en", "s", 1) for i in range(200)]
    rows += rows[:30]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = as_rows(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path)))
    counts = Counter()
    for doc_id, value, *_ in rows:
        for w in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", value or "")):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    assert got == plain({w: n for w, n in counts.items() if n >= 3})
