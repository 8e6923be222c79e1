"""Repeated sentence spans and line chunks against plain versions that compare contents."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import line_chunks, queries, repeats, sentence_spans
from loomgraph.llm.wordhash import SPACES, LineSplitter, Splitter
from tests.llm.brute import WORD
from tests.llm.test_operators import ODD, sentence

MASK = (1 << 64) - 1
WORDS, LINES = Splitter(SPACES, lower=False), LineSplitter()


def mix(h):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ h >> 33) * factor) & MASK
    return h ^ h >> 33


def code(splitter, piece):
    return int(next(splitter.tokens(pa.array([piece]))).hashes[0]) if piece else mix(0)


def plain_sentences(text):
    """(start, end, words): byte ranges up to the next sentence, and the words."""
    found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    groups, held = [], []
    for i, (start, end, word) in enumerate(found):
        held.append(i)
        if word[-1] in ".!?" or i + 1 == len(found) or "\n" in text[end : found[i + 1][0]]:
            groups.append(held)
            held = []
    pieces = []
    for group in groups:
        codes = [code(WORDS, found[i][2]) for i in group]
        pairs = [mix((a * 31 + b) & MASK) for a, b in zip(codes, codes[1:])]
        cuts = {len(group)}
        if len(group) > sentence_spans.LONGEST:
            for j in range(len(pairs) - sentence_spans.WINDOW + 1):
                window = pairs[j : j + sentence_spans.WINDOW]
                cuts.add(j + max(i for i, p in enumerate(window) if p == min(window)) + 2)
        cuts = sorted(cuts)
        pieces += [group[a:b] for a, b in zip([0, *cuts], cuts)]
    starts = [found[p[0]][0] for p in pieces] + [len(text)]
    return [(starts[k], starts[k + 1], [found[i][2] for i in p]) for k, p in enumerate(pieces)]


def plain_spans(text):
    """(content, sentences covered) of every span."""
    words = [w for _, _, w in plain_sentences(text)]
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            if sum(map(len, words[i:j])) >= 15:
                yield tuple(sum(words[i:j], [])), range(i, j)
                break


def without_sentences(text, gone):
    pieces = plain_sentences(text)
    if not gone:
        return text, len(pieces), 0
    return "".join(text[a:b] for k, (a, b, _) in enumerate(pieces) if k not in gone).rstrip(" \t\n\v\f\r"), len(pieces), len(gone)


def plain_chunks(text):
    """(first, end) line numbers of the chunks of all cuts."""
    lines = text.split("\n") if text else []
    codes = [code(LINES, x) for x in lines]
    rolled = [mix(((codes[i - 1] * 0x9E3779B97F4A7C15 if i else 0) + c) & MASK) for i, c in enumerate(codes)]
    out = set()
    for j in range(line_chunks.CUTS):
        begin = 0
        for i in range(len(lines)):
            if i + 1 == len(lines) or i - begin and rolled[i] >> 7 * j & 1:
                out |= {(a, min(a + 64, i + 1)) for a in range(begin, i + 1, 64)}
                begin = i + 1
    return lines, sorted((a, b) for a, b in out if b - a > 1 and WORD.search("\n".join(lines[a:b])))


def plain_lines(texts):
    """Lines to remove of each text, in order of the texts."""
    firsts, gone, all_lines = {}, [set() for _ in texts], []
    for k, text in enumerate(texts):
        lines, chunks = plain_chunks(text or "")
        all_lines.append(lines)
        for a, b in chunks:
            f, at = firsts.setdefault(tuple(lines[a:b]), (k, a))
            if (f, at) == (k, a):
                continue
            its = all_lines[f]
            up = down = 0
            while up < min(line_chunks.BESIDE, a, at) and lines[a - up - 1] == its[at - up - 1]:
                up += 1
            while down < min(line_chunks.BESIDE, len(lines) - b, len(its) - at - b + a) and lines[b + down] == its[at + b - a + down]:
                down += 1
            gone[k] |= set(range(a - up, b + down))
    return gone


def plain_spans_gone(texts):
    firsts, gone = {}, [set() for _ in texts]
    for k, text in enumerate(texts):
        for i, (content, covered) in enumerate(plain_spans(text or "")):
            if firsts.setdefault(content, (k, i)) != (k, i):
                gone[k] |= set(covered)
    return gone


def without_lines(text, gone):
    lines = text.split("\n") if text else []
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


VERSIONS = {sentence_spans: (plain_spans_gone, without_sentences), line_chunks: (plain_lines, without_lines)}


def plain(module, rows):
    """(doc_id, text, pieces, removed) of rows, ordered as the operator orders them."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    find, rewrite = VERSIONS[module]
    gone = find([t for _, t in rows])
    return sorted([(i, *rewrite(t or "", g)) for (i, t), g in zip(rows, gone)], key=repr)


def corpus(rng):
    shared = ". ".join(sentence(rng, 9).capitalize() for _ in range(4)) + "."
    lines = [sentence(rng, 4) for _ in range(14)]
    rows = []
    for i in range(40):
        at = rng.randrange(10)
        block = lines[at : at + rng.randrange(2, 14)]
        own = [sentence(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join([*own, *block, *own[:1], *rng.sample(block, 1)])))
        rows.append((100 + i, f"{sentence(rng, rng.randrange(1, 30))} {shared} {sentence(rng, 8)}{rng.choice(['.', '?', ''])} {rng.choice(['', shared])}\r\n"))
    rows += [(200, sentence(rng, 400)), (201, None), (202, ""), (203, "word " * 300), (204, "same line\n" * 200), (205, "same line\nother\n" * 60), (206, "\n" * 50), (207, shared)]
    return rows + [(300 + i, t) for i, t in enumerate(ODD)]


@pytest.mark.parametrize("module", VERSIONS)
@pytest.mark.parametrize("most_bits", [27, 20, 0])
def test_results_are_those_of_the_plain_version(spark, monkeypatch, module, most_bits):
    monkeypatch.setattr(repeats, "MOST_BITS", most_bits)
    rows = corpus(random.Random(9 + most_bits))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(2)).withColumn("at", F.lit(1)).withColumn("file", F.lit("x"))
    got = [(r.row.doc_id, *r.result) for r in module.deduplicated(df).collect()]
    assert sorted(got, key=repr) == plain(module, rows)
    assert sum(r[3] > 0 for r in got) > 25


@pytest.mark.parametrize("module", VERSIONS)
def test_equal_rows_ids_of_any_type_and_empty_tables(spark, module):
    rng = random.Random(3)
    text = "\n".join(sentence(rng, 8) + "." for _ in range(12))
    for ids in ([None] * 3, [5, 5, 5], ["b", "a", None], [b"\1", b"\0", b"\2"]):
        kind = {int: "long", str: "string", bytes: "binary"}.get(type(ids[0]), "long")
        df = spark.createDataFrame([(i, text) for i in ids], f"doc_id {kind}, text string")
        got = Counter((r.row.doc_id, r.result.text) for r in module.deduplicated(df).collect())
        first = min((i for i in ids if i is not None), default=None)
        assert sum(got.values()) == 3 and got[first, text] == 1 and sum(n for (_, t), n in got.items() if t == "") == 2
    wide = spark.createDataFrame([], "doc_id long, text string, h long, g long, result string, positions int")
    assert module.cleaned(wide).columns == wide.columns and module.cleaned(wide).count() == 0


def test_queries_read_stored_rows(spark, tmp_path):
    rows = corpus(random.Random(21)) + [(None, "a line\nand one\nand more\n" * 3)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name, module in (("op5_substring_dedup", sentence_spans), ("op10_line_dedup", line_chunks)):
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "text", F.col("n_lines" if "10" in name else "n_sentences"), "n_removed").collect()]
        assert sorted(got, key=repr) == plain(module, rows)


def test_one_very_long_sentence_and_one_very_long_line(spark):
    rng = random.Random(1)
    words = " ".join("w%05d" % rng.randrange(90_000) for _ in range(60_000))
    df = spark.createDataFrame([(1, words), (2, "one. " + words), (3, "x\n" + words + "\ny"), (4, "z\n" + words + "\ny")], "doc_id long, text string")
    got = {r.row.doc_id: r.result for r in sentence_spans.deduplicated(df).collect()}
    assert got[1].text == words and len(got[2].text) < 500 and len(got[3].text) < 500
    got = {r.row.doc_id: r.result for r in line_chunks.deduplicated(df).collect()}
    assert got[3].text == "x\n" + words + "\ny" and got[1].n_removed == 0


def test_fifty_words_shared_by_two_long_sentences_have_a_common_span():
    rng = random.Random(12)
    for _ in range(60):
        shared = sentence(rng, 50)
        a, b = (f"{sentence(rng, rng.randrange(60))} {shared} {sentence(rng, rng.randrange(60))}" for _ in range(2))
        assert {x for x, _ in plain_spans(a)} & {x for x, _ in plain_spans(b)}


@pytest.mark.parametrize("n,least", [(2, 0.1), (3, 0.4), (4, 0.6), (6, 0.88), (13, 0.99)])
def test_shares_of_short_blocks_that_go_whole(n, least):
    """Blocks of n lines at random offsets: those with a chunk in common go with all their lines, others stay."""
    rng, whole, trials = random.Random(n), 0, 400
    for k in range(trials):
        block = [f"{k} {sentence(rng, 3)}" for _ in range(n)]
        texts = ["\n".join([*(f"{k}{d} {sentence(rng, 3)}" for _ in range(rng.randrange(1, 9))), *block, *(f"{k}{d} {sentence(rng, 3)}" for _ in range(rng.randrange(1, 9)))]) for d in "ab"]
        lost = plain_lines(texts)[1]
        assert len(lost) in (0, n)
        whole += len(lost) == n
    assert whole >= least * trials


def test_words_are_split_by_ascii_white_space_only():
    assert [w for _, _, w in plain_sentences("a\u00a0b c\u2028d")] == [["a\u00a0b", "c\u2028d"]]
    text = "a\u00a0b c. d\u2028e f."
    t = next(WORDS.tokens(pa.array([text])))
    firsts, bounds = sentence_spans.sentences(t)
    assert firsts.tolist() == [0, 2, 4] and bounds.tolist() == [0, 2]
