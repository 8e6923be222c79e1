import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard_join, language, mixing, quality_rules, repeats, sharding, toxicity
from tests.llm import brute

ODD = [None, "", " ", "\n\n", "one", "Two words", "ÉTÉ été\x0bété", "a b c " * 400, "x" * 50_000, "# * $ % & | < >", "tab\tand\rcr\x00nul"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi".split()) + str(rng.randrange(40)) for _ in range(n))


def corpus(rng, n=60):
    """Texts with exact and near copies, shared passages and odd cases."""
    base = [sentence(rng, rng.randrange(5, 120)) for _ in range(n)]
    out = list(ODD) + base + base[:6]
    for text in base[:12] * 3:
        words = text.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(9))
        out.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus(random.Random(5))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 6}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id here at all", None, None, None), (3, "id three again", "en", "src1", 1)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, docs, k, percent):
    rows = docs.collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.jaccard_classes(docs, k=k, percent=percent).collect())
    number, sets = brute.components([r.text for r in rows], k, percent)
    least = {}
    for r, c, s in zip(rows, number, sets):
        if s and r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), len(s), str(least.get(c) if s else r.doc_id)) for r, c, s in zip(rows, number, sets))
    assert got == want


def test_long_posting_lists_are_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = sentence(rng, 60).split()
    family = []
    for _ in range(90):
        w = list(words)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        family.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    df = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(df, k=3, percent=90).collect()}
    number, _ = brute.components(family, 3, 90)
    assert got == {i: min(j for j, d in enumerate(number) if d == c) for i, c in enumerate(number)}


def test_one_of_each_component_stays(spark, docs):
    rows = docs.withColumn("row", F.lit(1)).withColumn("label", F.lit("x"))
    kept = jaccard_join.one_of_each(rows)
    assert kept.columns == rows.columns
    source = docs.collect()
    number, sets = brute.components([r.text for r in source], 5, 80)
    blank = sum(not s for s in sets)
    assert kept.count() == blank + len({c for c, s in zip(number, sets) if s})
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def test_decontamination_equals_all_windows(spark, monkeypatch, docs, texts):
    rng = random.Random(1)
    items = [(None, None), (1, ""), (2, "two words"), (2, "two words"), (3, " ".join(texts[20].split()[:30])), (4, sentence(rng, 13)), (None, "Été été ÉTÉ")]
    items += [(10 + i, " ".join(texts[15 + i].split()[2:18])) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs.withColumn("starts", F.lit(0)).withColumn("result", F.lit("x"))
    for bits in (27, 0):
        monkeypatch.setattr(repeats, "MOST_BITS", bits)
        got = decontaminate.marked(rows, bench).select("row.doc_id", "row.text", "result").collect()
        assert len(got) == rows.count()
        for r in got:
            n, hit, ids = brute.decontamination(r.text, items)
            assert (r.result.n_words, r.result.n_hit, r.result["items"]) == (n, hit, ids)
            assert r.result.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
            assert r.result.contaminated == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.clean(rows, bench)
    assert kept.columns == rows.columns and 0 < kept.count() < rows.count()
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.clean(empty(spark), bench).count() == 0


def test_quality_counts_equal_plain_counts(spark, docs):
    got = quality_rules.judged(docs.withColumn("m", F.lit(1))).collect()
    assert len(got) == docs.count()
    for r in got:
        x = r.result
        n, chars, symbols, lines, repeats = brute.quality(r.row.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert x.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert x.kept == (not x.base_failed and not x.failed_rules)
    assert quality_rules.passing(empty(spark)).columns == docs.columns


def test_quality_plan_has_no_shuffle_and_no_python(docs):
    plan = quality_rules.passing(docs)._jdf.queryExecution().toString()
    assert not re.search("Exchange|Python|Arrow", plan)


def test_shards_fit_and_are_shortest_prefixes(spark, docs):
    rows = docs.collect()
    got = sharding.sharded(docs.withColumn("bits", F.lit(1)), limit=3000).select("row.*", "shard_id", "shard_bits", "row_bytes", "shard_bytes").collect()
    held = {}
    for r in got:
        held.setdefault(r.shard_id, []).append(r.row_bytes)
    assert sum(map(len, held.values())) == len(rows)
    assert all(sum(v) <= 3000 or len([b for b in v if b]) == 1 for v in held.values())
    hashes = docs.select("doc_id", "text", sharding.row_hash("doc_id", "text").alias("h")).collect()
    sizes = [(h.h, len((h.text or "").encode())) for h in hashes]
    want = sorted(zip([str((h.doc_id, h.text)) for h in hashes], brute.shard_bits(sizes, 3000)))
    assert sorted((str((r.doc_id, r.text)), r.shard_bits) for r in got) == want
    assert all(r.shard_bytes == sum(held[r.shard_id]) for r in got)
    assert sharding.with_shards(empty(spark)).count() == 0
    assert sharding.with_shards(docs.withColumn("shard_id", F.lit("old"))).columns == docs.columns + list(sharding.COLUMNS)


def test_equal_rows_fill_pages(spark):
    df = spark.createDataFrame([(1, "same text here")] * 25 + [(2, "other")], "doc_id long, text string").repartition(3)
    got = sharding.sharded(df, limit=30).select("row.text", "shard_id", "shard_bits", "shard_bytes").collect()
    pages = [r.shard_id for r in got if r.text == "same text here"]
    assert len(set(pages)) == 13 and max(pages.count(p) for p in set(pages)) == 2 and len(got) == 26
    assert all(r.shard_bytes == 14 * pages.count(r.shard_id) for r in got if r.text == "same text here")


WEIGHTS = {("a",): 3.0, ("b",): 1.0, ("*", "en"): 2.0}


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 1), (1.5, 3)])
def test_mixing_equals_plain_water_filling(spark, share, epochs):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(0, 30)) or None, rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), 4)}", 0) for i in range(300)] + [(7, "same", "en", "s0", 0)] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    levels = {"d": F.when(F.col("source").isin("s0", "s1", "s2"), "a").otherwise("b"), "l": F.col("lang"), "s": F.col("source")}
    got = mixing.mixed(df, levels, mixing.word_count(), ["doc_id", "text"], WEIGHTS, share, epochs, 5).select("row.*", "result.*").collect()
    tree, rows_of = {}, {}
    for i, text, lang, source, _ in rows:
        path = ("a" if source in ("s0", "s1", "s2") else "b", lang or "unknown", source)
        rows_of.setdefault(path, []).append((i, text, len((text or "").split())))
    for (d, lang, s), own in rows_of.items():
        top = tree.setdefault(d, (WEIGHTS[(d,)], {}))[1]
        top.setdefault(lang, (2.0 if lang == "en" else 1.0, {}))[1][s] = (1.0, epochs * sum(n for _, _, n in own))
    total = sum(n for own in rows_of.values() for _, _, n in own)
    budgets = brute.shares(tree, int(total * share))
    taken = {}
    for r in got:
        taken.setdefault((r.d, r.l, r.s), []).append((r.epoch, r.doc_id, r.text, r.tokens))
    marks = {(r.doc_id, r.text): r for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("m")).collect()}
    for path, budget in budgets.items():
        own = rows_of[path]
        whole = sum(n for _, _, n in own)
        full = int(budget + 1e-6) // whole if whole else 0
        rest = int(budget + 1e-6) - full * whole
        order = {r.m: r.p for r in spark.createDataFrame([(marks[(i, t)].m,) for i, t, _ in own], "m long").select("m", F.shiftrightunsigned(F.xxhash64(F.lit(5), F.lit(full).cast("int"), "m"), 1).alias("p")).collect()} if rest else {}
        place = lambda x: order[marks[(x[0], x[1])].m]
        want = [(e, i, t, n) for e in range(full) for i, t, n in own]
        if rest:
            for i, t, n in own:
                if sum(x[2] for x in own if place(x) <= place((i, t))) <= rest:
                    want.append((full, i, t, n))
        assert sorted(map(str, taken.get(path, []))) == sorted(map(str, want))
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(8)
    sample = "".join(rng.choice("abc") for _ in range(80))
    start = language.automaton(sample)
    for _ in range(300):
        probe = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        state = start
        for c in probe:
            state = state.get(c) if state is not None else None
        assert (state is not None) == (probe in sample)
        count, at = 0, 0
        while at < len(probe):
            end = at + 1
            while end < len(probe) and probe[at : end + 1] in sample:
                end += 1
            count, at = count + 1, end
        assert language.phrases(probe, start) == count


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    learned = language.samples(docs.where(~held))
    got = language.identified(docs.where(held), learned).collect()
    assert sum(r.row.lang == r.result.lang_pred for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*ODD, "123 456"])], "doc_id long, text string, lang string")
    for r in language.identified(odd, learned).collect():
        assert (r.result.lang_pred == "und") == (not any(c.isalpha() for c in r.row.text or ""))
        assert 0 <= r.result.score <= 1
    assert language.samples(odd.limit(0)) == {}
    assert {r.result.lang_pred for r in language.identified(odd, {}).collect()} == {"und"}


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.scored(docs, model).select("row.doc_id", "result.score").join(labels.where(held), "doc_id").collect()
    assert all(r.score < 0.3 for r in got if not r.toxic)
    found = [r.score >= 0.3 for r in got if r.toxic]
    assert sum(found) >= 0.5 * len(found) > 0
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert all(0 <= r.result.score < 0.3 for r in toxicity.scored(odd, model).collect())
    assert all(r.result.score < 0.3 for r in toxicity.scored(odd, toxicity.fit(docs, labels.limit(0))).collect())
