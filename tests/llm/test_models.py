"""Operators that learn, against plain versions: n-gram ratios and scores, Markov ratios, greedy phrases."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language, secrets, toxicity
from tests.llm.test_operators import ODD, sentence

# --- toxicity ----------------------------------------------------------------


def grams(text):
    """Hashes of the distinct 4- and 5-grams of a text, letters lower-cased one by one."""
    points = [ord(c.lower() if len(c.lower()) == 1 else c) for c in text or ""]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(points) - n + 1):
            h = n
            for p in points[i : i + n]:
                h = (h * 0x01000193 + p) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 13
            h = h * 0xC2B2AE35 & 0xFFFFFFFF
            out.add(h >> (32 - toxicity.HASH_BITS))
    return out


def toxic_rows(rng):
    rows = [(i, sentence(rng, 12) + (rng.choice([" Vile Insult", " you vile", " insulting"]) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    return rows + [(100 + i, t, i % 2) for i, t in enumerate(ODD)]


def plain_ratios(rows):
    n1 = sum(y for _, _, y in rows)
    n0 = len(rows) - n1
    sets = [(grams(t), y) for _, t, y in rows]
    found = {}
    for g in set().union(*(s for s, _ in sets)):
        a, b = (sum(g in s for s, y in sets if y == c) for c in (1, 0))
        if a + b >= toxicity.LEAST_TEXTS:
            found[g] = math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n0 + 2))
    return found


def test_ratios_weights_and_scores_are_the_plain_ones(spark):
    rows = toxic_rows(random.Random(1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ratios = plain_ratios(rows)
    assert set(model.hashes.tolist()) == set(ratios)
    # The weights are the optimum of the penalised likelihood: its gradient vanishes.
    weight = {h: w / ratios[h] for h, w in zip(model.hashes.tolist(), model.weights) if ratios[h]}
    sets = [grams(t) & set(ratios) for _, t, _ in rows]
    margin = [model.bias + sum(weight.get(g, 0) * ratios[g] for g in s) for s in sets]
    gap = [1 / (1 + math.exp(-m)) - y for m, (_, _, y) in zip(margin, rows)]
    assert abs(sum(gap)) / len(rows) < 1e-3
    for g in list(weight)[:200]:
        slope = sum(d for d, s in zip(gap, sets) if g in s) * ratios[g] / len(rows) + 1e-3 * weight[g]
        assert abs(slope) < 2e-3
    scores = {r.row.doc_id: r.result.score for r in toxicity.scored(docs, model).collect()}
    assert all(abs(scores[i] - 1 / (1 + math.exp(-max(-30, min(30, m))))) < 1e-6 for m, (i, _, _) in zip(margin, rows))


def test_toxicity_of_odd_tables(spark):
    rows = toxic_rows(random.Random(2))
    docs = spark.createDataFrame([(f"d{i}", t, 1, "x") for i, t, _ in rows] * 2, "doc_id string, text string, score long, result string")
    labels = spark.createDataFrame([(f"d{i}", y) for i, _, y in rows] + [("d0", 0), ("d0", None), (None, 1), ("none", 1)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.hashes.tolist()) == set(plain_ratios(rows))  # equal rows count once, of clashing labels the toxic one
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 2 * len(rows) and len({(r.row.doc_id, r.result.score) for r in got}) == len(rows)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs.limit(0), labels)
    assert len({r.result.score for r in toxicity.scored(docs, empty).collect()}) == 1


# --- secrets -------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain_base(text):
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def plain_model(texts):
    """Log-likelihood ratio of each character pair, random strings over identifiers, in thousandths."""

    def logs(strings):
        pairs = [s[i : i + 2] for s in strings for i in range(len(s) - 1)]
        rows = {a: {b: 0 for b in secrets.ALPHABET} for a in secrets.ALPHABET}
        for p in pairs:
            if p[0] in rows and p[1] in rows:
                rows[p[0]][p[1]] += 1
        return {a + b: math.log((n + 1) / (sum(row.values()) + len(row))) for a, row in rows.items() for b, n in row.items()}

    p = logs([s[3] for t in texts for s in plain_base(t)])
    q = logs([w for t in texts if not plain_base(t) for w in re.findall("[A-Za-z0-9+/_=-]{4,}", t)])
    return {x: round(1000 * (p[x] - q[x])) for x in p}


def plain_spans(text, model):
    base = plain_base(text)
    added = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        ratio = sum(model[m[0][i : i + 2]] for i in range(len(m[0]) - 1))
        if ratio >= 10_000 and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            added.append((m.start(), 3, m.end(), m[0]))
    return base, sorted(base + added)


def written(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def secret_rows(rng):
    digits = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    key, hexes = digits(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), [digits(40) for _ in range(30)]
    rows = [t or "" for t in ODD] + ["password:token:abcdefghij", "TOKEN = 'short' api-key=\"abcdefgh12\" é secret:longenough1", f"xAKIA{key} and AKIAABC", hexes[0] + " " + hexes[1][:31], "api_key=" + hexes[2]]
    rows += [f"é the value {h[:24]} stands here" for h in hexes[3:9]] + [f"token={h}" for h in hexes] + ["an_ordinary_identifier_name and configuration_settings_table " * 3] * 4
    for _ in range(20):
        parts = [rng.choice([hexes[4][:20] + "_" + digits(9), "token=" + digits(12), f"secret: {digits(33)}/x", f"AKIA{key}" + digits(20), "plain_identifier_words", digits(24), "é"]) for _ in range(rng.randrange(1, 200))]
        rows.append(rng.choice([" ", "\n", "-", ""]).join(parts))
    return rows


@pytest.mark.parametrize("block", [64, 1, 3])
def test_secret_spans_are_those_of_a_plain_scan(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    rows = secret_rows(random.Random(6))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model, table = plain_model(rows), secrets.train(df)
    assert {x: table[ord(x[0]) * 128 + ord(x[1])] for x in model} == model
    got = secrets.scanned(df, table).collect()
    assert len(got) == len(rows)
    added = 0
    for r in got:
        base, spans = plain_spans(r.row.text, model)
        assert r.result.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert (r.result.n_assign, r.result.n_access, r.result.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.result.spans == written(spans)
        assert [tuple(s) for s in r.result.found] == [(a, k, b, v) for a, k, b, v in spans]
        added += len(spans) - len(base)
    assert added > 20


def test_secrets_of_odd_tables(spark):
    rows = [(i, t, 7, "x") for i, t in [(1, "token=abcdefgh1"), (1, "token=abcdefgh1"), (None, None), (None, "secret: 12345678"), (2, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, result string")
    got = secrets.scanned(df, secrets.train(df)).collect()
    assert sorted((str(r.row.doc_id), r.result.spans) for r in got) == [("1", "assign:0:15")] * 2 + [("2", ""), ("None", ""), ("None", "assign:0:16")]
    empty = secrets.scanned(df.limit(0), secrets.train(df.limit(0)))
    assert empty.count() == 0


def test_cost_of_many_matches_in_one_text(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text = " ".join(rng.choice([digits(40), "token=" + digits(12), digits(24) + "G"]) for _ in range(32_000))
    model = secrets.train(spark.createDataFrame([(1, "token=abcdefgh1"), (2, "some ordinary words")], "doc_id long, text string"))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.scanned(df, model).first()
    assert time.time() - began < 20  # 4 s here; the square of the matches took 89 s
    assert r.result.n_assign + r.result.n_hex > 20_000 and r.result.base_sha256 == hashlib.sha256(written(plain_base(text)).encode()).hexdigest()


# --- language ------------------------------------------------------------------


def plain_language(text, learned):
    """(language, score) by the longest substrings of each sample."""
    value = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in value) or not learned:
        return "und", 0.0
    costs = []
    for name, sample in learned.items():
        count = at = 0
        while at < len(value):
            end = at + 1
            while end < len(value) and value[at : end + 1] in sample:
                end += 1
            count, at = count + 1, end
        costs.append((count * math.log2(len(sample) + 1) / len(value), len(costs), name))
    costs.sort()
    return costs[0][2], 1.0 if len(costs) == 1 else 1 - costs[0][0] / costs[1][0]


def test_language_and_score_are_those_of_plain_parses(spark):
    rng = random.Random(5)
    learned = {name: "".join(rng.choice(letters) for _ in range(600)) for name, letters in (("xx", "abc de"), ("yy", "bcd fé"), ("zz", "ghij "))}
    learned["same"] = learned["xx"]
    texts = ["".join(rng.choice("abcdefghijé 1-") for _ in range(rng.randrange(60))) for _ in range(150)] + ODD + [learned["yy"][50:200], "qqq www"]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    for known in (learned, {"yy": learned["yy"]}, {}):
        got = language.identified(df, known).collect()
        assert len(got) == len(texts)
        for r in got:
            name, score = plain_language(r.row.text, known)
            assert r.result.lang_pred == name and abs(r.result.score - score) < 1e-9
        assert "same" not in {r.result.lang_pred for r in got}  # equal estimates go to the first
    assert language.identified(df.limit(0), learned).count() == 0


def test_languages_of_repeated_rows(spark):
    rows = [(1, "the quick brown fox", "en"), (1, "the quick brown fox", "en"), (2, "der schnelle braune fuchs", "de"), (None, "le renard", "fr"), (3, "no label", None)]
    learned = language.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "de"} and learned["en"].count("quick") == 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.result.lang_pred for r in language.identified(df, learned).orderBy(F.col("row.doc_id")).collect() if r.row.doc_id == 1] == ["en", "en"]
