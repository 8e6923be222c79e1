"""Masking of PostgreSQL sources against a plain scanner, comments nested to any depth."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.operators.extract import postgres


def plain_mask(src):
    """Comments and literals blank, dollar bodies hidden but for their blank comments."""
    hide = str.maketrans(postgres._PLAIN, postgres._HIDDEN)
    blank = lambda x: re.sub(r"[^\n]", " ", x)

    def block_end(at, stop):
        depth, at = 1, at + 2
        while at < stop and depth:
            pair = src[at : min(at + 2, stop)]
            depth += (pair == "/*") - (pair == "*/")
            at += 2 if pair in ("/*", "*/") else 1
        return at

    def comment_end(at, stop):
        if src.startswith("--", at, stop):
            end = src.find("\n", at, stop)
            return stop if end < 0 else end
        return block_end(at, stop) if src.startswith("/*", at, stop) else None

    out, i, n = [], 0, len(src)
    while i < n:
        j = comment_end(i, n)
        tag = re.compile(r"\$[A-Za-z0-9_]*\$").match(src, i)
        if j is not None:
            out.append(blank(src[i:j]))
        elif src[i] in "'\"":
            j = src.find(src[i], i + 1)
            j = n if j < 0 else j + 1
            out.append(blank(src[i:j]) if src[i] == "'" else src[i:j])
        elif tag:
            close = src.find(tag[0], tag.end())
            body = n if close < 0 else close
            j = n if close < 0 else close + len(tag[0])
            out.append(tag[0].translate(hide))
            k = tag.end()
            while k < body:
                e = comment_end(k, body)
                out.append(blank(src[k:e]) if e is not None else src[k].translate(hide))
                k = e if e is not None else k + 1
            out.append(src[body:j].translate(hide))
        else:
            j = i + 1
            out.append(src[i:j])
        i = j
    return "".join(out)


def test_masks_are_those_of_a_plain_scanner(spark):
    rng = random.Random(2)
    parts = ["/*", "*/", "*", "/", "--", "-", "\n", "'", '"', "$$", "$a$", "$", "a", "é x", "b_1", ";", " "]
    texts = ["".join(rng.choice(parts[: rng.choice([3, 6, 17])]) for _ in range(rng.randrange(1, 90))) for _ in range(500)]
    texts += ["/*" * 50 + " CREATE TABLE x " + "*/" * 50 + " CREATE TABLE y;", "$$" + "/* a " * 30 + "*/ " * 30 + " b $$ c", "", "2*/*c*/3", "/*/**/", "$a$b$ x $b$ y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    walked = df.select("i", postgres.mask(F.col("t")).alias("m"), postgres._mask_by_walk(F.col("t")).alias("w")).collect()
    for r in walked:
        want = plain_mask(texts[r.i])
        assert r.w == want and r.m == want, repr(texts[r.i])


def test_statements_in_deep_comments_are_not_objects(spark, files):
    deep = "/* CREATE TABLE hidden (x int); " * 60 + "*/ " * 60
    text = f"{deep}\nCREATE TABLE seen (id serial);{deep}\nCREATE FUNCTION f() RETURNS int LANGUAGE plpgsql AS $$ BEGIN {deep} INSERT INTO t2 VALUES (1); END; $$;"
    found = postgres.objects(files(("db/a_pg.sql", text))).collect()
    assert sorted((r.kind, r.name, r.line) for r in found) == [("sql_function", "f", 3), ("sql_table", "seen", 2)]
    edges = postgres.extract(files(("db/a_pg.sql", text))).edges.collect()
    assert not any("hidden" in e.target or "hidden" in e.source for e in edges)
    assert any(e.target.endswith("t2") for e in edges)


def test_a_long_text_costs_as_its_length(spark):
    text = "/* a */ SELECT 'x' FROM t; -- c\n" * 20_000
    got = spark.createDataFrame([(text,)], "t string").select(postgres.mask(F.col("t")).alias("m")).first().m
    assert got == plain_mask(text[:320]) * 2_000
