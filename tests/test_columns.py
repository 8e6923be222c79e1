from pyspark.sql import functions as F

from loomgraph.functions import columns as C


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_infer_label_rules_in_order(spark):
    cases = [
        ("sql_table", None, "x.md", "Foo", "SqlTable"),
        ("dependency", None, "", "x", "Package"),
        (None, "file", "docs/a.md", "Foo", "File"),
        (None, "bash_function", "", "run.sh", "Function"),
        (None, None, "docs/A.MDX", "main()", "DocSection"),
        (None, None, "a.go", "config.yaml", "File"),
        (None, None, "a.go", "Serve()", "Function"),
        (None, None, "a.go", "Server", "Class"),
        (None, None, "a.go", "Éclair", "Class"),
        (None, None, "a.go", "Has Space", "Symbol"),
        (None, None, "a.go", "Call(x", "Symbol"),
        (None, None, "a.go", "lower", "Symbol"),
        ("unknown", "other", "", "", "Symbol"),
    ]
    df = spark.createDataFrame(cases, "type string, kind string, file string, label string, want string")
    got = df.select("want", C.infer_label(F.col("type"), F.col("kind"), F.col("file"), F.col("label")).alias("got"))
    assert [r.got for r in got.collect()] == [c[-1] for c in cases]


def test_keys_are_global_for_platform_and_scoped_for_code(spark):
    rows = [
        ("r1", "platform", "f", "l", "topic::a"),
        ("r2", "platform", "g", "m", "topic::a"),
        ("r1", None, "f", "l", "id1"),
        ("r2", None, "f", "l", "id1"),
        ("r1", None, "f", "l", "id2"),
        ("r1", "platform", "f", "l", "route::r1::x"),
        ("r1", None, "f", "l", "topic::a"),
    ]
    df = spark.createDataFrame(rows, "repo string, origin string, file string, label string, id string")
    out = df.select(
        C.stable_key(*[F.col(c) for c in ("repo", "origin", "file", "label", "id")]).alias("k"),
        C.is_shared(F.col("origin"), F.col("id")).alias("s"),
    ).collect()
    keys = [r.k for r in out]
    assert keys[0] == keys[1] == "platform::topic::a"
    assert len(set(keys[2:5])) == 3
    assert [r.s for r in out] == [True, True, False, False, False, False, False]


def test_symbol_spellings_match_column_form(spark):
    symbols = ["Convert", " Convert(a, b) ", ".formatLtp", "()", "", "GetX()", "(lead", "a.b()"]
    df = spark.createDataFrame([(s,) for s in symbols], "s string")
    rows = df.select("s", C.symbol_spellings_col(F.col("s")).alias("v")).collect()
    for r in rows:
        assert r.v == C.symbol_spellings(r.s), r.s
    assert C.symbol_spellings("Convert") == ["convert", "convert()", ".convert", ".convert()"]
    assert C.symbol_spellings("()") == ["()", ".()"]


def test_normalize_remote(spark):
    same = [
        "https://github.com/Org/Repo.git", "git@github.com:org/repo.git", "ssh://git@github.com/org/repo",
        "https://token@github.com/org/repo/", " HTTPS://GITHUB.COM/org/repo.git/ ",
    ]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r.v for r in df.select(C.normalize_remote(F.col("u")).alias("v")).collect()} == {"github.com/org/repo"}


def test_language_context_and_hash(spark):
    assert one(spark, C.infer_language(F.lit(""), F.lit("a/B.PY"))) == "python"
    assert one(spark, C.infer_language(F.lit("cobol"), F.lit("a.py"))) == "cobol"
    assert one(spark, C.infer_language(F.lit(None), F.lit("Makefile"))) is None
    assert len(one(spark, C.cap_context(F.lit("é" * 70)))) == 64
    a = C.content_hash({"x": F.lit(1), "y": F.lit(None).cast("string")})
    b = C.content_hash({"y": F.lit(None).cast("string"), "x": F.lit(1)})
    assert one(spark, a) == one(spark, b) and len(one(spark, a)) == 16
