"""The registered query of each training-data operator: its whole table, production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import language, line_chunks, oracles, periodic_runs, pipeline, secrets, sentence_spans, spelling, topk, toxicity
from loomgraph.llm.decontaminate import marked
from loomgraph.llm.jaccard_join import jaccard_classes
from loomgraph.llm.mixing import WEIGHTS, document_levels, mixed, word_count
from loomgraph.llm.quality_rules import judged
from loomgraph.llm.registry import QUERIES, llm_query
from loomgraph.llm.sharding import COLUMNS, LIMIT, sharded

SMALL_LIMIT = 64 << 10


def _fold(modulus: int, held: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is held out of learning, by the CRC-32 of its id; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == held, F.lit(False))


@llm_query("op1_toxicity")
def op1(table):
    """Toxicity of every document; three quarters of the labels are learned from."""
    docs, labels = table("documents"), table("labels")
    model = toxicity.fit(docs, labels.where(~_fold(4, 2)))
    rows = toxicity.scored(docs, model, keep=["doc_id"]).select("row.doc_id", "result.score")
    return rows.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@llm_query("op2_mixing")
def op2(table):
    """Half of all tokens by domain, language and source weights, up to two epochs of a source."""
    rows = mixed(table("documents"), document_levels(), word_count(), ["doc_id", "text"], WEIGHTS, 0.5, 2, 17, ["doc_id"])
    return rows.select("row.doc_id", "result.*")


@llm_query("op3_decontamination", oracles.DECONTAMINATION)
def op3(table):
    """Documents that stand in benchmark items, by shared windows of 13 words."""
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return marked(table("documents"), table("benchmark"), keep=["doc_id"], is_stored=True).select("row.doc_id", *[f"result.{f}" for f in fields])


def _shards(docs: DataFrame, limit: int) -> DataFrame:
    placed = sharded(docs, limit=limit, keep=["doc_id"]).select("row.doc_id", *COLUMNS)
    return placed.withColumn("shard_bits", placed.shard_bits.cast("long"))


@llm_query("op4_sharding", oracles.SHARDING)
def op4(table):
    """Shards of up to 32 MiB by hash prefix."""
    return _shards(table("documents"), LIMIT)


@llm_query("small_shards", oracles.sharding(SMALL_LIMIT))
def small_shards(table):
    """Shards of up to 64 KiB: many in a small table too, and pages for longer texts."""
    return _shards(table("documents"), SMALL_LIMIT)


@llm_query("op5_substring_dedup")
def op5(table):
    """Documents without sentences of spans that stand earlier in the corpus."""
    rows = sentence_spans.deduplicated(table("documents"), keep=["doc_id"], is_stored=True)
    return rows.select("row.doc_id", F.col("result.n_pieces").alias("n_sentences"), "result.n_removed", "result.text")


@llm_query("op6_secret_scan")
def op6(table):
    """Secrets in every document: base patterns and what the Markov models add."""
    docs = table("documents")
    rows = secrets.scanned(docs, secrets.train(docs), keep=["doc_id"])
    return rows.select("row.doc_id", *[f"result.{f}" for f in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


@llm_query("op7_quality_rules", oracles.QUALITY)
def op7(table):
    """Counts and verdict of the threshold table."""
    return judged(table("documents"), keep=["doc_id"]).select("row.doc_id", "result.*")


@llm_query("op8_jaccard_join", oracles.JACCARD)
def op8(table):
    """Components of documents that share 90 % of their three-word shingles."""
    return jaccard_classes(table("documents"), k=3, percent=90)


@llm_query("op9_language")
def op9(table):
    """Language of every document; two thirds of the labels are learned from."""
    docs = table("documents")
    learned = language.samples(docs.where(~_fold(3, 1)))
    rows = language.identified(docs, learned, keep=["doc_id"])
    return rows.select("row.doc_id", _fold(3, 1, "row.doc_id").alias("held_out"), "result.*")


@llm_query("op10_line_dedup")
def op10(table):
    """Documents without blocks of lines that stand earlier in the corpus."""
    rows = line_chunks.deduplicated(table("documents"), keep=["doc_id"], is_stored=True)
    return rows.select("row.doc_id", F.col("result.n_pieces").alias("n_lines"), "result.n_removed", "result.text")


@llm_query("op11_spelling_variants", oracles.SPELLING)
def op11(table):
    """Words of all documents, the words one edit away and the form each follows."""
    words = spelling.counted(table("documents"), slips=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of some texts, chosen by their ids, turned into loops of a few words."""
    h, g = "crc32(CAST(doc_id AS STRING))", "crc32(CAST(doc_id AS STRING)) DIV 10"
    words = "regexp_extract_all(text, '([^ \\\\x09-\\\\x0D]+)', 1)"
    start = f"CAST({g} % size(w) AS INT)"
    period = f"CAST(1 + (size(w) - {start}) DIV (3 + {g} % 8) AS INT)"
    loops = f"flatten(array_repeat(slice(w, {start} + 1, {period}), 11))"  # at most ten whole loops and a part
    text = f"transform(array({words}), w -> IF(size(w) = 0, '', array_join(slice(concat(slice(w, 1, {start}), {loops}), 1, size(w)), ' ')))[0]"
    return docs.withColumn("text", F.expr(f"CASE WHEN {h} % 10 = 0 THEN {text} ELSE text END"))


@llm_query("op12_periodic_runs", oracles.PERIODIC)
def op12(table):
    """Periodic runs of words in every document, and the text without their repeats."""
    rows = periodic_runs.collapsed(looped(table("documents")), keep=["doc_id"]).select("row.doc_id", "result.*")
    lines = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')"
    most = "aggregate(runs, runs[0], (m, x) -> IF(x.length * m.period > m.length * x.period, x, m))"
    rows = rows.withColumn("most", F.expr(f"IF(size(runs) > 0, {most}, NULL)"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "most.start",
        "most.length",
        "most.period",
        F.expr("1000 * most.length DIV most.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@llm_query("op13_topk_search", oracles.SEARCH)
def op13(table):
    """The 20 highest inner products of every twentieth vector with all others."""
    return topk.top_k(table("embeddings"), 20, F.col("vec_id") % 20 == 0)


QUERIES["pipeline"] = pipeline.run
