"""A training corpus from raw documents, in stages that are written and reread.

Each stage works on all rows its predecessor kept and all but the last return the
columns of ``documents``.  An empty table passes through all stages; columns of any
name besides those of ``documents`` are kept; equal rows are near duplicates of each
other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.decontaminate import clean
from loomgraph.llm.jaccard_join import one_of_each
from loomgraph.llm.mixing import mixed_documents
from loomgraph.llm.quality_rules import passing
from loomgraph.llm.sharding import with_shards
from loomgraph.session import tune, work_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % of their five-word shingles."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), is_stored=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen for the target weights; none is repeated."""
    return mixed_documents(docs, share=0.8, max_epochs=1)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return with_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Components, minima of hashes and budgets are beyond plain SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    tune(spark)
    folder = work_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
