"""A corpus pipeline of five stages over ``documents``; each stage's result is written and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Stages
ignore further columns, whatever their names, and pass them on (the last one returns pieces); an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrand.llm import jaccard, mixing, outliers, packing, quality, scratch
from keystrand.llm.queries import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, fitted to ``labels``, doesn't reject.  Null texts count as
    empty; null labels and ids teach nothing."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules of their language and source.  Null and empty texts fail the
    base rules; null languages and sources make groups of their own."""
    return outliers.keep_normal(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id, null last.  Rows
    without words all stay."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows once per copy that the mix takes.  The null source is a source of its own."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences.  A null or empty text is a piece of one token."""
    return packing.packed(docs, tokenizer_path(spark, "word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", pass_rules),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
    return docs
