"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.

Defined cases, for all stages: the five columns of ``documents`` are kept and others
dropped; a null id, source or label is a value like any other, and rows of one id
are documents of their own where their texts differ; texts of any length are taken
whole; an empty table gives an empty one.  A null text, or one without letters, goes
in the first stage; rows equal in id and text become one in the third.

Stages that run Python first let the executors give back the memory of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltweave.llm import language_id, line_dedup, mixing, near_documents, packing
from voltweave.llm.common import settle, stage

#: Words that a Python worker keeps with their ids; the stages share the workers' memory.
WORDS = 150_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the others' column ``lang`` holds what was told, whatever it held before."""
    settle(spark)
    return language_id.keep_identified(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go (of fewer than five words: that equal one), and documents that have no other."""
    return line_dedup.LineDedup(docs).apply(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8) one document stays."""
    settle(spark)
    return near_documents.keep_first(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.Mix(docs).apply(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of token ids."""
    settle(spark)
    return packing.pack(docs, most_words=WORDS)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Language ID, fingerprints and token ids are not SQL; a test compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
