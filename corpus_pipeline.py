"""A corpus from `documents` to packed training sequences, in four stages.

Each stage is one operator of recordwell.llm; its rows are written as Parquet and read
again as the next stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordwell.deploy import ship
from recordwell.llm import langid, minhash, packing, quality_rules
from recordwell.llm.byte_tokens import read_vocabulary
from recordwell.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters or of no clear language go."""
    ship(spark)
    return langid.recognised(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at least 0.3; it learns from the labels of those it is given."""
    return quality_rules.good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    ship(spark)
    return minhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with checksums."""
    import public_tokenizers

    ship(spark)
    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digest(packing.pack_documents(docs, vocabulary))


STAGES = [("language", language), ("quality", quality), ("deduplicate", deduplicate), ("pack", pack)]

#: Trained models and token ids can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
