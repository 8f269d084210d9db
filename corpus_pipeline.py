"""A training corpus from documents in five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import common, langid, mixing, packing, setjoin, toxicity

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts whose language stays open."""
    return langid.accepted(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts scored as toxic by what the labels teach."""
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles of similarity 0.8 or more."""
    return setjoin.one_of_each(docs, 5, 80, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights: each document stays 0, 1 or 2 times."""
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token ids into sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("toxicity", toxic), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: The stages' models and draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
