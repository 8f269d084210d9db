"""Reads that arrive as files, and k-mer counts kept up to date. Batch tools need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import dna
from strandmill.operators import kmers
from strandmill.sources.readers import SEQ_SCHEMA


def stream_reads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(id, head, seq) of tab-separated files as they come into a folder."""
    rows = spark.readStream.schema(SEQ_SCHEMA).option("sep", "\t").option("quote", "").option("maxFilesPerTrigger", files_per_trigger).csv(path)
    return rows.withColumn("seq", dna.clean(F.col("seq")))


def running_counts(reads: DataFrame, k: int, strands: str = "canonical") -> DataFrame:
    """(kmer, cnt) over all reads so far, for output modes update and complete."""
    return kmers.explode(reads, k, strands).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))
